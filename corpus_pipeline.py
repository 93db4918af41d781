"""From raw documents to token ids in five stages, each a whole operator applied to all that the stage before it kept.

ORACLE_SQL is None: scores of boosted trees, SimHash groups and BPE merges aren't SQL. test_pipeline holds each stage's rows against a
brute-force version over the stage before it: scores, all pairs of lines and of fingerprints, the schedule slot by slot, the round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.bpe import encode_documents
from sievewright.llm.lineage import remove, shared_folder
from sievewright.llm.linededup import drop_repeated_lines
from sievewright.llm.mixing import in_mixed_order, written_order
from sievewright.llm.quality import drop_poor_documents, train_quality_model
from sievewright.llm.simhash import drop_near_duplicates, near_duplicate_groups

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, trained on the labelled ones, score as good; the others go, empty ones with them."""
    return drop_poor_documents(docs, train_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others repeat; every document stays, and n_chars follows its text.

    Copies of documents, which the next stage drops whole, keep what they share with the document they copy: without it they
    would no longer be recognised.
    """
    copies = near_duplicate_groups(docs).where("NOT kept").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    return drop_repeated_lines(docs, copies=copies)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies, that of least doc_id."""
    return drop_near_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of a fair schedule of their sources, smaller ones repeated as their target weights ask; none is lost."""
    return in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip, mix_position) of each row; the last orders them as the stage before did."""
    return encode_documents(written_order(docs), also=("mix_position",))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("source mixing", mix_to_weights), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written to the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"  # the result is lazy and reads the last folder; the others go
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            result.write.parquet(f"{folder}/{k}")
            result = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
        docs = result
    return docs
