"""Mixing sources to target weights by proportionate-fair scheduling of blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def quantise(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period`` slots by largest remainder, at least 1 for each positive weight; ties go to the name."""
    named = {k: float(v) for k, v in weights.items() if v > 0}
    if not named:
        return {}
    if len(named) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(named.values())
    spare = period - len(named)
    exact = {k: max(0.0, v / total * period - 1) for k, v in named.items()}
    scale = spare / (sum(exact.values()) or 1.0)
    exact = {k: v * scale for k, v in exact.items()}
    out = {k: 1 + int(v) for k, v in exact.items()}
    for k in sorted(named, key=lambda k: (-(exact[k] - int(exact[k])), k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def pfair_period(shares: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, block) for each slot of one period, blocks counted from 0 by source.

    With q of Q slots, block j of a source is released at floor(j Q / q) and due at ceil((j + 1) Q / q); among the released the
    earliest deadline goes first, ties by name. As the shares fill the period, every deadline is met, so after any t slots a
    source has had within one block of t q / Q, exactly its share at the period's end, and periods can be laid end to end.
    """
    slots = sum(shares.values())
    waiting = [(0, k) for k in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    given = dict.fromkeys(shares, 0)
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(given[k] + 1) * slots // shares[k]), k))
        due, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        out.append((k, given[k]))
        given[k] += 1
        if given[k] < shares[k]:
            heapq.heappush(waiting, (given[k] * slots // shares[k], k))
    return out


def pfair_run(shares: list[int], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot, sources by place, until each has had its ``blocks``; releases and deadlines are ``pfair_period``'s.

    Shares are whole numbers of any size and nothing but the sources is held, so that rounding is as small as their sum is large.
    """
    slots = sum(shares)
    waiting = [(0, i) for i in range(len(shares))]
    ready: list[tuple[int, int]] = []
    given = [0] * len(shares)
    short = sum(b > 0 for b in blocks)
    t = 0
    while short:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(given[i] + 1) * slots // shares[i]), i))
        due, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        yield i, given[i]
        given[i] += 1
        short -= given[i] == blocks[i]
        heapq.heappush(waiting, (given[i] * slots // shares[i], i))
        t += 1


def _schedule(facts: DataFrame) -> DataFrame:
    """(mix_source, mix_own, mix_epoch, mix_block, mix_slot) of every slot of the run; one task streams it, holding the sources only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["mix_source"], r["mix_share"], r["mix_blocks"]) for batch in batches for r in batch.to_pylist())
        names, size = pa.array([r[0] for r in rows], pa.string()), [r[2] for r in rows]
        own: list[tuple[int, int]] = []
        slot = 0

        def batch() -> pa.RecordBatch:
            at = pa.array([i for i, _ in own], pa.int64())
            cols = [names.take(at), pa.array([b % size[i] for i, b in own], pa.int64()), pa.array([b // size[i] for i, b in own], pa.int32()), pa.array([b for _, b in own], pa.int64()), pa.array(range(slot - len(own), slot), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["mix_source", "mix_own", "mix_epoch", "mix_block", "mix_slot"])

        for turn in pfair_run([r[1] for r in rows], size):
            own.append(turn)
            slot += 1
            if len(own) == 1 << 16:
                yield batch()
                own = []
        yield batch()

    return facts.select("mix_source", "mix_share", "mix_blocks").repartition(1).mapInArrow(run, "mix_source string, mix_own long, mix_epoch int, mix_block long, mix_slot long")


_NONE = "\x00none"


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source_col: str = "source",
    block_rows: int = 16,
    period: int | None = None,
    exponent: float = 0.7,
    bucket_rows: int = 4096,
) -> DataFrame:
    """docs in mixed order: all its columns and mix_source, mix_epoch, mix_block, mix_slot, mix_position.

    The rows of a source, in an order of their hashes, are dealt into blocks of ``block_rows``. Blocks take slots by
    ``pfair_run``, so that after any number of slots a source holds within one block of its target weight's share.
    The mixture goes on until every source has been through once, which decides its length; a source that runs out starts
    over as another epoch. So no row is lost, and weights are kept to the end by repetition. ``mix_position`` orders the rows.

    ``weights`` by source, None for null; sources without a positive weight take no part, and weights for absent sources none
    either. Without weights, a source's is its share of the rows to the power of ``exponent``. Weights are met to 2**-62, however
    many sources there are; with a ``period`` to 1/period, at most so many sources, and the schedule repeats. An epoch's last
    block may be short; rows in it count as a block. Ids aren't looked at: nulls and repeats spread like other rows, and equal
    rows change places freely. An empty table gives no rows. Columns of docs with the five names above are replaced; any other
    names may occur, as rows travel as one struct.

    Ranks come from counts of hash buckets of about ``bucket_rows`` rows, so a large source is spread over many tasks. The
    schedule is a table with a row for each block, made in one task, and goes to the buckets; nothing is broadcast by plan. That task
    takes a few microseconds a slot, as each choice depends on the one before: for billions of rows ``block_rows`` should grow.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_source", "mix_epoch", "mix_block", "mix_slot", "mix_position")
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(_NONE)).alias("mix_source"), F.xxhash64(F.lit(17), *plain).alias("h"))
    counts = cut(named.groupBy("mix_source").agg(F.count("*").alias("mix_rows")))
    if weights is None:
        facts = counts.withColumn("mix_weight", F.pow("mix_rows", F.lit(float(exponent))))
    else:
        given = [(_NONE if k is None else k, float(v)) for k, v in weights.items() if v > 0]
        facts = counts.join(spark.createDataFrame(given, "mix_source string, mix_weight double"), "mix_source")
    if period is None:
        total = facts.agg(F.sum("mix_weight")).first()[0] or 1.0
        facts = facts.withColumn("mix_share", F.greatest(F.lit(1), F.round(F.col("mix_weight") / F.lit(total) * F.lit(2.0**62)).cast("long")))
    else:
        shares = quantise({r["mix_source"]: r["mix_weight"] for r in facts.collect()}, period)
        facts = facts.join(spark.createDataFrame(list(shares.items()), "mix_source string, mix_share long"), "mix_source")
    facts = cut(facts.withColumn("mix_blocks", F.ceil(F.col("mix_rows") / block_rows).cast("long")))

    buckets = max(1, -(-(counts.agg(F.max("mix_rows")).first()[0] or 1) // bucket_rows))
    # 2**63 hashes in equal ranges, so that the order of buckets is that of hashes
    high = F.shiftrightunsigned("h", 1)
    keyed = named.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(high / F.lit(2.0**63) * buckets)).cast("int"))
    sizes = keyed.groupBy("mix_source", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("mix_source", "bucket", "n", (F.sum("n").over(Window.partitionBy("mix_source").orderBy("bucket")) - F.col("n")).alias("before"))
    before = cut(before.join(facts.select("mix_source"), "mix_source"))  # a row for each bucket: the input's rows / bucket_rows, and at least the sources
    # the turns of each block that has rows in a bucket, by the block's number in an epoch
    turns = _schedule(facts).groupBy("mix_source", "mix_own").agg(F.collect_list(F.struct("mix_epoch", "mix_block", "mix_slot")).alias("turns"))
    first, final = (F.floor(x / block_rows).cast("long") for x in (F.col("before"), F.col("before") + F.col("n") - 1))
    held = before.select("mix_source", "bucket", "before", F.explode(F.sequence(first, final)).alias("mix_own")).join(turns, ["mix_source", "mix_own"])
    held = cut(held.groupBy("mix_source", "bucket", "before").agg(F.sort_array(F.collect_list(F.struct("mix_own", "turns"))).alias("held")))

    within = Window.partitionBy("mix_source", "bucket").orderBy("h")
    ranked = keyed.withColumn("r", F.row_number().over(within)).join(held, ["mix_source", "bucket"])
    rank = F.col("before") + F.col("r") - 1
    mine = (F.floor(rank / block_rows) - F.floor(F.col("before") / block_rows)).cast("int")
    # a row comes again at every turn of its block
    spread = ranked.select("row", "mix_source", rank.alias("r"), F.explode(F.get("held", mine)["turns"]).alias("turn"))
    slot = F.col("turn.mix_slot")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return spread.select(*own, F.when(F.col("mix_source") != _NONE, F.col("mix_source")).alias("mix_source"), F.col("turn.mix_epoch").alias("mix_epoch"), F.col("turn.mix_block").alias("mix_block"), slot.alias("mix_slot"), (slot * block_rows + F.col("r") % block_rows).cast("long").alias("mix_position"))


def in_mixed_order(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of docs repeated and sorted as ``mix_sources`` says, with docs's own columns. ``written_order`` tells the order of what is written."""
    return mix_sources(docs, **how).orderBy("mix_position").select(*(F.col(f"`{c}`") for c in docs.columns))


def written_order(docs: DataFrame, name: str = "mix_position") -> DataFrame:
    """docs, read from files, with a long that orders its rows as they were written: by the part's number, then by the row in it.

    A sorted table keeps its order this way through files that are read in any order and by any number of tasks. Where docs isn't
    read from files there is no such order, and the column is null.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return docs.withColumn(name, F.lit(None).cast("long"))
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    return docs.withColumn(name, F.shiftleft(part, 40) + F.col("_metadata.row_index"))
