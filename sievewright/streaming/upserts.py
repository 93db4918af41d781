"""Upserts from a stream: each micro-batch becomes a new snapshot, and a durable pointer names the latest."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import Registry
from ..operators.mutate import Mutations
from ..sources.tables import read_text, write_snapshot, write_text

_POINTER = "latest.json"


def latest(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """The last batch that was published below ``folder`` and the path of its snapshot; None before the first."""
    text = read_text(spark, f"{folder.rstrip('/')}/{_POINTER}")
    found = json.loads(text) if text else None
    return (found["batch"], found["path"]) if found else None


def upsert_stream(stream: DataFrame, registry: Registry, name: str, folder: str, checkpoint: str, key: Sequence[str] | None = None, order: str | None = None, **trigger: object) -> StreamingQuery:
    """Upserts each micro-batch, writes the snapshot below ``folder`` and binds it.

    A pointer in ``folder``, replaced as a whole once a snapshot is written, holds the batch's number and the snapshot's path.
    A restarted stream begins with the snapshot it names, and a batch that it covers is not applied again: each batch counts once,
    wherever the driver stopped. ``order`` names the column by which later rows of a key win.
    """
    spark = stream.sparkSession
    found = latest(spark, folder)
    if found:
        registry.bind(name, spark.read.parquet(found[1]))

    def merge(batch: DataFrame, number: int) -> None:
        done = latest(batch.sparkSession, folder)
        if done and done[0] >= number:
            return
        change = Mutations(registry, name).upsert_many(batch, key, order)
        path = write_snapshot(change.snapshot, folder)
        write_text(batch.sparkSession, f"{folder.rstrip('/')}/{_POINTER}", json.dumps({"batch": number, "path": path}))
        registry.bind(name, batch.sparkSession.read.parquet(path))
        for hook in change.after:
            hook(name, change)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
