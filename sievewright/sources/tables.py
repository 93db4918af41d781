"""Tables by format, and snapshots that are published whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "jdbc")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: object) -> DataFrame:
    """A table in one of FORMATS; jdbc takes the table's name as its path and the connection as options."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    reader = spark.read.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.option("dbtable", path).load() if kind == "jdbc" else reader.load(path)


def read_tables(spark: SparkSession, folder: str, names: Iterable[str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{folder}/{n}.{kind}", kind) for n in names}


def write_snapshot(df: DataFrame, folder: str, partition_by: Iterable[str] = (), options: Mapping[str, object] | None = None) -> str:
    """Writes a new snapshot below ``folder``, never over one that a plan may still read, and returns its path."""
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    writer = df.write.options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    file, fs = _path(spark, path)
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file as a whole: readers see the old text or the new one."""
    spare, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(spare, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(spare, _path(spark, path)[0], options)
