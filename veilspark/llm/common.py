"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at once.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor must see; without that setting, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and lost executors lose none of it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave, once nothing that is still to be computed reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Bound the rows of one Arrow batch, so that batches of long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with at most about SLICE_CHARS characters each, and their texts with null as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLICE_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def columns_but(df: DataFrame, *names: str) -> list[str]:
    """The frame's columns without these; as in Spark, case makes no difference."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if the frame has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())
