"""Pieces shared by the corpus operators: stage tables, word rules, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.operators.sizing import measured_bytes

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    A single local JVM may go without the setting; any other master must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="imagora-llm-"))


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    Each call writes to a folder of its own, so a repeated or half-finished
    write is never read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its measured size allows one."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; null and empty texts are equal."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(1), t)]


def byte_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array of about ``limit`` bytes each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array and the offset of each row (one more than rows); null is empty."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = values.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[values.offset: values.offset + len(values) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0]: offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]
