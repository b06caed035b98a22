"""Size checks that decide between broadcasting a side and shuffling it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
SALTS = 32
SPREAD_PER_SPLIT = 32


def row_bytes(df: DataFrame) -> Column:
    """Approximate in-memory bytes of one row."""
    total = F.lit(16)
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            size = F.coalesce(F.octet_length(col), F.lit(0)) + F.lit(16)
        elif isinstance(field.dataType, T.ArrayType):
            if isinstance(field.dataType.elementType, T.StringType):
                size = F.octet_length(F.array_join(F.coalesce(col, F.array().cast("array<string>")), "")) \
                    + F.lit(16) * F.greatest(F.size(col), F.lit(0))
            else:
                size = F.lit(8) * F.greatest(F.size(col), F.lit(0)) + F.lit(16)
        else:
            size = F.lit(8)
        total = total + size
    return total


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, counted by one distributed aggregate."""
    row = df.select(row_bytes(df).cast("bigint").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def measured_bytes(df: DataFrame) -> int:
    return measure(df)[1]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its measured size allows one."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, redistributed for CPU-heavy work.

    Tables with enough files or row groups are returned as they are; a small
    table on a large cluster is cut into a bounded number of pieces.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        return df
    return df.repartition(min(cores, splits * SPREAD_PER_SPLIT))


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over all shuffle partitions before they multiply.

    Small tables would otherwise be merged into one partition and the rows
    made from them would all come out of one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], spread: Column,
                salts: int = SALTS) -> DataFrame:
    """Inner join whose hot keys are spread over ``salts`` partitions.

    ``spread`` picks a salt for each row of ``big``; ``other`` is repeated once
    per salt, so every match is still found exactly once.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
