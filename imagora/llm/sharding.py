"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a score for a key from a digest of both; the smallest score,
divided by the shard's weight, wins. A new shard can only take keys from the
others, about its share of them, and no key moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
CELLS = 1 << 18


def score(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 52 bits of md5("key:shard")."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary"))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((number + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def owners(key: Column, weights: Sequence[float]) -> Column:
    """An array over shards of (score, shard)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(score(key, s, F.element_at(w, s + 1)).alias("score"), s.alias("shard")))


def assign(rows: DataFrame, key: Column, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """The rows with ``shard`` and ``grown_shard``, the owner once one more shard is added.

    Shards of weight zero or less are refused. A null key is the empty string.
    """
    if not weights or min(*weights, grown_weight) <= 0:
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    n = len(weights)
    scored = rows.withColumn("_own", owners(text, [*weights, grown_weight]))
    return scored.withColumn("shard", F.array_min(F.slice("_own", 1, n))["shard"]).withColumn(
        "grown_shard", F.array_min("_own")["shard"]).drop("_own")


def slots(rows: DataFrame, group: str, digest: Column, order: Sequence[str], groups: int,
          buckets: int = BUCKETS) -> DataFrame:
    """The rows with ``slot``, gapless from 0 inside each group, by digest bucket and then ``order``.

    A group is cut into buckets of a digest, so no task holds a whole group:
    bucket sizes give each bucket's first slot, and only the rows of one bucket
    are sorted together.
    """
    cut = rows.withColumn("_bucket", F.pmod(digest, F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside))
    # at most groups x buckets rows
    side = F.broadcast(first) if groups * buckets <= CELLS else first
    return ranked.join(side, [group, "_bucket"]).withColumn(
        "slot", F.col("_first") + F.col("_rank") - 1).drop("_bucket", "_first", "_rank")


def shard_documents(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``doc_id`` and the shard list alone decide the shard. A null text has size 8
    and checksum 0; a null id has a shard like any other key. Repeated rows stay
    and take neighbouring slots. Other columns are not read. An empty table gives
    an empty result.
    """
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"))
    owned = assign(rows, F.col("doc_id"), weights)
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8),
                    16, 10).cast("bigint")
    placed = slots(owned, "shard", digest, ["doc_id", "text_crc32", "size"], len(weights))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), "grown_shard")
