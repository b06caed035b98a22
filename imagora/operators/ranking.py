"""Per-group top-k, dense ranks over hashed order, and limits per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagora.functions.hashing import seeded_md5

SCORE_DIGITS = 6


def top_k(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column],
          rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key with a 1-based rank.

    The filter directly on the window lets Spark keep only k rows per key in
    each map task before the shuffle, so a hot key never moves whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rank_hits(df: DataFrame, keys: Sequence[str], k: int, score: str = "score",
              tie: str = "doc_id", digits: int = SCORE_DIGITS) -> DataFrame:
    """Top-k by score, ties by id; scores are rounded first so order is stable."""
    rounded = df.withColumn(score, F.round(F.col(score), digits))
    return top_k(rounded, keys, k, [F.desc(score), F.asc(tie)])


def hashed_rank(df: DataFrame, group: Sequence[str], id_cols: Sequence[str],
                seed: int | str = 0, rank_col: str = "draw_rank",
                count_col: str = "group_n") -> DataFrame:
    """0-based rank of each row in seeded md5 order within its group, and group size.

    The order is split at fixed digest prefixes: prefix counts give offsets and
    only rows sharing a prefix are sorted together, so a group holding a third
    of the table is still ranked by many tasks.
    """
    keyed = df.withColumn("_h", seeded_md5(seed, *[F.col(c) for c in id_cols])) \
              .withColumn("_p", F.substring("_h", 1, 3))
    cells = keyed.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*group).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    offsets = cells.select(
        *group, "_p",
        (F.sum("_c").over(run) - F.col("_c")).alias("_o"),
        F.sum("_c").over(whole).alias(count_col),
    )
    local = Window.partitionBy(*group, "_p").orderBy("_h", *id_cols)
    return (
        keyed.withColumn("_r", F.row_number().over(local) - F.lit(1))
        .join(offsets, [*group, "_p"])
        .withColumn(rank_col, F.col("_o") + F.col("_r"))
        .drop("_h", "_p", "_o", "_r")
    )


def sample_per_group(df: DataFrame, group: Sequence[str], id_cols: Sequence[str], n: int,
                     seed: int | str = 0) -> DataFrame:
    """``n`` seeded rows per group, the same ids for every caller with that seed."""
    keyed = df.withColumn("_h", seeded_md5(seed, *[F.col(c) for c in id_cols]))
    order = [F.asc("_h"), *[F.asc(c) for c in id_cols]]
    return top_k(keyed, group, n, order, rank_col="_r").drop("_h", "_r")
