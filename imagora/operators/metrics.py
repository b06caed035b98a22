"""Recall and nDCG at fixed depths, their means, and roll-ups over domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagora.operators import sizing

DEPTHS = (1, 5, 10, 50)
MICRO = "__all_micro__"
MACRO = "__all_macro__"


def mark_gold(run: DataFrame, gold: DataFrame) -> DataFrame:
    """Run rows with ``is_gold``."""
    flags = gold.select("instance_id", "doc_id").distinct().withColumn("is_gold", F.lit(True))
    # a run has many times the rows of its gold, which is sent to them where it is small
    return run.join(sizing.checked_broadcast(flags), ["instance_id", "doc_id"], "left").withColumn(
        "is_gold", F.coalesce("is_gold", F.lit(False)))


def ideal_dcg(n_gold: Column, depth: int) -> Column:
    top = F.least(n_gold, F.lit(depth)).cast("int")
    return F.when(top < 1, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(top, F.lit(1))), F.lit(0.0),
        lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1))))


def per_instance_wide(run: DataFrame, gold: DataFrame, keys: Sequence[str],
                      depths: Sequence[int] = DEPTHS,
                      instances: DataFrame | None = None) -> DataFrame:
    """One row per (keys, instance_id) with Recall@d and nDCG@d columns.

    ``instances`` lists the rows that must appear; one without hits scores 0.
    """
    hit = F.col("is_gold")
    aggs = []
    for d in depths:
        inside = hit & (F.col("rank") <= d)
        aggs.append(F.count_if(inside).alias(f"_h{d}"))
        aggs.append(F.coalesce(F.sum(F.when(inside, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1)))),
                               F.lit(0.0)).alias(f"_g{d}"))
    scored = mark_gold(run, gold).groupBy(*keys, "instance_id").agg(*aggs)
    if instances is not None:
        scored = instances.select(*keys, "instance_id").join(
            scored, [*keys, "instance_id"], "left").na.fill(0)
    n_gold = gold.select("instance_id", "doc_id").distinct().groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("_n"))
    joined = scored.join(n_gold, "instance_id", "left").withColumn(
        "_n", F.coalesce("_n", F.lit(0)))
    cols = []
    for d in depths:
        cols.append(F.when(F.col("_n") > 0, F.col(f"_h{d}") / F.col("_n")).otherwise(F.lit(0.0))
                    .alias(f"Recall@{d}"))
        ideal = ideal_dcg(F.col("_n"), d)
        cols.append(F.when(F.col("_n") > 0, F.col(f"_g{d}") / ideal).otherwise(F.lit(0.0))
                    .alias(f"nDCG@{d}"))
    return joined.select(*keys, "instance_id", *cols)


def to_long(wide: DataFrame, keys: Sequence[str], depths: Sequence[int] = DEPTHS) -> DataFrame:
    names = [f"{family}@{d}" for d in depths for family in ("Recall", "nDCG")]
    return wide.unpivot([*keys], [F.col(f"`{n}`") for n in names], "metric", "value")


def per_instance(run: DataFrame, gold: DataFrame, keys: Sequence[str],
                 depths: Sequence[int] = DEPTHS, instances: DataFrame | None = None) -> DataFrame:
    """(keys, instance_id, metric, value)."""
    return to_long(per_instance_wide(run, gold, keys, depths, instances),
                   [*keys, "instance_id"], depths)


def mean_metrics(run: DataFrame, gold: DataFrame, keys: Sequence[str],
                 depths: Sequence[int] = DEPTHS, instances: DataFrame | None = None) -> DataFrame:
    """(keys, metric, n, value): means in one pass, unpivoted after the aggregate."""
    wide = per_instance_wide(run, gold, keys, depths, instances)
    names = [f"{family}@{d}" for d in depths for family in ("Recall", "nDCG")]
    means = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    return to_long(means, [*keys, "n"], depths)


def with_splits(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows repeated for split 'all' and for 'validation' or 'test'."""
    flag = membership.select("instance_id", F.when(
        F.col("is_validation"), F.lit("validation")).otherwise(F.lit("test")).alias("_s"))
    return rows.join(flag, "instance_id").withColumn(
        "split", F.explode(F.array(F.lit("all"), F.col("_s")))).drop("_s")


def missing_instances(run: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted (keys, instance_id) rows the run does not cover."""
    return wanted.join(run.select(*keys, "instance_id").distinct(), [*keys, "instance_id"],
                       "left_anti")


def coverage(run: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, wanted, covered, missing, first_missing): how much of the wanted instances a run holds."""
    have = run.select(*keys, "instance_id").distinct().withColumn("_h", F.lit(True))
    joined = wanted.select(*keys, "instance_id").join(have, [*keys, "instance_id"], "left")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("wanted"), F.count("_h").alias("covered"),
        F.count_if(F.col("_h").isNull()).alias("missing"),
        F.min(F.when(F.col("_h").isNull(), F.col("instance_id"))).alias("first_missing"))


def micro_macro(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Domain cells (domain, keys, n, value) -> n-weighted and unweighted rows."""
    both = cells.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_micro"),
        F.avg("value").alias("_macro"))
    pair = F.array(
        F.struct(F.lit(MICRO).alias("domain"), F.lit("instances").alias("unit"),
                 F.col("_n").alias("n"), F.col("_micro").alias("value")),
        F.struct(F.lit(MACRO).alias("domain"), F.lit("domains").alias("unit"),
                 F.col("_d").alias("n"), F.col("_macro").alias("value")))
    return both.select(*keys, F.explode(pair).alias("_p")).select(*keys, "_p.*")


def fleet_rollup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Across models: macro rows by plain mean, the rest weighted by n.

    ``units`` counts distinct units per key and must be 1.
    """
    macro = F.col("domain") == MACRO
    return rows.groupBy("domain", *keys).agg(
        F.sum("n").alias("n"), F.count_distinct("unit").alias("units"),
        F.avg("value").alias("_plain"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_weighted"),
    ).select(
        "domain", *keys, "n", "units",
        F.when(macro, F.lit("model_domains")).otherwise(F.lit("model_instances")).alias("unit"),
        F.when(macro, F.col("_plain")).otherwise(F.col("_weighted")).alias("value"))


def common_instances(rows: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """(group, instance_id) present under every member seen in its group."""
    per = rows.groupBy(*group, "instance_id").agg(F.count_distinct(member).alias("_m"))
    total = rows.groupBy(*group).agg(F.count_distinct(member).alias("_all"))
    joined = per.join(total, list(group)) if group else per.withColumn(
        "_all", total.select("_all").scalar())
    return joined.filter(F.col("_m") == F.col("_all")).select(*group, "instance_id")


def leaderboard(cells: DataFrame, digits: int = 9) -> DataFrame:
    """Methods measured in every (model, domain) cell: mean and rank."""
    n_cells = cells.select("model", "domain").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    full = cells.groupBy("method").agg(
        F.count_distinct("model", "domain").alias("cells"),
        F.round(F.avg("value"), digits).alias("value"),
    ).filter(F.col("cells") == n_cells)
    return full.withColumn("rank", F.rank().over(Window.orderBy(F.desc("value"))))
