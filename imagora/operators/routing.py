"""Choosing a variant per domain or per instance, and replaying the choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagora.functions import vector as vx

# The order that breaks ties between equal scores.
STRICT_ORDER = ("hypo_sentence", "hypo_passage", "hypo_skill", "fused", "two_stage")
LOOSE_ORDER = ("hypo_skill", "hypo_passage", "hypo_sentence", "fused", "two_stage")
FALLBACK = "hypo_skill"
SCORE_DIGITS = 10


def order_of(variant: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), variant)


def best_variant(score: Column, order: Sequence[str], variant: str = "variant") -> Column:
    """Aggregate: the variant with the highest score, earliest in order on ties."""
    return F.max_by(variant, F.struct(F.round(score, SCORE_DIGITS),
                                      -order_of(F.col(variant), order)))


def variant_scores(scores: DataFrame, validation: DataFrame) -> DataFrame:
    """(domain, variant, score, n_val): mean of ``value`` on validation ids."""
    val = validation.filter("is_validation").select("domain", "instance_id")
    return scores.join(val, ["domain", "instance_id"]).groupBy("domain", "variant").agg(
        F.avg("value").alias("score"), F.count(F.lit(1)).alias("n_val"))


def route(scores: DataFrame, validation: DataFrame, order: Sequence[str] = LOOSE_ORDER,
          fallback: str = FALLBACK) -> DataFrame:
    """(domain, pick, best, degenerate, n_val, n_variants).

    If no variant scores above zero the fallback is taken where it was measured.
    """
    means = variant_scores(scores, validation)
    return means.groupBy("domain").agg(
        best_variant(F.col("score"), order).alias("_best"),
        F.max("score").alias("best"), F.max("n_val").alias("n_val"),
        F.count(F.lit(1)).alias("n_variants"),
        F.max((F.col("variant") == fallback).cast("int")).alias("_has"),
    ).select(
        "domain",
        F.when((F.col("best") <= 0) & (F.col("_has") == 1), F.lit(fallback))
        .otherwise(F.col("_best")).alias("pick"),
        "best", (F.col("best") <= 0).alias("degenerate"), "n_val", "n_variants")


def routed_run(run: DataFrame, router: DataFrame, name: str = "routed") -> DataFrame:
    """The picked variant's hits under the name ``routed``."""
    picks = router.select("domain", F.col("pick").alias("variant"))
    return run.join(picks, ["domain", "variant"]).withColumn("source_variant", F.col("variant")) \
        .withColumn("variant", F.lit(name))


def run_difference(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in exactly one of two runs, counted with multiplicity, and the side."""
    both = a.select(*cols).withColumn("_w", F.lit(1)).unionByName(
        b.select(*cols).withColumn("_w", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_w").alias("surplus")).filter(F.col("surplus") != 0)


def difficulty_thresholds(rows: DataFrame, single: str, fused: str) -> DataFrame:
    """Best agreement threshold per domain on validation rows.

    ``rows``: domain, instance_id, is_validation, agreement, and one score
    column per variant. Agreement at or above the threshold takes the single
    vector, below it the fusion. Agreements are counted in thousandths, so the
    prefix sums run over at most 2,001 cells per domain however many rows a
    domain has. Returns (domain, tau, val_mean).
    """
    micro = F.round(F.col("agreement") * 1e6).cast("bigint")
    val = rows.filter("is_validation").select(
        "domain", F.floor(micro / 1000).alias("cell"),
        F.floor((micro + 500) / 1000).alias("candidate"),
        F.col(single).alias("s"), F.col(fused).alias("f"))
    cells = val.groupBy("domain", "cell").agg(
        F.sum("s").alias("s"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"),
        F.lit(0).alias("is_candidate"))
    marks = val.select("domain", F.col("candidate").alias("cell")).distinct().select(
        "domain", "cell", F.lit(0.0).alias("s"), F.lit(0.0).alias("f"), F.lit(0).alias("n"),
        F.lit(1).alias("is_candidate"))
    merged = cells.unionByName(marks).groupBy("domain", "cell").agg(
        F.sum("s").alias("s"), F.sum("f").alias("f"), F.sum("n").alias("n"),
        F.max("is_candidate").alias("is_candidate"))
    up = Window.partitionBy("domain").orderBy("cell").rowsBetween(
        Window.currentRow, Window.unboundedFollowing)
    below = Window.partitionBy("domain").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy("domain")
    scored = merged.select(
        "domain", "cell", "is_candidate",
        F.round((F.sum("s").over(up) + F.coalesce(F.sum("f").over(below), F.lit(0.0)))
                / F.sum("n").over(whole), SCORE_DIGITS).alias("val_mean"))
    return scored.filter("is_candidate = 1").groupBy("domain").agg(
        F.max_by("cell", F.struct(F.col("val_mean"), -F.col("cell"))).alias("tau_cell"),
        F.max("val_mean").alias("val_mean"),
    ).withColumn("tau", F.col("tau_cell") / F.lit(1000.0))


def takes_single(agreement: Column, tau_cell: Column) -> Column:
    micro = F.round(agreement * 1e6).cast("bigint")
    return F.floor(micro / 1000) >= tau_cell


def judge_scores(run: DataFrame, centroids: DataFrame, doc_vectors: DataFrame,
                 depth: int) -> DataFrame:
    """(domain, instance_id, variant, judge): DCG-weighted mean dot product of a
    variant's first ``depth`` hits with the instance's centroid."""
    top = run.filter(F.col("rank") <= depth).select("domain", "instance_id", "variant", "rank", "doc_id")
    joined = top.join(centroids.select("instance_id", F.col("vec").alias("_c")), "instance_id") \
        .join(doc_vectors.select("doc_id", F.col("vec").alias("_d")), "doc_id")
    w = F.lit(1.0) / F.log2(F.col("rank") + F.lit(1))
    return joined.groupBy("domain", "instance_id", "variant").agg(
        (F.sum(w * vx.dot(F.col("_c"), F.col("_d"))) / F.sum(w)).alias("judge"))


def pick_per_instance(scores: DataFrame, score: str, order: Sequence[str]) -> DataFrame:
    """(domain, instance_id, pick): highest score over the variants."""
    return scores.groupBy("domain", "instance_id").agg(
        best_variant(F.col(score), order).alias("pick"))
