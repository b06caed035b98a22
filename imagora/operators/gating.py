"""Deciding whether a retrieved document is used: signals, thresholds, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagora.functions import vector as vx

# Fixed values of the gate.
COVERED = 0.6
CANDIDATE_SENTENCES = 40
HYPOTHESIS_SENTENCES = 60
P_MIN = 0.9
SIGNAL_DIGITS = 4


def top1(run: DataFrame) -> DataFrame:
    return run.filter(F.col("rank") == 1).withColumnRenamed("doc_id", "top1")


def coverage(first: DataFrame, centroids: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """(instance_id, s1): dot product of the centroid with the top document."""
    return (
        first.join(centroids.select("instance_id", F.col("vec").alias("_c")), "instance_id")
        .join(doc_vectors.select(F.col("doc_id").alias("top1"), F.col("vec").alias("_d")), "top1")
        .select("instance_id", F.round(vx.dot(F.col("_c"), F.col("_d")), SIGNAL_DIGITS).alias("s1"))
    )


def novelty(candidates: Column, hypotheses: Column, threshold: float = COVERED) -> Column:
    """Share of candidate sentences no hypothesis sentence covers; 1.0 if either
    side is empty. Both arrays are bounded by the sentence limits."""
    cand = F.slice(candidates, 1, CANDIDATE_SENTENCES)
    hyp = F.slice(hypotheses, 1, HYPOTHESIS_SENTENCES)
    share = vx.bind(
        vx.best_match(cand, hyp),
        lambda best: F.size(F.filter(best, lambda s: F.round(s, 9) < threshold)) / F.size(best))
    return F.when((F.coalesce(F.size(cand), F.lit(0)) > 0) & (F.coalesce(F.size(hyp), F.lit(0)) > 0),
                  F.round(share, SIGNAL_DIGITS)).otherwise(F.lit(1.0))


def signal_misses(asked: DataFrame, first: DataFrame, sampled: DataFrame) -> DataFrame:
    """(domain, asked, no_hits, no_samples, scored): why records carry no signal.

    ``asked``: domain, instance_id; ``first``: instance_id of records with a top document;
    ``sampled``: instance_id of records with samples.
    """
    hit = first.select("instance_id").distinct().withColumn("_hit", F.lit(True))
    smp = sampled.select("instance_id").distinct().withColumn("_smp", F.lit(True))
    rows = asked.join(hit, "instance_id", "left").join(smp, "instance_id", "left")
    no_hit = F.col("_hit").isNull()
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(no_hit).alias("no_hits"),
        F.count_if(~no_hit & F.col("_smp").isNull()).alias("no_samples"),
        F.count_if(~no_hit & F.col("_smp").isNotNull()).alias("scored"))


def pick_tau(rows: DataFrame, keys: Sequence[str], value: str, positive: str,
             p_min: float = P_MIN) -> DataFrame:
    """(keys, tau): the largest value whose prefix precision reaches p_min.

    Rows are ordered by (value, positive), negatives first. Rows of equal value
    are counted first: within them precision peaks at the first negative or
    after the last positive, so two tests per distinct value decide it. Signals
    have four digits, which bounds the distinct values a window sees.
    """
    cells = rows.filter(F.col(value).isNotNull() & F.col(positive).isNotNull()) \
        .groupBy(*keys, F.col(value).alias("v")).agg(
            F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("cp", F.sum("p").over(w)).withColumn("cn", F.sum(F.col("p") + F.col("q")).over(w))
    before_p = F.col("cp") - F.col("p")
    before_n = F.col("cn") - F.col("p") - F.col("q")
    at_end = F.col("cp") / F.col("cn") >= p_min
    at_first = (F.col("q") > 0) & (before_p / (before_n + 1) >= p_min)
    return run.groupBy(*keys).agg(F.max(F.when(at_end | at_first, F.col("v"))).alias("tau"))


def calibrate(signals: DataFrame, validation: DataFrame, bare: DataFrame | None = None,
              p_min: float = P_MIN) -> DataFrame:
    """(domain, tau1, tau2, n_val) from the validation rows.

    ``signals``: domain, instance_id, s1, s2, top1_wrong. ``bare``: instance_id,
    correct; without it tau2 stays null.
    """
    val = signals.join(validation.filter("is_validation").select("domain", "instance_id"),
                       ["domain", "instance_id"])
    out = val.groupBy("domain").agg(F.count(F.lit(1)).alias("n_val")).join(
        pick_tau(val, ["domain"], "s1", "top1_wrong", p_min).withColumnRenamed("tau", "tau1"),
        "domain", "left")
    if bare is None:
        return out.withColumn("tau2", F.lit(None).cast("double"))
    known = val.join(bare.select("instance_id", "correct"), "instance_id")
    tau2 = pick_tau(known, ["domain"], "s2", "correct", p_min).withColumnRenamed("tau", "tau2")
    return out.join(tau2, "domain", "left")


def decision(s1: Column, s2: Column, tau1: Column, tau2: Column) -> Column:
    """Strictly below tau1 blocks, else strictly below tau2 skips; null is off."""
    return (
        F.when(F.coalesce(s1 < tau1, F.lit(False)), F.lit("blocked"))
        .when(F.coalesce(s2 < tau2, F.lit(False)), F.lit("skipped"))
        .otherwise(F.lit("kept"))
    )


def decide(signals: DataFrame, taus: DataFrame) -> DataFrame:
    return signals.join(taus.select("domain", "tau1", "tau2"), "domain", "left").withColumn(
        "decision", decision(F.col("s1"), F.col("s2"), F.col("tau1"), F.col("tau2")))


def apply_gate(run: DataFrame, decisions: DataFrame) -> DataFrame:
    """The run without the hits of blocked and skipped instances.

    Instances without a signal pass through.
    """
    dropped = decisions.filter(F.col("decision") != "kept").select("domain", "instance_id")
    return run.join(dropped, ["domain", "instance_id"], "left_anti")


def gate_counts(decisions: DataFrame) -> DataFrame:
    """(domain, blocked, skipped, kept, block_precision)."""
    blocked = F.col("decision") == "blocked"
    return decisions.groupBy("domain").agg(
        F.count_if(blocked).alias("blocked"),
        F.count_if(F.col("decision") == "skipped").alias("skipped"),
        F.count_if(F.col("decision") == "kept").alias("kept"),
        F.avg(F.when(blocked, F.col("top1_wrong").cast("double"))).alias("block_precision"))
