"""Shaping results for export: hit packs, loading records, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagora.operators import metrics

ABSENT = "—"


def top_pack(run: DataFrame, gold: DataFrame, depth: int,
             keys: Sequence[str] = ("domain", "variant"), digits: int = 5) -> DataFrame:
    """(keys, instance_id, hits): the first ``depth`` hits in rank order, each
    STRUCT<doc_id, score, is_gold>; lists are bounded by the depth."""
    rows = metrics.mark_gold(run.filter(F.col("rank") <= depth), gold)
    entry = F.struct("rank", "doc_id", F.round("score", digits).alias("score"), "is_gold")
    return rows.groupBy(*keys, "instance_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)),
                    lambda h: F.struct(h["doc_id"].alias("doc_id"), h["score"].alias("score"),
                                       h["is_gold"].alias("is_gold"))).alias("hits"))


def gold_lists(gold: DataFrame) -> DataFrame:
    """(instance_id, gold): annotated documents as a sorted array."""
    return gold.groupBy("instance_id").agg(F.array_sort(F.collect_set("doc_id")).alias("gold"))


def loading_arms(decisions: DataFrame, gold: DataFrame) -> DataFrame:
    """(domain, arm, instance_id, loaded): what every arm puts into context.

    bare nothing, always the top document, gated the top document unless the
    gate refuses it, oracle the gold documents.
    """
    none = F.array().cast(f"array<{decisions.schema['top1'].dataType.simpleString()}>")
    first = F.array("top1")
    arms = F.array(
        F.struct(F.lit("bare").alias("arm"), none.alias("loaded")),
        F.struct(F.lit("always").alias("arm"), first.alias("loaded")),
        F.struct(F.lit("gated").alias("arm"),
                 F.when(F.col("decision") == "kept", first).otherwise(none).alias("loaded")))
    fixed = decisions.select("domain", "instance_id", F.explode(arms).alias("a")).select(
        "domain", "a.arm", "instance_id", "a.loaded")
    oracle = decisions.select("domain", "instance_id").join(gold_lists(gold), "instance_id").select(
        "domain", F.lit("oracle").alias("arm"), "instance_id", F.col("gold").alias("loaded"))
    return fixed.unionByName(oracle)


def loading_records(loading: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds gold and hit: 1 if a loaded document is gold, 0 if none is, null if
    nothing was loaded."""
    joined = loading.join(gold_lists(gold), "instance_id", "left")
    hit = F.when(F.size("loaded") == 0, F.lit(None).cast("int")).otherwise(
        F.coalesce(F.arrays_overlap("loaded", "gold"), F.lit(False)).cast("int"))
    return joined.withColumn("hit", hit)


def nested_summary(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metrics MAP<metric, value>) with keys in order."""
    return cells.groupBy(*keys).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def metric_pivot(cells: DataFrame, keys: Sequence[str], names: Sequence[str],
                 digits: int = 4) -> DataFrame:
    """One column per metric as text; a cell that was not measured prints a dash."""
    wide = cells.groupBy(*keys).pivot("metric", list(names)).agg(F.round(F.max("value"), digits))
    return wide.select(*keys, *[
        F.coalesce(F.when(F.col(f"`{n}`").isNotNull(),
                          F.format_string(f"%.{digits}f", F.col(f"`{n}`"))), F.lit(ABSENT)).alias(n)
        for n in names])


def router_records(router: DataFrame, scores: DataFrame, fraction: float, seed: int) -> DataFrame:
    """One record per domain with all validation scores."""
    maps = scores.groupBy("domain").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("variant", F.round("score", 4).alias("score"))))).alias("scores"))
    return router.join(maps, "domain").select(
        "domain", "pick", "n_val", "degenerate", F.lit(fraction).alias("val_fraction"),
        F.lit(seed).alias("seed"), "scores")


def metrics_flat(run_metrics: DataFrame, outcomes: DataFrame, digits: int = 5) -> DataFrame:
    """(domain, method, metric, value): run metrics, arm accuracies, arm sizes."""
    arms = outcomes.groupBy("domain", "arm").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.count(F.lit(1)).cast("double").alias("n"))
    long = arms.unpivot(["domain", "arm"], ["accuracy", "n"], "metric", "value").select(
        "domain", F.concat(F.lit("arm:"), "arm").alias("method"), "metric", "value")
    runs = run_metrics.select("domain", F.col("variant").alias("method"), "metric", "value")
    return runs.unionByName(long).withColumn("value", F.round("value", digits))


def model_summary(scores: DataFrame, router: DataFrame, taus: DataFrame, counts: DataFrame,
                  outcomes: DataFrame) -> DataFrame:
    """One record per domain: variant means, router, thresholds, gate, accuracy."""
    means = scores.groupBy("domain", "variant").agg(F.avg("value").alias("v")).groupBy("domain").agg(
        F.map_from_entries(F.collect_list(F.struct("variant", "v"))).alias("ndcg10"))
    acc = outcomes.groupBy("domain", "arm").agg(
        F.avg(F.col("correct").cast("double")).alias("v")).groupBy("domain").agg(
        F.map_from_entries(F.collect_list(F.struct("arm", "v"))).alias("accuracy"))
    return (
        means.join(router.select("domain", "pick", "degenerate"), "domain")
        .join(taus.select("domain", "tau1", "tau2"), "domain", "left")
        .join(counts, "domain", "left").join(acc, "domain", "left"))


def sample_pack(picks: DataFrame, queries: DataFrame, samples: DataFrame, run: DataFrame,
                corpus: DataFrame, gold: DataFrame, depth: int = 3,
                description_chars: int = 300) -> DataFrame:
    """(domain, instance_id, query, imaginations, tops, gold) for picked instances.

    ``picks`` is a small seeded sample per domain, so every list here is bounded.
    """
    imagined = samples.join(picks.select("instance_id"), "instance_id", "left_semi") \
        .groupBy("instance_id").agg(F.sort_array(F.collect_list(
            F.struct("template", "sample_index", "text"))).alias("imaginations"))
    hits = metrics.mark_gold(
        run.filter(F.col("rank") <= depth).join(picks.select("instance_id"), "instance_id", "left_semi"),
        gold)
    named = hits.join(corpus.select("doc_id", "name", "description"), "doc_id", "left")
    tops = named.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct(
        "variant", "rank", "doc_id", F.coalesce("name", F.lit("")).alias("name"),
        F.substring(F.coalesce("description", F.lit("")), 1, description_chars).alias("description"),
        F.round("score", 5).alias("score"), "is_gold"))).alias("tops"))
    return (
        picks.join(queries, "instance_id").join(imagined, "instance_id", "left")
        .join(tops, "instance_id", "left").join(gold_lists(gold), "instance_id", "left"))
