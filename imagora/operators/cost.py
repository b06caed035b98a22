"""Text totals and token estimates of generated samples; stage timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters per token; template each variant is generated with.
CHARS_PER_TOKEN = 3.8
VARIANT_TEMPLATE = {
    "hypo_sentence": "sentence",
    "hypo_passage": "passage",
    "hypo_skill": "skill",
    "fused": "skill",
    "two_stage": "skill",
}


def text_totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, queries, prompt_chars, output_chars, generations).

    ``rows``: keys, instance_id, prompt, texts. A prompt counts once per query;
    the texts of a query are its samples.
    """
    return rows.groupBy(*keys).agg(
        F.count_distinct("instance_id").alias("queries"),
        F.sum(F.length("prompt")).alias("prompt_chars"),
        F.sum(F.aggregate("texts", F.lit(0).cast("bigint"), lambda s, t: s + F.length(t)))
        .alias("output_chars"),
        F.sum(F.size("texts").cast("bigint")).alias("generations"))


def token_cost(totals: DataFrame, k: Column | int = 1) -> DataFrame:
    """Token estimates; the prompt is paid once per sample, hence times K."""
    prompt = F.col("prompt_chars") * (F.lit(k) if isinstance(k, int) else k)
    tin = prompt / F.lit(CHARS_PER_TOKEN)
    tout = F.col("output_chars") / F.lit(CHARS_PER_TOKEN)
    q = F.nullif(F.col("queries"), F.lit(0))
    return (
        totals.withColumn("input_tokens", tin).withColumn("output_tokens", tout)
        .withColumn("input_per_query", tin / q).withColumn("output_per_query", tout / q)
        .withColumn("total_per_query", (tin + tout) / q)
        .withColumn("output_per_generation", tout / F.nullif(F.col("generations"), F.lit(0))))


def routed_totals(router: DataFrame, totals: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Totals of each domain's picked template.

    ``router``: keys, pick; ``totals``: keys, template and the sums.
    """
    template = F.create_map(*[F.lit(x) for kv in VARIANT_TEMPLATE.items() for x in kv])
    picked = router.select(*keys, F.element_at(template, F.col("pick")).alias("template"))
    return picked.join(totals, [*keys, "template"])


def sum_totals(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return totals.groupBy(*keys).agg(*[
        F.sum(c).alias(c) for c in ("queries", "prompt_chars", "output_chars", "generations")])


def spread_over_models(costs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return costs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("models"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def timing_rollup(wanted: DataFrame, stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status, stages, rejected, total_seconds): recorded stage times.

    Without stages the status is 'unavailable'; a negative time makes it 'invalid'.
    """
    per = stages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stages"), F.count_if(F.col("seconds") < 0).alias("rejected"),
        F.sum(F.when(F.col("seconds") >= 0, F.col("seconds"))).alias("total_seconds"))
    joined = wanted.join(per, list(keys), "left")
    return joined.select(
        *keys,
        F.when(F.col("stages").isNull(), F.lit("unavailable"))
        .when(F.col("rejected") > 0, F.lit("invalid")).otherwise(F.lit("recorded")).alias("status"),
        F.coalesce("stages", F.lit(0)).alias("stages"),
        F.coalesce("rejected", F.lit(0)).alias("rejected"), "total_seconds")
