"""Runs over several K, arm outcomes, and a models x domains matrix.

``k_metrics`` re-runs all variants of the vector experiment at every K. ``cells`` reads orders by region (model), market segment (domain),
priority (K) and status (variant).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.functions import hashing
from imagora.operators import metrics, routing, sizing, splits
from imagora.plans import eval_setup as es
from imagora.plans import vector_setup as vs
from imagora.plans.tables import load, staged

K_OF_PRIORITY = {"1": 1, "2": 2, "3": 4, "4": 8, "5": 10}


def build_k_metrics(spark: SparkSession, sf: str) -> DataFrame:
    known = vs.gold(spark, sf).select("instance_id").distinct()
    run = vs.build_k_run(spark, sf).join(sizing.checked_broadcast(known), "instance_id", "left_semi")
    return metrics.per_instance_wide(run, vs.gold(spark, sf), ("k_samples", "domain", "variant"))


def k_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(k_samples, domain, variant, instance_id, Recall@d..., nDCG@d...), written once."""
    return staged(spark, sf, "k_metrics", lambda: build_k_metrics(spark, sf))


def _value(rows: DataFrame) -> DataFrame:
    return rows.select("k_samples", "domain", "variant", "instance_id", F.col("`nDCG@10`").alias("value"))


def k_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(k_samples, domain, variant, instance_id, value): nDCG@10 at every K."""
    return _value(k_metrics(spark, sf))


def build_k_validation(spark: SparkSession, sf: str) -> DataFrame:
    ids = metrics.common_instances(k_scores(spark, sf).filter(F.col("k_samples") == vs.K), ("domain",), "variant")
    return splits.validation_split(ids)


def k_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded split, written once: the run at ``vs.K`` is one of those at every K, and is not made again."""
    return staged(spark, sf, "k_validation", lambda: build_k_validation(spark, sf))


def k_router(spark: SparkSession, sf: str) -> DataFrame:
    """(k_samples, domain, pick, best, degenerate, n_val): one routing per K."""
    val = k_validation(spark, sf)
    ks = k_scores(spark, sf).withColumn(
        "domain", F.concat_ws("|", F.col("k_samples").cast("string"), "domain"))
    grid = val.withColumn("k", F.explode(F.array(*[F.lit(k) for k in vs.K_VALUES]))).select(
        F.concat_ws("|", F.col("k").cast("string"), "domain").alias("domain"),
        "instance_id", "is_validation")
    routed = routing.route(ks, grid, routing.STRICT_ORDER)
    return routed.select(
        F.substring_index("domain", "|", 1).cast("int").alias("k_samples"),
        F.substring_index("domain", "|", -1).alias("domain"), "pick", "best", "degenerate", "n_val")


def k_metrics_with_routed(spark: SparkSession, sf: str) -> DataFrame:
    base = k_metrics(spark, sf)
    # one row per K and domain
    picks = F.broadcast(k_router(spark, sf).select("k_samples", "domain", F.col("pick").alias("variant")))
    routed = base.join(picks, ["k_samples", "domain", "variant"]).withColumn("variant", F.lit("routed"))
    return base.unionByName(routed.select(*[F.col(f"`{c}`") for c in base.columns]))


def k_scores_with_routed(spark: SparkSession, sf: str) -> DataFrame:
    return _value(k_metrics_with_routed(spark, sf))


def k_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(variant, k_samples, domain, instance_id, a, b): K against K=4 on test ids."""
    return staged(spark, sf, "k_pairs", lambda: build_k_pairs(spark, sf))


def build_k_pairs(spark: SparkSession, sf: str) -> DataFrame:
    test = k_validation(spark, sf).filter("NOT is_validation").select("domain", "instance_id")
    rows = k_scores_with_routed(spark, sf).join(test, ["domain", "instance_id"])
    on = ["domain", "instance_id", "variant"]
    return rows.filter("k_samples <> 4").withColumnRenamed("value", "a").join(
        rows.filter("k_samples = 4").select(*on, F.col("value").alias("b")), on)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """(domain, instance_id, arm, correct, failure_category) from `labels`."""
    rows = load(spark, sf, "labels").join(
        load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    fail = F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("low_quality"))
    right = {"bare": F.col("quality"), "always": 1 - F.col("toxic"),
             "gated": F.greatest(F.col("quality"), 1 - F.col("toxic"))}
    arms = F.array(*[
        F.struct(F.lit(a).alias("arm"), (c == 1).alias("correct"),
                 F.when(c == 1, F.lit("success")).otherwise(fail).alias("failure_category"))
        for a, c in right.items()])
    return rows.select(F.col("lang").alias("domain"), F.col("doc_id").alias("instance_id"),
                       F.explode(arms).alias("a")).select("domain", "instance_id", "a.*")


def outcome_split(spark: SparkSession, sf: str) -> DataFrame:
    ids = outcomes(spark, sf).select("domain", "instance_id").distinct()
    return splits.validation_split(ids)


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """(model, domain, k_samples, variant, method, price) per order."""
    o = load(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus",
                                         "o_orderdate", "o_totalprice")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    kmap = F.create_map(*[F.lit(x) for kv in K_OF_PRIORITY.items() for x in kv])
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model"),
                F.col("c_mktsegment").alias("domain"),
                F.element_at(kmap, F.substring("o_orderpriority", 1, 1)).alias("k_samples"),
                F.col("o_orderstatus").alias("variant"),
                F.date_format("o_orderdate", "yyyy-MM").alias("method"),
                (F.col("o_totalprice") / 1e6).alias("price")))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(model, domain, k_samples, variant, n, value, unit)."""
    return trade(spark, sf).groupBy("model", "domain", "k_samples", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("value")).withColumn("unit", F.lit("instances"))


# ------------------------------------------------------------------ oracle SQL

SQL_TRADE = """
trade AS (SELECT 'm' || n_regionkey AS model, c_mktsegment AS domain,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 4 WHEN '4' THEN 8 ELSE 10 END AS k_samples,
  o_orderstatus AS variant, strftime(o_orderdate, '%Y-%m') AS method, o_totalprice / 1e6::DOUBLE AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
cells AS (SELECT model, domain, k_samples, variant, count(*) AS n, avg(price) AS value, 'instances' AS unit
  FROM trade GROUP BY ALL)"""

SQL_K = es.SQL_SCORES.replace(vs.sql_run(), vs.sql_run(vs.sql_base_over_k()), 1) + """,
kall AS MATERIALIZED (SELECT (instance_id % 100)::INTEGER AS k_samples, domain, variant, instance_id // 100 AS instance_id, d, rec, nd FROM pi),
kval AS (SELECT domain, instance_id, rn <= greatest(1, floor(0.2::DOUBLE * n)) AS is_validation FROM (
  SELECT domain, instance_id, count(*) OVER (PARTITION BY domain) AS n,
    row_number() OVER (PARTITION BY domain ORDER BY md5('0:' || instance_id), instance_id) AS rn
  FROM (SELECT DISTINCT domain, instance_id FROM kall))),
ksc AS (SELECT k_samples, domain, variant, instance_id, nd AS value FROM kall WHERE d = 10),
kvs AS (SELECT k_samples, domain, variant, avg(value) AS score, count(*) AS n_val FROM ksc
  JOIN kval USING (domain, instance_id) WHERE is_validation GROUP BY ALL),
kord(variant, o) AS (VALUES ('hypo_sentence', 1), ('hypo_passage', 2), ('hypo_skill', 3), ('fused', 4), ('two_stage', 5)),
krt AS (SELECT k_samples, domain, CASE WHEN max(score) <= 0 THEN 'hypo_skill'
    ELSE first(variant ORDER BY round(score, 10) DESC, o) END AS pick, max(score) AS best, max(score) <= 0 AS degenerate,
    max(n_val) AS n_val FROM kvs JOIN kord USING (variant) GROUP BY ALL),
kar AS (SELECT * FROM kall UNION ALL SELECT s.k_samples, s.domain, 'routed', s.instance_id, s.d, s.rec, s.nd
  FROM kall s JOIN krt r ON r.k_samples = s.k_samples AND r.domain = s.domain AND r.pick = s.variant),
ksr AS (SELECT k_samples, domain, variant, instance_id, nd AS value FROM kar WHERE d = 10),
kpair AS (SELECT a.variant, a.k_samples, a.domain, a.instance_id, a.value AS a, b.value AS b, a.value - b.value AS v
  FROM ksr a JOIN ksr b USING (domain, variant, instance_id) JOIN kval USING (domain, instance_id)
  WHERE a.k_samples <> 4 AND b.k_samples = 4 AND NOT is_validation)"""

SQL_OUT = """
lab AS (SELECT lang AS domain, doc_id AS instance_id, quality, toxic FROM labels JOIN documents USING (doc_id)),
arms0 AS (SELECT domain, instance_id, toxic, 'bare' AS arm, quality = 1 AS correct FROM lab
  UNION ALL SELECT domain, instance_id, toxic, 'always', toxic = 0 FROM lab
  UNION ALL SELECT domain, instance_id, toxic, 'gated', greatest(quality, 1 - toxic) = 1 FROM lab),
arms AS (SELECT domain, instance_id, arm, correct, CASE WHEN correct THEN 'success' WHEN toxic = 1 THEN 'toxic'
  ELSE 'low_quality' END AS failure_category FROM arms0),
oval AS (SELECT domain, instance_id, rn <= greatest(1, floor(0.2::DOUBLE * n)) AS is_validation FROM (
  SELECT domain, instance_id, count(*) OVER (PARTITION BY domain) AS n,
    row_number() OVER (PARTITION BY domain ORDER BY md5('0:' || instance_id), instance_id) AS rn FROM lab))"""


def sql_mix(word: str) -> str:
    """`hashing.mix_word` in SQL."""
    for factor, shift in zip(hashing.MULTIPLIERS, hashing.SHIFTS):
        word = f"(({word}) * {factor} & {hashing.WORD_MASK})"
        word = f"xor({word}, {word} >> {shift})"
    return word


def sql_means(name: str, source: str, group: str, replicates: int, seed: str = "0",
              ident: str = "instance_id") -> str:
    """CTEs ending in ``name``(group, b, mean) of bootstrap means of column v."""
    mask = hashing.WORD_MASK
    return f"""
{name}_r AS MATERIALIZED (SELECT {group}, v, i, n, {sql_mix('i')} AS slot,
  ('0x' || substr(md5(concat_ws(':', '{seed}', {group})), 1, 8))::BIGINT & {mask} AS k FROM (
  SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}:' || {ident}), {ident}) - 1 AS i,
    count(*) OVER (PARTITION BY {group}) AS n FROM {source})),
{name}_d AS (SELECT {group}, b, {sql_mix('word')} % n AS i FROM (
  SELECT {group}, b, n, xor(slot, {sql_mix(f"(k + b) & {mask}")}) AS word FROM {name}_r, range({replicates}) t(b))),
{name} AS (SELECT {group}, b, round(avg(v), 12) AS mean FROM {name}_d JOIN {name}_r USING ({group}, i) GROUP BY {group}, b)"""


SQL_CI = "round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high"
SQL_P_UNCAPPED = ("2 * least(avg(CASE WHEN mean <= 0 THEN 1.0::DOUBLE ELSE 0 END), "
                  "avg(CASE WHEN mean >= 0 THEN 1.0::DOUBLE ELSE 0 END))")
SQL_P = f"round(least(1.0::DOUBLE, {SQL_P_UNCAPPED}), 6) AS p_two_sided"
