"""Shared steps after retrieval: scores, splits, router, signals, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.functions import vector as vx
from imagora.operators import gating, hypothesis, metrics, routing, sizing, splits
from imagora.plans import vector_setup as vs
from imagora.plans.tables import staged

CHUNKS = ((1, 16), (17, 16), (33, 16), (49, 16))


def annotated_run(spark: SparkSession, sf: str) -> DataFrame:
    """The run without queries that have no gold document."""
    known = vs.gold(spark, sf).select("instance_id").distinct()
    return vs.run(spark, sf).join(sizing.checked_broadcast(known), "instance_id", "left_semi")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(domain, variant, instance_id, Recall@d..., nDCG@d...), written once."""
    return staged(spark, sf, "vector_scores", lambda: metrics.per_instance_wide(
        annotated_run(spark, sf), vs.gold(spark, sf), ("domain", "variant")))


def ndcg10(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("domain", "variant", "instance_id",
                                    F.col("`nDCG@10`").alias("value"))


def build_validation(spark: SparkSession, sf: str) -> DataFrame:
    ids = metrics.common_instances(scores(spark, sf), ("domain",), "variant")
    return splits.validation_split(ids)


def validation(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded split, written once."""
    return staged(spark, sf, "validation", lambda: build_validation(spark, sf))


def build_router(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route(ndcg10(spark, sf), validation(spark, sf))


def router(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded decisions, written once."""
    return staged(spark, sf, "router", lambda: build_router(spark, sf))


def routed(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "routed_run", lambda: routing.routed_run(
        annotated_run(spark, sf), router(spark, sf)))


def skill_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of queries that have at least one skill sample."""
    return hypothesis.centroid_with_query(
        vs.samples(spark, sf, ("skill",)), vs.queries(spark, sf), vs.K).filter("n_samples > 0")


def chunks(vec) -> F.Column:
    return F.array(*[vx.normalize(F.slice(vec, s, n)) for s, n in CHUNKS])


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """(domain, instance_id, top1, s1, s2, top1_wrong) of the routed run, written
    once. Vector chunks stand in for sentences."""
    def build() -> DataFrame:
        first = gating.top1(routed(spark, sf)).select("domain", "instance_id", "top1")
        s1 = gating.coverage(first, skill_centroids(spark, sf), vs.full_vectors(spark, sf))
        cand = first.join(vs.full_vectors(spark, sf).withColumnRenamed("doc_id", "top1"), "top1") \
            .select("instance_id", chunks(F.col("vec")).alias("cand"))
        # at most K samples per query
        hyp = vs.samples(spark, sf, ("skill",)).groupBy("instance_id").agg(
            F.sort_array(F.collect_list(F.struct("sample_index", "vec"))).alias("ss")) \
            .select("instance_id", F.flatten(F.transform("ss", lambda s: chunks(s["vec"]))).alias("hyp"))
        s2 = cand.join(hyp, "instance_id").select(
            "instance_id", gating.novelty(F.col("cand"), F.col("hyp")).alias("s2"))
        right = vs.gold(spark, sf).select("instance_id", F.col("doc_id").alias("top1"),
                                          F.lit(False).alias("top1_wrong"))
        return first.join(s1, "instance_id").join(s2, "instance_id").join(
            right, ["instance_id", "top1"], "left").withColumn(
            "top1_wrong", F.coalesce("top1_wrong", F.lit(True)))
    return staged(spark, sf, "signals", build)


def bare(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of the arm that loads nothing: sign of the first element."""
    return vs.items(spark, sf).select(F.col("vec_id").alias("instance_id"),
                                      (F.get("vec", F.lit(0)) > 0).alias("correct"))


def taus(spark: SparkSession, sf: str) -> DataFrame:
    return gating.calibrate(signals(spark, sf), validation(spark, sf), bare(spark, sf), P_MIN)


# the sign-based bare arm is right half the time, which 0.9 would never reach
P_MIN = 0.6


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return gating.decide(signals(spark, sf), taus(spark, sf))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """(domain, instance_id, arm, correct) of instances with a signal."""
    d = decisions(spark, sf).join(bare(spark, sf), "instance_id")
    right = ~F.col("top1_wrong")
    arms = F.array(
        F.struct(F.lit("bare").alias("arm"), F.col("correct").alias("correct")),
        F.struct(F.lit("always").alias("arm"), right.alias("correct")),
        F.struct(F.lit("gated").alias("arm"),
                 F.when(F.col("decision") == "kept", right).otherwise(F.col("correct")).alias("correct")))
    return d.select("domain", "instance_id", F.explode(arms).alias("a")).select(
        "domain", "instance_id", "a.arm", "a.correct")


# ------------------------------------------------------------------ oracle SQL

SQL_SCORES = vs.sql_run() + """,
ng AS (SELECT instance_id, count(*) AS n FROM gold GROUP BY 1),
hit AS (SELECT r.variant, r.instance_id, r.rank FROM run r JOIN gold USING (instance_id, doc_id)),
uni AS (SELECT DISTINCT domain, variant, instance_id FROM run JOIN ng USING (instance_id)),
idl AS (SELECT n, d, (SELECT sum(1 / log2(i + 1)) FROM range(1, 60) r(i) WHERE i <= least(n, d)) AS ideal
        FROM (SELECT DISTINCT n FROM ng), (VALUES (1), (5), (10), (20), (50)) t(d)),
pi AS (SELECT u.domain, u.variant, u.instance_id, idl.d, count(h.rank) / any_value(ng.n) AS rec,
         coalesce(sum(1 / log2(h.rank + 1)), 0) / any_value(idl.ideal) AS nd
       FROM uni u JOIN ng USING (instance_id) JOIN idl USING (n)
       LEFT JOIN hit h ON h.variant = u.variant AND h.instance_id = u.instance_id AND h.rank <= idl.d
       GROUP BY u.domain, u.variant, u.instance_id, idl.d),
ml AS (SELECT domain, variant, instance_id, 'Recall@' || d AS metric, d, rec AS value FROM pi
       UNION ALL SELECT domain, variant, instance_id, 'nDCG@' || d, d, nd FROM pi),
val AS (SELECT domain, instance_id, rn <= greatest(1, floor(0.2::DOUBLE * n)) AS is_validation FROM (
          SELECT domain, instance_id, count(*) OVER (PARTITION BY domain) AS n,
            row_number() OVER (PARTITION BY domain ORDER BY md5('0:' || instance_id), instance_id) AS rn
          FROM (SELECT DISTINCT domain, instance_id FROM uni)))"""

SQL_ROUTER = SQL_SCORES + """,
ord(variant, o) AS (VALUES ('hypo_skill', 1), ('hypo_passage', 2), ('hypo_sentence', 3), ('fused', 4), ('two_stage', 5)),
vsc AS (SELECT domain, variant, avg(nd) AS score, count(*) AS n_val FROM pi JOIN val USING (domain, instance_id)
        WHERE is_validation AND d = 10 GROUP BY ALL),
router AS (SELECT domain, CASE WHEN max(score) <= 0 THEN 'hypo_skill'
             ELSE first(variant ORDER BY round(score, 10) DESC, o) END AS pick,
             max(score) AS best, max(score) <= 0 AS degenerate, max(n_val) AS n_val, count(*) AS n_variants
           FROM vsc JOIN ord USING (variant) GROUP BY 1),
routed AS (SELECT r.domain, r.variant AS source_variant, r.instance_id, r.doc_id, r.score, r.rank
           FROM run r JOIN router t ON t.domain = r.domain AND t.pick = r.variant JOIN ng USING (instance_id))"""


def sql_chunks(v: str) -> str:
    return "[" + ", ".join(vs.sql_norm(f"({v})[{s}:{s + n - 1}]") for s, n in CHUNKS) + "]"


SQL_SIGNALS = SQL_ROUTER + f""",
t1 AS (SELECT domain, instance_id, doc_id AS top1 FROM routed WHERE rank = 1),
cch AS (SELECT t1.instance_id, unnest([1, 2, 3, 4]) AS cp, unnest({sql_chunks('e.v')}) AS c
        FROM t1 JOIN e ON e.vec_id = t1.top1),
hch AS (SELECT instance_id, unnest({sql_chunks('v')}) AS h FROM samp WHERE template = 'skill'),
mx AS (SELECT instance_id, cp, max(list_dot_product(c, h)) AS sim FROM cch JOIN hch USING (instance_id) GROUP BY ALL),
s2 AS (SELECT instance_id, round(avg(CASE WHEN round(sim, 9) < 0.6 THEN 1.0::DOUBLE ELSE 0 END), 4) AS s2 FROM mx GROUP BY 1),
signals AS (SELECT t1.domain, t1.instance_id, t1.top1, round(list_dot_product(c.v, e.v), 4) AS s1, s2.s2,
              g.doc_id IS NULL AS top1_wrong
            FROM t1 JOIN cent c ON c.instance_id = t1.instance_id AND c.template = 'skill'
            JOIN e ON e.vec_id = t1.top1 JOIN s2 ON s2.instance_id = t1.instance_id
            LEFT JOIN gold g ON g.instance_id = t1.instance_id AND g.doc_id = t1.top1),
bare AS (SELECT vec_id AS instance_id, v[1] > 0 AS correct FROM e),
vsig AS (SELECT s.*, b.correct FROM signals s JOIN val USING (domain, instance_id) JOIN bare b USING (instance_id)
         WHERE is_validation),
tau1 AS (SELECT domain, max(CASE WHEN cp / i >= {P_MIN}::DOUBLE THEN s1 END) AS tau1 FROM (SELECT domain, s1,
    sum(top1_wrong::INT) OVER w AS cp, row_number() OVER w AS i FROM vsig
    WINDOW w AS (PARTITION BY domain ORDER BY s1, top1_wrong ROWS UNBOUNDED PRECEDING)) GROUP BY 1),
tau2 AS (SELECT domain, max(CASE WHEN cp / i >= {P_MIN}::DOUBLE THEN s2 END) AS tau2 FROM (SELECT domain, s2,
    sum(correct::INT) OVER w AS cp, row_number() OVER w AS i FROM vsig
    WINDOW w AS (PARTITION BY domain ORDER BY s2, correct ROWS UNBOUNDED PRECEDING)) GROUP BY 1),
taus AS (SELECT domain, tau1, tau2, n_val FROM (SELECT domain, count(*) AS n_val FROM vsig GROUP BY 1)
         LEFT JOIN tau1 USING (domain) LEFT JOIN tau2 USING (domain)),
dec AS (SELECT s.*, tau1, tau2, CASE WHEN s1 < tau1 THEN 'blocked' WHEN s2 < tau2 THEN 'skipped' ELSE 'kept' END AS decision
        FROM signals s LEFT JOIN taus USING (domain)),
outc AS (SELECT domain, instance_id, 'bare' AS arm, correct FROM dec JOIN bare USING (instance_id)
  UNION ALL SELECT domain, instance_id, 'always', NOT top1_wrong FROM dec
  UNION ALL SELECT domain, instance_id, 'gated', CASE WHEN decision = 'kept' THEN NOT top1_wrong ELSE correct END
    FROM dec JOIN bare USING (instance_id))"""
