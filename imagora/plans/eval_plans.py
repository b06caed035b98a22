"""Registered queries over the written run: metrics, routing, gating, packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from imagora.operators import gating, hypothesis, metrics, packs, ranking, routing, splits
from imagora.plans import eval_setup as es
from imagora.plans import vector_setup as vs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


def _r(name, digits=6, out=None):
    return F.round(F.col(f"`{name}`"), digits).alias(out or name)


# ------------------------------------------------------------------ metrics

def _per_instance(family):
    def build(spark, sf):
        long = metrics.to_long(es.scores(spark, sf), ["domain", "variant", "instance_id"])
        return long.filter(F.col("metric").startswith(family)).withColumn("value", F.round("value", 6))
    return build


for _name, _family in (("recall_at_k", "Recall"), ("ndcg_at_k", "nDCG")):
    _register(_name, es.SQL_SCORES + f"""
SELECT domain, variant, instance_id, metric, round(value, 6) AS value FROM ml
WHERE d <> 20 AND metric LIKE '{_family}%'""")(_per_instance(_family))

_SQL_GRID = """, grid AS (SELECT domain, variant, metric, count(*) AS n, avg(value) AS value FROM ml
  WHERE d <> 20 GROUP BY ALL)"""
_SQL_SPLIT = """, msplit AS (SELECT ml.*, unnest(['all', CASE WHEN is_validation THEN 'validation' ELSE 'test' END]) AS split
  FROM ml JOIN val USING (domain, instance_id) WHERE d <> 20),
gsplit AS (SELECT domain, variant, split, metric, count(*) AS n, avg(value) AS value FROM msplit GROUP BY ALL),
mm AS (SELECT '__all_micro__' AS domain, variant, split, metric, 'instances' AS unit, sum(n)::BIGINT AS n,
    sum(value * n) / sum(n) AS value FROM gsplit GROUP BY ALL
  UNION ALL SELECT '__all_macro__', variant, split, metric, 'domains', count(*), avg(value) FROM gsplit GROUP BY ALL)"""


def _grid(spark, sf):
    return metrics.mean_metrics(es.annotated_run(spark, sf), vs.gold(spark, sf), ["domain", "variant"])


@_register("metric_grid", es.SQL_SCORES + _SQL_GRID +
           " SELECT domain, variant, metric, n, round(value, 6) AS value FROM grid")
def metric_grid(spark, sf):
    return _grid(spark, sf).withColumn("value", F.round("value", 6))


def split_cells(spark, sf):
    """(domain, variant, split, metric, n, value)."""
    rows = metrics.with_splits(es.scores(spark, sf), es.validation(spark, sf).drop("domain"))
    names = [f"{f}@{d}" for d in metrics.DEPTHS for f in ("Recall", "nDCG")]
    means = rows.groupBy("domain", "variant", "split").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    return metrics.to_long(means, ["domain", "variant", "split", "n"])


@_register("metric_grid_splits", es.SQL_SCORES + _SQL_SPLIT +
           " SELECT domain, variant, split, metric, n, round(value, 6) AS value FROM gsplit")
def metric_grid_splits(spark, sf):
    return split_cells(spark, sf).withColumn("value", F.round("value", 6))


@_register("micro_macro", es.SQL_SCORES + _SQL_SPLIT +
           " SELECT domain, variant, split, metric, unit, n, round(value, 6) AS value FROM mm")
def micro_macro(spark, sf):
    return metrics.micro_macro(split_cells(spark, sf), ["variant", "split", "metric"]) \
        .withColumn("value", F.round("value", 6))


@_register("summary_nested", es.SQL_SCORES + _SQL_SPLIT + """
SELECT domain, variant, split, count(*) AS n_metrics,
  round(max(CASE WHEN metric = 'nDCG@10' THEN value END), 6) AS ndcg_at_10,
  round(max(CASE WHEN metric = 'Recall@50' THEN value END), 6) AS recall_at_50 FROM gsplit GROUP BY ALL""")
def summary_nested(spark, sf):
    nested = packs.nested_summary(split_cells(spark, sf), ["domain", "variant", "split"])
    return nested.select(
        "domain", "variant", "split", F.size("metrics").cast("bigint").alias("n_metrics"),
        F.round(F.element_at("metrics", "nDCG@10"), 6).alias("ndcg_at_10"),
        F.round(F.element_at("metrics", "Recall@50"), 6).alias("recall_at_50"))


@_register("metrics_at_20", es.SQL_SCORES + """
SELECT domain, variant, metric, count(*) AS n, round(avg(value), 6) AS value FROM ml WHERE d = 20 GROUP BY ALL""")
def metrics_at_20(spark, sf):
    return metrics.mean_metrics(es.annotated_run(spark, sf), vs.gold(spark, sf),
                                ["domain", "variant"], (20,)).withColumn("value", F.round("value", 6))


@_register("metric_pivot", es.SQL_SCORES + _SQL_GRID + """
SELECT domain, variant,
  coalesce(printf('%.4f', max(CASE WHEN metric = 'nDCG@10' THEN round(value, 4) END)), '—') AS ndcg_at_10,
  coalesce(printf('%.4f', max(CASE WHEN metric = 'Recall@10' THEN round(value, 4) END)), '—') AS recall_at_10,
  '—' AS ndcg_at_1000
FROM grid GROUP BY ALL""")
def metric_pivot(spark, sf):
    """Nothing is measured at 1000, which shows how a missing cell prints."""
    wide = packs.metric_pivot(_grid(spark, sf), ["domain", "variant"], ["nDCG@10", "Recall@10", "nDCG@1000"])
    return wide.withColumnsRenamed(
        {"nDCG@10": "ndcg_at_10", "Recall@10": "recall_at_10", "nDCG@1000": "ndcg_at_1000"})


# ------------------------------------------------------------------ sets and splits

@_register("validation_split", es.SQL_SCORES + " SELECT domain, instance_id, is_validation FROM val")
def validation_split(spark, sf):
    return es.build_validation(spark, sf)


@_register("split_test", es.SQL_SCORES + """
SELECT domain, instance_id FROM (SELECT DISTINCT domain, instance_id FROM uni)
EXCEPT SELECT domain, instance_id FROM val WHERE is_validation""")
def split_test(spark, sf):
    """All scored ids without the validation ids."""
    ids = es.scores(spark, sf).select("domain", "instance_id").distinct()
    val = es.validation(spark, sf).filter("is_validation").select("domain", "instance_id")
    return ids.join(val, ["domain", "instance_id"], "left_anti")


@_register("sample_ids", es.SQL_SCORES + """
SELECT domain, instance_id FROM (SELECT domain, instance_id,
  row_number() OVER (PARTITION BY domain ORDER BY md5('7:' || instance_id), instance_id) AS rn
  FROM (SELECT DISTINCT domain, instance_id FROM uni)) WHERE rn <= 10""")
def sample_ids(spark, sf):
    ids = es.scores(spark, sf).select("domain", "instance_id").distinct()
    return ranking.sample_per_group(ids, ["domain"], ["instance_id"], 10, seed=7)


@_register("common_support", es.SQL_SIGNALS + """
SELECT domain, instance_id FROM (
  SELECT domain, instance_id FROM routed WHERE instance_id NOT IN (SELECT instance_id FROM dec WHERE decision <> 'kept')
  INTERSECT SELECT domain, instance_id FROM run WHERE variant = 'fused'
  INTERSECT SELECT domain, instance_id FROM run WHERE variant = 'two_stage')""")
def common_support(spark, sf):
    """Ids present in the gated, the fused and the two-stage run alike."""
    gated = gating.apply_gate(es.routed(spark, sf), es.decisions(spark, sf)).withColumn(
        "variant", F.lit("gated"))
    cols = ["domain", "instance_id", "variant"]
    rows = gated.select(*cols).unionByName(
        vs.run(spark, sf).filter(F.col("variant").isin("fused", "two_stage")).select(*cols))
    return metrics.common_instances(rows.distinct(), ("domain",), "variant")


@_register("unique_candidates", vs.sql_run() + """
SELECT doc_id, count(DISTINCT variant) AS n_variants FROM run WHERE rank <= 3 GROUP BY 1""")
def unique_candidates(spark, sf):
    """Documents any variant ranks in its first three, to be encoded once."""
    return vs.run(spark, sf).filter("rank <= 3").groupBy("doc_id").agg(
        F.count_distinct("variant").alias("n_variants"))


# ------------------------------------------------------------------ routing

@_register("route_domain", es.SQL_ROUTER + """
SELECT domain, pick, round(best, 6) AS best, degenerate, n_val, n_variants FROM router""")
def route_domain(spark, sf):
    return es.build_router(spark, sf).withColumn("best", F.round("best", 6))


@_register("routed_run", es.SQL_ROUTER + """
SELECT domain, source_variant, instance_id, doc_id, round(score, 6) AS score, rank FROM routed""")
def routed_run(spark, sf):
    r = routing.routed_run(es.annotated_run(spark, sf), es.build_router(spark, sf))
    return r.select("domain", "source_variant", "instance_id", "doc_id",
                    F.round("score", 6).alias("score"), "rank")


@_register("routed_source_check", es.SQL_ROUTER + """
SELECT router.domain, pick, count(*) AS rows_compared, 0::BIGINT AS rows_different
FROM router JOIN routed USING (domain) GROUP BY ALL""")
def routed_source_check(spark, sf):
    """Per domain: the routed rows against the rows of their source variant."""
    cols = ["domain", "instance_id", "doc_id", "score", "rank"]
    r = es.router(spark, sf)
    routed = es.routed(spark, sf)
    source = es.annotated_run(spark, sf).join(
        r.select("domain", F.col("pick").alias("variant")), ["domain", "variant"])
    diff = routing.run_difference(routed, source, cols).groupBy("domain").agg(
        F.count(F.lit(1)).alias("rows_different"))
    size = routed.groupBy("domain").agg(F.count(F.lit(1)).alias("rows_compared"))
    return r.select("domain", "pick").join(size, "domain").join(diff, "domain", "left").withColumn(
        "rows_different", F.coalesce("rows_different", F.lit(0)))


_SQL_TEST = """, tsc AS (SELECT p.domain, p.variant, p.instance_id, p.nd FROM pi p JOIN val USING (domain, instance_id)
  WHERE d = 10 AND NOT is_validation)"""


def _test_scores(spark, sf):
    test = es.validation(spark, sf).filter("NOT is_validation").select("domain", "instance_id")
    return es.ndcg10(spark, sf).join(test, ["domain", "instance_id"])


@_register("route_l0_l1", es.SQL_ROUTER + _SQL_TEST + """
SELECT domain, variant AS level, round(avg(nd), 6) AS ndcg, count(*) AS n_test FROM tsc GROUP BY ALL
UNION ALL SELECT t.domain, 'champion', round(avg(nd), 6), count(*) FROM tsc t
  JOIN router r ON r.domain = t.domain AND r.pick = t.variant GROUP BY ALL""")
def route_l0_l1(spark, sf):
    test = _test_scores(spark, sf)
    picked = test.join(es.router(spark, sf).select("domain", F.col("pick").alias("variant")),
                       ["domain", "variant"]).withColumn("variant", F.lit("champion"))
    return test.unionByName(picked.select(*test.columns)).groupBy("domain", "variant").agg(
        F.round(F.avg("value"), 6).alias("ndcg"), F.count(F.lit(1)).alias("n_test")) \
        .withColumnRenamed("variant", "level")


@_register("route_l2a", es.SQL_ROUTER + """,
agr AS (SELECT g.instance_id, coalesce(avg(list_dot_product(a.v, b.v)), 1.0) AS agreement
  FROM (SELECT DISTINCT instance_id FROM samp WHERE template = 'skill') g
  JOIN samp a ON a.instance_id = g.instance_id AND a.template = 'skill'
  LEFT JOIN samp b ON b.instance_id = a.instance_id AND b.template = 'skill' AND b.sample_index > a.sample_index
  GROUP BY 1),
wide AS (SELECT v.domain, v.instance_id, v.is_validation, round(a.agreement * 1e6)::BIGINT AS a6,
    max(CASE WHEN p.variant = 'hypo_skill' THEN p.nd END) AS s, max(CASE WHEN p.variant = 'fused' THEN p.nd END) AS f
  FROM val v JOIN agr a USING (instance_id) JOIN pi p ON p.instance_id = v.instance_id AND p.d = 10
  GROUP BY ALL),
cand AS (SELECT DISTINCT domain, floor((a6 + 500) / 1000.0) AS c FROM wide WHERE is_validation),
vm AS (SELECT w.domain, c.c, round(avg(CASE WHEN floor(w.a6 / 1000.0) >= c.c THEN w.s ELSE w.f END), 10) AS m
  FROM wide w JOIN cand c USING (domain) WHERE w.is_validation GROUP BY ALL),
best AS (SELECT domain, first(c ORDER BY m DESC, c) AS c FROM vm GROUP BY 1)
SELECT w.domain, b.c / 1000.0::DOUBLE AS tau, count(*) AS n_test,
  round(avg(CASE WHEN floor(w.a6 / 1000.0) >= b.c THEN w.s ELSE w.f END), 6) AS ndcg,
  round(avg(CASE WHEN floor(w.a6 / 1000.0) >= b.c THEN 0.0 ELSE 1.0 END), 6) AS fusion_share
FROM wide w JOIN best b USING (domain) WHERE NOT w.is_validation GROUP BY ALL""")
def route_l2a(spark, sf):
    agree = hypothesis.agreement(vs.samples(spark, sf, ("skill",)), vs.K).select("instance_id", "agreement")
    wide = es.ndcg10(spark, sf).groupBy("domain", "instance_id").agg(
        F.max(F.when(F.col("variant") == "hypo_skill", F.col("value"))).alias("single"),
        F.max(F.when(F.col("variant") == "fused", F.col("value"))).alias("fusion"))
    rows = wide.join(agree, "instance_id").join(es.validation(spark, sf), ["domain", "instance_id"])
    tau = routing.difficulty_thresholds(rows, "single", "fusion")
    single = routing.takes_single(F.col("agreement"), F.col("tau_cell"))
    return rows.filter("NOT is_validation").join(tau, "domain").groupBy("domain", "tau").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.round(F.avg(F.when(single, F.col("single")).otherwise(F.col("fusion"))), 6).alias("ndcg"),
        F.round(F.avg(F.when(single, F.lit(0.0)).otherwise(F.lit(1.0))), 6).alias("fusion_share"))


def _judge(depth):
    def build(spark, sf):
        judged = routing.judge_scores(es.annotated_run(spark, sf), es.skill_centroids(spark, sf),
                                      vs.full_vectors(spark, sf), depth)
        picks = routing.pick_per_instance(judged, "judge", routing.LOOSE_ORDER)
        test = _test_scores(spark, sf)
        return test.join(picks.select("domain", "instance_id", F.col("pick").alias("variant")),
                         ["domain", "instance_id", "variant"]).groupBy("domain", "variant").agg(
            F.count(F.lit(1)).alias("picked"), F.round(F.sum("value"), 6).alias("ndcg_sum"))
    return build


def _sql_judge(depth):
    return es.SQL_ROUTER + _SQL_TEST + f""",
jd AS (SELECT r.domain, r.instance_id, r.variant,
    sum(list_dot_product(c.v, e.v) / log2(r.rank + 1)) / sum(1 / log2(r.rank + 1)) AS judge
  FROM run r JOIN cent c ON c.instance_id = r.instance_id AND c.template = 'skill' JOIN e ON e.vec_id = r.doc_id
  WHERE r.rank <= {depth} AND r.instance_id IN (SELECT instance_id FROM samp WHERE template = 'skill') GROUP BY ALL),
pk AS (SELECT domain, instance_id, first(variant ORDER BY round(judge, 10) DESC, o) AS variant
  FROM jd JOIN ord USING (variant) GROUP BY ALL)
SELECT t.domain, t.variant, count(*) AS picked, round(sum(nd), 6) AS ndcg_sum
FROM tsc t JOIN pk USING (domain, instance_id, variant) GROUP BY ALL"""


for _d in (1, 3):
    _register(f"route_l2b{_d}", _sql_judge(_d))(_judge(_d))


@_register("route_oracle", es.SQL_ROUTER + _SQL_TEST + """,
b AS (SELECT domain, instance_id, max(nd) AS nd FROM tsc GROUP BY ALL),
m AS (SELECT domain, avg(nd) AS nd FROM b GROUP BY 1)
SELECT domain, round(nd, 6) AS ndcg FROM m UNION ALL SELECT '__all_macro__', round(avg(nd), 6) FROM m""")
def route_oracle(spark, sf):
    best = _test_scores(spark, sf).groupBy("domain", "instance_id").agg(F.max("value").alias("value"))
    per = best.groupBy("domain").agg(F.avg("value").alias("ndcg"))
    macro = per.agg(F.avg("ndcg").alias("ndcg")).select(F.lit(metrics.MACRO).alias("domain"), "ndcg")
    return per.unionByName(macro).withColumn("ndcg", F.round("ndcg", 6))


# ------------------------------------------------------------------ gating

@_register("gate_s1", es.SQL_SIGNALS + " SELECT domain, instance_id, top1, s1, top1_wrong FROM signals")
def gate_s1(spark, sf):
    return es.signals(spark, sf).select("domain", "instance_id", "top1", "s1", "top1_wrong")


@_register("gate_s2", es.SQL_SIGNALS + " SELECT domain, instance_id, top1, s2 FROM signals")
def gate_s2(spark, sf):
    return es.signals(spark, sf).select("domain", "instance_id", "top1", "s2")


@_register("pick_tau", es.SQL_SIGNALS + """
SELECT domain, p_min, max(CASE WHEN cp / i >= p_min THEN s1 END) AS tau FROM (SELECT domain, s1, p_min,
    sum((NOT top1_wrong)::INT) OVER w AS cp, row_number() OVER w AS i
  FROM signals, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) p(p_min)
  WINDOW w AS (PARTITION BY domain, p_min ORDER BY s1 DESC, NOT top1_wrong ROWS UNBOUNDED PRECEDING))
GROUP BY ALL""".replace("ORDER BY s1 DESC", "ORDER BY -s1").replace("THEN s1 END", "THEN -s1 END"))
def pick_tau(spark, sf):
    """Thresholds on -S1 for a right top document, at three precisions."""
    sig = es.signals(spark, sf).withColumn("value", -F.col("s1")).withColumn("ok", ~F.col("top1_wrong"))
    out = None
    for p in (0.3, 0.5, 0.9):
        one = gating.pick_tau(sig, ["domain"], "value", "ok", p).withColumn("p_min", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


@_register("gate_calibrate", es.SQL_SIGNALS + """
SELECT t.domain, t.tau1, t.tau2, t.n_val, count(CASE WHEN s1 < t.tau1 THEN 1 END) AS would_block,
  count(CASE WHEN s2 < t.tau2 THEN 1 END) AS would_skip
FROM taus t JOIN signals s USING (domain) GROUP BY ALL""")
def gate_calibrate(spark, sf):
    return es.signals(spark, sf).join(es.taus(spark, sf), "domain").groupBy(
        "domain", "tau1", "tau2", "n_val").agg(
        F.count_if(F.col("s1") < F.col("tau1")).alias("would_block"),
        F.count_if(F.col("s2") < F.col("tau2")).alias("would_skip"))


@_register("gate_apply", es.SQL_SIGNALS + """
SELECT domain, instance_id, doc_id, rank FROM routed
WHERE instance_id NOT IN (SELECT instance_id FROM dec WHERE decision <> 'kept')""")
def gate_apply(spark, sf):
    return gating.apply_gate(es.routed(spark, sf), es.decisions(spark, sf)).select(
        "domain", "instance_id", "doc_id", "rank")


@_register("gate_stats", es.SQL_SIGNALS + """
SELECT domain, count(CASE WHEN decision = 'blocked' THEN 1 END) AS blocked,
  count(CASE WHEN decision = 'skipped' THEN 1 END) AS skipped, count(CASE WHEN decision = 'kept' THEN 1 END) AS kept,
  round(avg(CASE WHEN decision = 'blocked' THEN top1_wrong::INT::DOUBLE END), 6) AS block_precision
FROM dec GROUP BY 1""")
def gate_stats(spark, sf):
    return gating.gate_counts(es.decisions(spark, sf)).withColumn(
        "block_precision", F.round("block_precision", 6))


@_register("gating_wide", es.SQL_SIGNALS + """
SELECT d.domain, d.instance_id, d.top1, d.s1, d.s2, d.top1_wrong, d.tau1, d.tau2, d.decision <> 'kept' AS gate_blocked,
  coalesce(is_validation, false) AS in_calibration_split,
  bool_or(CASE WHEN arm = 'bare' THEN correct END) AS correct_bare,
  bool_or(CASE WHEN arm = 'always' THEN correct END) AS correct_always,
  bool_or(CASE WHEN arm = 'gated' THEN correct END) AS correct_gated
FROM dec d LEFT JOIN val USING (domain, instance_id) LEFT JOIN outc o USING (domain, instance_id) GROUP BY ALL""")
def gating_wide(spark, sf):
    d = es.decisions(spark, sf).withColumn("gate_blocked", F.col("decision") != "kept").drop("decision")
    val = es.validation(spark, sf).withColumnRenamed("is_validation", "in_calibration_split")
    arms = es.outcomes(spark, sf).groupBy("domain", "instance_id").pivot(
        "arm", ["bare", "always", "gated"]).agg(F.bool_or("correct"))
    arms = arms.withColumnsRenamed({a: f"correct_{a}" for a in ("bare", "always", "gated")})
    return d.join(val, ["domain", "instance_id"], "left").withColumn(
        "in_calibration_split", F.coalesce("in_calibration_split", F.lit(False))) \
        .join(arms, ["domain", "instance_id"], "left")


_SQL_LOAD = """, loads AS (
  SELECT domain, 'bare' AS arm, instance_id, NULL::BIGINT AS doc_id FROM dec
  UNION ALL SELECT domain, 'always', instance_id, top1 FROM dec
  UNION ALL SELECT domain, 'gated', instance_id, CASE WHEN decision = 'kept' THEN top1 END FROM dec
  UNION ALL SELECT d.domain, 'oracle', d.instance_id, g.doc_id FROM dec d JOIN gold g USING (instance_id)),
lrec AS (SELECT l.domain, l.arm, l.instance_id, count(l.doc_id) AS n_loaded, min(l.doc_id) AS first_loaded,
    CASE WHEN count(l.doc_id) = 0 THEN NULL WHEN count(g.doc_id) > 0 THEN 1 ELSE 0 END AS hit
  FROM loads l LEFT JOIN gold g ON g.instance_id = l.instance_id AND g.doc_id = l.doc_id GROUP BY ALL)"""


def _loading(spark, sf):
    return packs.loading_arms(es.decisions(spark, sf), vs.gold(spark, sf))


@_register("loading_arms", es.SQL_SIGNALS + _SQL_LOAD +
           " SELECT domain, arm, instance_id, n_loaded, first_loaded, hit FROM lrec")
def loading_arms(spark, sf):
    return packs.loading_records(_loading(spark, sf), vs.gold(spark, sf)).select(
        "domain", "arm", "instance_id", F.size("loaded").cast("bigint").alias("n_loaded"),
        F.array_min("loaded").alias("first_loaded"), "hit")


@_register("loading_hit_rate", es.SQL_SIGNALS + _SQL_LOAD + """
SELECT domain, arm, count(*) AS n, count(hit) AS n_loaded, round(avg(hit), 6) AS hit_rate FROM lrec GROUP BY ALL""")
def loading_hit_rate(spark, sf):
    recs = packs.loading_records(_loading(spark, sf), vs.gold(spark, sf))
    return recs.groupBy("domain", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_loaded"),
        F.round(F.avg("hit"), 6).alias("hit_rate"))


@_register("loading_separation", es.SQL_SIGNALS + """
SELECT d.domain, (d.instance_id IN (SELECT r.instance_id FROM routed r JOIN gold USING (instance_id, doc_id))) AS gold_in_candidates,
  count(*) AS n, round(avg(CASE WHEN decision = 'kept' THEN 1.0::DOUBLE ELSE 0 END), 6) AS loading_rate
FROM dec d GROUP BY ALL""")
def loading_separation(spark, sf):
    """How often the gate loads, with the gold document in reach and without."""
    reach = es.routed(spark, sf).join(vs.gold(spark, sf), ["instance_id", "doc_id"]).select(
        "instance_id").distinct().withColumn("gold_in_candidates", F.lit(True))
    return es.decisions(spark, sf).join(reach, "instance_id", "left").withColumn(
        "gold_in_candidates", F.coalesce("gold_in_candidates", F.lit(False))) \
        .groupBy("domain", "gold_in_candidates").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("decision") == "kept").cast("double")), 6).alias("loading_rate"))


# ------------------------------------------------------------------ packs

def _sql_pack(depth):
    return es.SQL_SCORES + f""",
p AS (SELECT r.domain, r.variant, r.instance_id, count(*) AS n_hits, count(g.doc_id) AS n_gold_hits,
    string_agg(r.doc_id || ':' || (CASE WHEN g.doc_id IS NULL THEN '0' ELSE '1' END), ',' ORDER BY r.rank) AS hits
  FROM run r JOIN ng USING (instance_id) LEFT JOIN gold g ON g.instance_id = r.instance_id AND g.doc_id = r.doc_id
  WHERE r.rank <= {depth} GROUP BY ALL)
SELECT p.*, round(pi.nd, 4) AS ndcg10 FROM p JOIN pi ON pi.variant = p.variant AND pi.instance_id = p.instance_id AND pi.d = 10"""


def _pack(depth):
    def build(spark, sf):
        pack = packs.top_pack(es.annotated_run(spark, sf), vs.gold(spark, sf), depth,
                              ("domain", "variant"))
        flat = F.array_join(F.transform("hits", lambda h: F.concat(
            h["doc_id"].cast("string"), F.lit(":"), h["is_gold"].cast("int").cast("string"))), ",")
        return pack.join(es.ndcg10(spark, sf), ["domain", "variant", "instance_id"]).select(
            "domain", "variant", "instance_id", F.size("hits").cast("bigint").alias("n_hits"),
            F.size(F.filter("hits", lambda h: h["is_gold"])).cast("bigint").alias("n_gold_hits"),
            flat.alias("hits"), F.round("value", 4).alias("ndcg10"))
    return build


for _d in (10, 50):
    _register(f"pack_top{_d}", _sql_pack(_d))(_pack(_d))


@_register("router_decisions", es.SQL_ROUTER + """
SELECT r.domain, r.pick, r.n_val, r.degenerate, 0.2::DOUBLE AS val_fraction, 0 AS seed,
  string_agg(v.variant || '=' || printf('%.4f', round(v.score, 4)), ',' ORDER BY v.variant) AS scores
FROM router r JOIN vsc v USING (domain) GROUP BY ALL""")
def router_decisions(spark, sf):
    rec = packs.router_records(es.router(spark, sf), routing.variant_scores(
        es.ndcg10(spark, sf), es.validation(spark, sf)), splits.VAL_FRACTION, splits.VAL_SEED)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.concat(
        e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    return rec.withColumn("scores", text)


@_register("metrics_flat", es.SQL_SIGNALS + _SQL_GRID + """
SELECT domain, variant AS method, metric, round(value, 5) AS value FROM grid
UNION ALL SELECT domain, 'arm:' || arm, 'accuracy', round(avg(correct::INT), 5) FROM outc GROUP BY domain, arm
UNION ALL SELECT domain, 'arm:' || arm, 'n', count(*)::DOUBLE FROM outc GROUP BY domain, arm""")
def metrics_flat(spark, sf):
    return packs.metrics_flat(_grid(spark, sf), es.outcomes(spark, sf))


@_register("model_summary", es.SQL_SIGNALS + """
SELECT p.domain, p.variant, round(avg(p.nd), 6) AS ndcg10, any_value(r.pick) AS pick, any_value(r.degenerate) AS degenerate,
  any_value(t.tau1) AS tau1, any_value(t.tau2) AS tau2,
  any_value((SELECT count(*) FROM dec d WHERE d.domain = p.domain AND decision = 'blocked')) AS blocked,
  any_value((SELECT count(*) FROM dec d WHERE d.domain = p.domain AND decision = 'kept')) AS kept,
  any_value((SELECT round(avg(correct::INT), 6) FROM outc o WHERE o.domain = p.domain AND arm = 'gated')) AS gated_accuracy
FROM pi p JOIN router r USING (domain) LEFT JOIN taus t USING (domain) WHERE p.d = 10 GROUP BY ALL""")
def model_summary(spark, sf):
    rec = packs.model_summary(
        es.ndcg10(spark, sf), es.router(spark, sf), es.taus(spark, sf),
        gating.gate_counts(es.decisions(spark, sf)), es.outcomes(spark, sf))
    return rec.select(
        "domain", F.explode("ndcg10").alias("variant", "ndcg10"), "pick", "degenerate", "tau1", "tau2",
        "blocked", "kept", F.round(F.element_at("accuracy", "gated"), 6).alias("gated_accuracy")) \
        .withColumn("ndcg10", F.round("ndcg10", 6))
