"""Registered queries over K runs, arms and the models x domains matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from imagora.operators import checks, cost, metrics, resample
from imagora.plans import ablation_setup as ab
from imagora.plans import eval_setup as es
from imagora.plans import vector_setup as vs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
REPLICATES = 10_000


def _register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


def _round(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


# ------------------------------------------------------------------ roll-ups

@_register("pick_counts", ab.SQL_K + "\nSELECT k_samples, " + ", ".join(
    f"count(CASE WHEN pick = '{v}' THEN 1 END) AS {v}" for v in vs.VARIANTS) + " FROM krt GROUP BY 1")
def pick_counts(spark, sf):
    return ab.k_router(spark, sf).groupBy("k_samples").pivot("pick", list(vs.VARIANTS)).agg(
        F.count(F.lit(1))).na.fill(0)


@_register("k_matrix", ab.SQL_K + """,
sp AS (SELECT kar.*, unnest(['all', CASE WHEN is_validation THEN 'validation' ELSE 'test' END]) AS split
  FROM kar JOIN kval USING (domain, instance_id) WHERE d IN (1, 5, 10, 50)),
cell AS (SELECT k_samples, domain, variant, split, d, count(*) AS n, avg(rec) AS rec, avg(nd) AS nd FROM sp GROUP BY ALL),
long AS (SELECT k_samples, domain, variant, split, 'Recall@' || d AS metric, n, rec AS value FROM cell
  UNION ALL SELECT k_samples, domain, variant, split, 'nDCG@' || d, n, nd FROM cell)
SELECT k_samples, domain, variant, split, metric, 'instances' AS unit, n, round(value, 6) AS value FROM long
UNION ALL SELECT k_samples, '__all_micro__', variant, split, metric, 'instances', sum(n)::BIGINT, round(sum(value * n) / sum(n), 6)
  FROM long GROUP BY ALL
UNION ALL SELECT k_samples, '__all_macro__', variant, split, metric, 'domains', count(*), round(avg(value), 6) FROM long GROUP BY ALL""")
def k_matrix(spark, sf):
    """Every K, domain (and both roll-ups), variant (and routed), split and metric."""
    keys = ["k_samples", "domain", "variant", "split"]
    rows = metrics.with_splits(ab.k_metrics_with_routed(spark, sf), ab.k_validation(spark, sf))
    names = [f"{family}@{d}" for d in metrics.DEPTHS for family in ("Recall", "nDCG")]
    means = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"`{m}`")).alias(m) for m in names])
    cells = metrics.to_long(means, [*keys, "n"]).withColumn("unit", F.lit("instances"))
    both = metrics.micro_macro(cells, ["k_samples", "variant", "split", "metric"])
    return _round(cells.unionByName(both), "value")


@_register("k_curve", ab.SQL_K + """,
m AS (SELECT variant, k_samples, avg(value) AS value FROM ksr GROUP BY ALL)
SELECT variant, round(max(CASE WHEN k_samples = 1 THEN value END), 6) AS k1, round(max(CASE WHEN k_samples = 2 THEN value END), 6) AS k2,
  round(max(CASE WHEN k_samples = 4 THEN value END), 6) AS k4, round(max(CASE WHEN k_samples = 8 THEN value END), 6) AS k8,
  round(max(CASE WHEN k_samples = 10 THEN value END), 6) AS k10,
  first(k_samples ORDER BY round(value, 10) DESC, k_samples) AS best_k FROM m GROUP BY 1""")
def k_curve(spark, sf):
    means = ab.k_scores_with_routed(spark, sf).groupBy("variant", "k_samples").agg(
        F.avg("value").alias("value"))
    best = means.groupBy("variant").agg(F.max_by(
        "k_samples", F.struct(F.round("value", 10), -F.col("k_samples"))).alias("best_k"))
    wide = means.groupBy("variant").pivot("k_samples", list(vs.K_VALUES)).agg(F.round(F.max("value"), 6))
    return wide.withColumnsRenamed({str(k): f"k{k}" for k in vs.K_VALUES}).join(best, "variant")


@_register("fleet_metrics", f"""WITH {ab.SQL_TRADE},
r AS (SELECT model, domain, k_samples, variant, n, value, unit FROM cells
  UNION ALL SELECT model, '__all_micro__', k_samples, variant, sum(n)::BIGINT, sum(value * n) / sum(n), 'instances' FROM cells GROUP BY model, k_samples, variant
  UNION ALL SELECT model, '__all_macro__', k_samples, variant, count(*), avg(value), 'domains' FROM cells GROUP BY model, k_samples, variant)
SELECT domain, k_samples, variant, sum(n)::BIGINT AS n, count(DISTINCT unit) AS units,
  CASE WHEN domain = '__all_macro__' THEN 'model_domains' ELSE 'model_instances' END AS unit,
  round(CASE WHEN domain = '__all_macro__' THEN avg(value) ELSE sum(value * n) / sum(n) END, 6) AS value
FROM r GROUP BY domain, k_samples, variant""")
def fleet_metrics(spark, sf):
    cells = ab.cells(spark, sf)
    extra = metrics.micro_macro(cells, ["model", "k_samples", "variant"])
    return _round(metrics.fleet_rollup(cells.unionByName(extra), ["k_samples", "variant"]), "value")


@_register("leaderboard", f"""WITH {ab.SQL_TRADE},
c AS (SELECT model, domain, method, avg(price) AS value FROM trade GROUP BY ALL),
m AS (SELECT method, count(*) AS cells, round(avg(value), 9) AS value FROM c GROUP BY 1
  HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT model, domain FROM c)))
SELECT method, cells, round(value, 6) AS value, rank() OVER (ORDER BY value DESC) AS rank FROM m""")
def leaderboard(spark, sf):
    c = ab.trade(spark, sf).groupBy("model", "domain", "method").agg(F.avg("price").alias("value"))
    return _round(metrics.leaderboard(c), "value")


@_register("arm_accuracy", f"""WITH {ab.SQL_OUT},
s AS (SELECT arms.*, unnest(['full', CASE WHEN is_validation THEN NULL ELSE 'heldout' END]) AS split FROM arms JOIN oval USING (domain, instance_id)),
g AS (SELECT arm, split, domain, count(*) AS n, count(CASE WHEN correct THEN 1 END) AS correct,
    count(CASE WHEN failure_category = 'toxic' THEN 1 END) AS toxic,
    count(CASE WHEN failure_category = 'low_quality' THEN 1 END) AS low_quality FROM s WHERE split IS NOT NULL
  GROUP BY GROUPING SETS ((arm, split, domain), (arm, split)))
SELECT arm, split, coalesce(domain, '__pooled__') AS domain, n, correct, toxic, low_quality, round(correct / n, 6) AS accuracy FROM g""")
def arm_accuracy(spark, sf):
    flag = ab.outcome_split(spark, sf)
    rows = ab.outcomes(spark, sf).join(flag, ["domain", "instance_id"]).withColumn(
        "split", F.explode(F.when(F.col("is_validation"), F.array(F.lit("full")))
                           .otherwise(F.array(F.lit("full"), F.lit("heldout")))))
    cat = F.col("failure_category")
    return rows.groupingSets(
        [["arm", "split", "domain"], ["arm", "split"]], "arm", "split", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"),
        F.count_if(cat == "toxic").alias("toxic"), F.count_if(cat == "low_quality").alias("low_quality"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")) \
        .withColumn("domain", F.coalesce("domain", F.lit("__pooled__")))


@_register("arm_delta", f"""WITH {ab.SQL_OUT},
a AS (SELECT domain, avg(CASE WHEN arm = 'bare' THEN correct::INT END) AS bare, avg(CASE WHEN arm = 'always' THEN correct::INT END) AS always,
  avg(CASE WHEN arm = 'gated' THEN correct::INT END) AS gated FROM arms GROUP BY 1)
SELECT domain, round(bare, 6) AS bare, round(always, 6) AS always, round(gated, 6) AS gated,
  round(gated - always, 6) AS gated_minus_always, round(gated - bare, 6) AS gated_minus_bare FROM a""")
def arm_delta(spark, sf):
    wide = ab.outcomes(spark, sf).groupBy("domain").pivot("arm", ["bare", "always", "gated"]).agg(
        F.avg(F.col("correct").cast("double")))
    return _round(wide.withColumn("gated_minus_always", F.col("gated") - F.col("always"))
                  .withColumn("gated_minus_bare", F.col("gated") - F.col("bare")),
                  "bare", "always", "gated", "gated_minus_always", "gated_minus_bare")


# ------------------------------------------------------------------ resampling

def _variant_pairs(spark, sf):
    """two_stage against hypo_skill, per instance."""
    s = es.ndcg10(spark, sf)
    on = ["domain", "instance_id"]
    return s.filter("variant = 'two_stage'").select(*on, F.col("value").alias("a")).join(
        s.filter("variant = 'hypo_skill'").select(*on, F.col("value").alias("b")), on) \
        .withColumn("comparison", F.lit("two_stage-hypo_skill"))


_SQL_VP = es.SQL_SCORES + """, vp AS (SELECT 'two_stage-hypo_skill' AS comparison, x.domain, x.instance_id, x.nd AS a, y.nd AS b, x.nd - y.nd AS v
  FROM pi x JOIN pi y USING (domain, instance_id, d) WHERE x.variant = 'two_stage' AND y.variant = 'hypo_skill' AND d = 10)"""


@_register("bootstrap_paired", _SQL_VP + "," + ab.sql_means("bm", "vp", "comparison", REPLICATES) + f"""
SELECT (SELECT count(*) FROM vp) AS n, (SELECT round(avg(v), 6) FROM vp) AS difference, {ab.SQL_CI},
  round({ab.SQL_P_UNCAPPED}, 6) AS p_two_sided FROM bm""")
def bootstrap_paired(spark, sf):
    out = resample.paired(_variant_pairs(spark, sf), ["comparison"], REPLICATES, p_value="uncapped")
    return _round(out.select("n", "difference", "ci_low", "ci_high", "p_two_sided"),
                  "difference", "ci_low", "ci_high", "p_two_sided")


@_register("bootstrap_stats", _SQL_VP + "," + ab.sql_means("bm", "vp", "comparison, domain", REPLICATES, "11") + f""",
o AS (SELECT domain, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(v), 6) AS difference FROM vp GROUP BY 1)
SELECT domain, any_value(n) AS n, any_value(mean_a) AS mean_a, any_value(mean_b) AS mean_b, any_value(difference) AS difference,
  {ab.SQL_CI}, {ab.SQL_P}, count(*) AS replicates FROM bm JOIN o USING (domain) GROUP BY domain""")
def bootstrap_stats(spark, sf):
    out = resample.paired(_variant_pairs(spark, sf), ["comparison", "domain"], REPLICATES, seed=11)
    return _round(out.drop("comparison", "dist_mean"),
                  "mean_a", "mean_b", "difference", "ci_low", "ci_high", "p_two_sided")


@_register("bootstrap_macro", _SQL_VP + "," + ab.sql_means("bm", "vp", "comparison, domain", REPLICATES, "5") + f""",
mm AS (SELECT b, round(avg(mean), 12) AS mean FROM bm GROUP BY 1)
SELECT (SELECT count(*) FROM vp) AS n_instances, (SELECT count(DISTINCT domain) FROM vp) AS n_strata,
  (SELECT round(avg(x), 6) FROM (SELECT avg(a) AS x FROM vp GROUP BY domain)) AS mean_a,
  (SELECT round(avg(x), 6) FROM (SELECT avg(b) AS x FROM vp GROUP BY domain)) AS mean_b,
  round(avg(mean), 6) AS difference, {ab.SQL_CI}, {ab.SQL_P}, count(*) AS replicates FROM mm""")
def bootstrap_macro(spark, sf):
    out = resample.macro(_variant_pairs(spark, sf), ["comparison"], "domain", REPLICATES, seed=5)
    return _round(out.drop("comparison"), "mean_a", "mean_b", "difference", "ci_low", "ci_high",
                  "p_two_sided")


_PAIRS = (("gated", "always"), ("gated", "bare"), ("always", "bare"))


def _arm_pairs(spark, sf):
    """(pair, scope, instance_id, a, b): every arm pair per domain on all and on
    test ids, and pooled over domains."""
    flag = ab.outcome_split(spark, sf)
    wide = ab.outcomes(spark, sf).groupBy("domain", "instance_id").pivot(
        "arm", ["bare", "always", "gated"]).agg(F.max(F.col("correct").cast("double")))
    pairs = F.array(*[F.struct(F.lit(f"{a}-vs-{b}").alias("pair"), F.col(a).alias("a"),
                               F.col(b).alias("b")) for a, b in _PAIRS])
    scopes = F.array_compact(F.array(
        F.concat(F.col("domain"), F.lit("/full")), F.lit("pooled/full"),
        F.when(~F.col("is_validation"), F.concat(F.col("domain"), F.lit("/test")))))
    rows = wide.join(flag, ["domain", "instance_id"]).withColumn("p", F.explode(pairs)).withColumn(
        "scope", F.explode(scopes))
    return rows.select("p.pair", "scope", F.concat_ws("|", "domain", F.col("instance_id").cast("string"))
                       .alias("instance_id"), "p.a", "p.b")


@_register("bootstrap_arms", f"""WITH {ab.SQL_OUT},
w AS (SELECT domain, instance_id, is_validation, max(CASE WHEN arm = 'bare' THEN correct::INT END) AS bare,
  max(CASE WHEN arm = 'always' THEN correct::INT END) AS always, max(CASE WHEN arm = 'gated' THEN correct::INT END) AS gated
  FROM arms JOIN oval USING (domain, instance_id) GROUP BY ALL),
p AS (SELECT domain, instance_id, is_validation, 'gated-vs-always' AS pair, gated - always AS v FROM w
  UNION ALL SELECT domain, instance_id, is_validation, 'gated-vs-bare', gated - bare FROM w
  UNION ALL SELECT domain, instance_id, is_validation, 'always-vs-bare', always - bare FROM w),
ap AS (SELECT pair, domain || '/full' AS scope, domain || '|' || instance_id AS instance_id, v FROM p
  UNION ALL SELECT pair, 'pooled/full', domain || '|' || instance_id, v FROM p
  UNION ALL SELECT pair, domain || '/test', domain || '|' || instance_id, v FROM p WHERE NOT is_validation),
{ab.sql_means('bm', 'ap', 'pair, scope', REPLICATES)},
o AS (SELECT pair, scope, count(*) AS n, round(avg(v), 6) AS delta FROM ap GROUP BY ALL)
SELECT pair, scope, any_value(n) AS n, any_value(delta) AS delta,
  round(least(1.0::DOUBLE, 2 * least(count(CASE WHEN mean <= 0 THEN 1 END), count(*) - count(CASE WHEN mean <= 0 THEN 1 END)) / count(*)), 6) AS p
FROM bm JOIN o USING (pair, scope) GROUP BY pair, scope""")
def bootstrap_arms(spark, sf):
    out = resample.paired(_arm_pairs(spark, sf), ["pair", "scope"], REPLICATES, p_value="one_count")
    return out.select("pair", "scope", "n", F.round("difference", 6).alias("delta"),
                      F.round("p_two_sided", 6).alias("p"))


@_register("bootstrap_multinomial")
def bootstrap_multinomial(spark, sf):
    """The arm pairs at 10,000 replicates with counted values (numpy draws)."""
    out = resample.paired(_arm_pairs(spark, sf), ["pair", "scope"], REPLICATES, p_value="one_count",
                          engine=resample.multinomial_means)
    return _round(out.drop("dist_mean"), "mean_a", "mean_b", "difference", "ci_low", "ci_high",
                  "p_two_sided")


def _cell_pairs(spark, sf):
    """(k_samples, model, domain, a, b): mean price at K against K=4."""
    c = ab.trade(spark, sf).groupBy("model", "domain", "k_samples").agg(F.avg("price").alias("value"))
    return c.filter("k_samples <> 4").withColumnRenamed("value", "a").join(
        c.filter("k_samples = 4").select("model", "domain", F.col("value").alias("b")), ["model", "domain"])


_SQL_CELLP = ab.SQL_TRADE + """,
cp0 AS (SELECT model, domain, k_samples, avg(price) AS value FROM trade GROUP BY ALL),
cp AS (SELECT a.k_samples, model, domain, a.value AS a, b.value AS b, a.value - b.value AS v
  FROM cp0 a JOIN cp0 b USING (model, domain) WHERE a.k_samples <> 4 AND b.k_samples = 4)"""
_SQL_HIER = f"""
hu AS (SELECT k_samples, model, row_number() OVER (PARTITION BY k_samples ORDER BY md5('3:' || model), model) - 1 AS oi, count(*) OVER (PARTITION BY k_samples) AS onn
  FROM (SELECT DISTINCT k_samples, model FROM cp)),
hi AS (SELECT k_samples, domain, row_number() OVER (PARTITION BY k_samples ORDER BY md5('3:' || domain), domain) - 1 AS ii, count(*) OVER (PARTITION BY k_samples) AS inn
  FROM (SELECT DISTINCT k_samples, domain FROM cp)),
hs AS (SELECT k_samples, onn, inn, b, i, ('0x' || substr(md5('3:' || k_samples || ':' || b || ':' || i), 1, 8))::BIGINT % onn AS oi
  FROM (SELECT DISTINCT k_samples, onn FROM hu) JOIN (SELECT DISTINCT k_samples, inn FROM hi) USING (k_samples), range({REPLICATES}) t(b), range(100) s(i) WHERE i < onn),
hd AS (SELECT k_samples, b, oi, ('0x' || substr(md5('3:' || k_samples || ':' || i || ':' || b || ':' || j), 1, 8))::BIGINT % inn AS ii
  FROM hs, range(100) s(j) WHERE j < inn),
hm AS (SELECT hd.k_samples, hd.b, round(avg(v), 12) AS mean FROM hd JOIN hu USING (k_samples, oi) JOIN hi USING (k_samples, ii)
  JOIN cp ON cp.k_samples = hd.k_samples AND cp.model = hu.model AND cp.domain = hi.domain GROUP BY ALL)"""


@_register("bootstrap_hier", f"WITH {_SQL_CELLP}, {_SQL_HIER}, " + f"""
o AS (SELECT k_samples, count(DISTINCT model) AS n_outer, count(DISTINCT domain) AS n_inner, round(avg(a), 6) AS mean_a,
  round(avg(b), 6) AS mean_b, round(avg(v), 6) AS difference FROM cp GROUP BY 1)
SELECT k_samples, any_value(n_outer) AS n_outer, any_value(n_inner) AS n_inner, any_value(mean_a) AS mean_a, any_value(mean_b) AS mean_b,
  any_value(difference) AS difference, {ab.SQL_CI}, {ab.SQL_P}, count(*) AS replicates FROM hm JOIN o USING (k_samples) GROUP BY k_samples""")
def bootstrap_hier(spark, sf):
    out = resample.hierarchical(_cell_pairs(spark, sf), ["k_samples"], "model", "domain", REPLICATES, seed=3)
    return _round(out, "mean_a", "mean_b", "difference", "ci_low", "ci_high", "p_two_sided")


@_register("paired_report", ab.SQL_K + f""",
micro AS (SELECT variant, k_samples, 'micro' AS scope, domain || '|' || instance_id AS instance_id, a, b, v FROM kpair
  UNION ALL SELECT variant, k_samples, 'domain:' || domain, domain || '|' || instance_id, a, b, v FROM kpair WHERE variant = 'routed'),
{ab.sql_means('bm', 'micro', 'variant, k_samples, scope', REPLICATES)},
o AS (SELECT variant, k_samples, scope, count(*) AS n, avg(a) AS mean_k, avg(b) AS mean_k4, avg(v) AS difference FROM micro GROUP BY ALL),
{ab.sql_means('dm', 'kpair', 'variant, k_samples, domain', REPLICATES)},
mm AS (SELECT variant, k_samples, b, round(avg(mean), 12) AS mean FROM dm GROUP BY ALL),
mo AS (SELECT variant, k_samples, sum(n)::BIGINT AS n, avg(a) AS mean_k, avg(b) AS mean_k4 FROM (
  SELECT variant, k_samples, domain, count(*) AS n, avg(a) AS a, avg(b) AS b FROM kpair GROUP BY ALL) GROUP BY ALL)
SELECT variant, k_samples, scope, any_value(n) AS n, round(any_value(mean_k), 6) AS mean_k, round(any_value(mean_k4), 6) AS mean_k4,
  round(any_value(difference), 6) AS difference, {ab.SQL_CI}, {ab.SQL_P} FROM bm JOIN o USING (variant, k_samples, scope) GROUP BY variant, k_samples, scope
UNION ALL SELECT variant, k_samples, 'macro', any_value(n), round(any_value(mean_k), 6), round(any_value(mean_k4), 6),
  round(avg(mean), 6), {ab.SQL_CI}, {ab.SQL_P} FROM mm JOIN mo USING (variant, k_samples) GROUP BY variant, k_samples""")
def paired_report(spark, sf):
    """Every variant at every K against K=4: micro, macro, and routed by domain."""
    pairs = ab.k_pairs(spark, sf)
    scopes = F.array_compact(F.array(
        F.lit("micro"), F.when(F.col("variant") == "routed", F.concat(F.lit("domain:"), "domain"))))
    scoped = pairs.withColumn("scope", F.explode(scopes)).withColumn(
        "instance_id", F.concat_ws("|", "domain", F.col("instance_id").cast("string")))
    cols = ["variant", "k_samples", "scope", "n", "mean_k", "mean_k4", "difference", "ci_low",
            "ci_high", "p_two_sided"]
    plain = resample.paired(scoped, ["variant", "k_samples", "scope"], REPLICATES).withColumnsRenamed(
        {"mean_a": "mean_k", "mean_b": "mean_k4"})
    macro = resample.macro(pairs, ["variant", "k_samples"], "domain", REPLICATES).withColumnsRenamed(
        {"mean_a": "mean_k", "mean_b": "mean_k4", "n_instances": "n"}).withColumn("scope", F.lit("macro"))
    return _round(plain.select(*cols).unionByName(macro.select(*cols)),
                  "mean_k", "mean_k4", "difference", "ci_low", "ci_high", "p_two_sided")


@_register("fleet_paired", f"WITH {_SQL_CELLP}, {_SQL_HIER}, " + f"""
fu AS (SELECT k_samples, 'macro' AS scope, model AS instance_id, avg(a) AS a, avg(b) AS b, avg(a) - avg(b) AS v FROM cp GROUP BY ALL
  UNION ALL SELECT k_samples, 'domain:' || domain, model, a, b, v FROM cp),
{ab.sql_means('bm', 'fu', 'k_samples, scope', REPLICATES)},
o AS (SELECT k_samples, scope, count(*) AS n, avg(v) AS difference FROM fu GROUP BY ALL)
SELECT k_samples, scope, any_value(n) AS n_units, round(any_value(difference), 6) AS difference, {ab.SQL_CI}, {ab.SQL_P}
FROM bm JOIN o USING (k_samples, scope) GROUP BY k_samples, scope
UNION ALL SELECT k_samples, 'hierarchical', (SELECT count(DISTINCT model) FROM cp), (SELECT round(avg(v), 6) FROM cp WHERE cp.k_samples = hm.k_samples), {ab.SQL_CI}, {ab.SQL_P}
FROM hm GROUP BY k_samples""")
def fleet_paired(spark, sf):
    """Models as the unit: macro over domains, each domain, and hierarchical."""
    cells = _cell_pairs(spark, sf)
    by_model = cells.groupBy("k_samples", F.col("model").alias("instance_id")).agg(
        F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn("scope", F.lit("macro"))
    by_domain = cells.select("k_samples", F.col("model").alias("instance_id"), "a", "b",
                             F.concat(F.lit("domain:"), "domain").alias("scope"))
    units = resample.paired(by_model.unionByName(by_domain), ["k_samples", "scope"], REPLICATES)
    hier = resample.hierarchical(cells, ["k_samples"], "model", "domain", REPLICATES, seed=3).withColumn(
        "scope", F.lit("hierarchical")).withColumnRenamed("n_outer", "n")
    cols = ["k_samples", "scope", "n", "difference", "ci_low", "ci_high", "p_two_sided"]
    return _round(units.select(*cols).unionByName(hier.select(*cols)).withColumnRenamed("n", "n_units"),
                  "difference", "ci_low", "ci_high", "p_two_sided")


# ------------------------------------------------------------------ completeness over the matrix

@_register("matrix_gaps", ab.SQL_K + """,
have AS (SELECT DISTINCT k_samples, domain, CASE WHEN k_samples = 2 AND variant = 'fused' THEN 'fused_old' ELSE variant END AS variant FROM ksr),
want AS (SELECT k::INTEGER AS k_samples, domain, variant FROM kk, (SELECT DISTINCT domain FROM q),
  (VALUES ('hypo_sentence'), ('hypo_passage'), ('hypo_skill'), ('fused'), ('two_stage'), ('routed')) v(variant))
SELECT k_samples, domain, variant, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT * FROM have)
UNION ALL SELECT k_samples, domain, variant, 'extra' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)""")
def matrix_gaps(spark, sf):
    """The matrix is whole; renaming one variant at one K shows both problems."""
    grid = F.array(*[F.struct(F.lit(k).alias("k_samples"), F.lit(v).alias("variant"))
                     for k in vs.K_VALUES for v in (*vs.VARIANTS, "routed")])
    want = vs.query_ids(spark, sf).select("domain").distinct().select(
        "domain", F.explode(grid).alias("g")).select("g.k_samples", "domain", "g.variant")
    renamed = F.when((F.col("k_samples") == 2) & (F.col("variant") == "fused"), F.lit("fused_old")).otherwise(
        F.col("variant"))
    have = ab.k_scores_with_routed(spark, sf).select("k_samples", "domain", renamed.alias("variant")).distinct()
    return checks.matrix_gaps(want, have, ["k_samples", "domain", "variant"])


@_register("fleet_support", f"""WITH {ab.SQL_TRADE},
c AS (SELECT domain, method, model, count(*) AS n FROM trade GROUP BY ALL)
SELECT domain, method, count(*) AS members, 0::BIGINT AS duplicates, min(n) AS min_n,
  count(*) = (SELECT count(DISTINCT model) FROM c) AS supported FROM c GROUP BY ALL""")
def fleet_support(spark, sf):
    """Which (domain, month) keys every model has exactly once."""
    rows = ab.trade(spark, sf).groupBy("domain", "method", "model").agg(F.count(F.lit(1)).alias("n"))
    return checks.common_keys(rows, ["domain", "method"], "model")


@_register("identity_drift", f"""WITH {ab.SQL_TRADE},
d AS (SELECT model, domain, count(DISTINCT variant) AS variant, count(DISTINCT k_samples) AS k_samples, count(DISTINCT substr(method, 1, 4)) AS year
  FROM trade GROUP BY ALL)
SELECT model, domain, field, distinct_values FROM (
  SELECT model, domain, 'variant' AS field, variant AS distinct_values FROM d UNION ALL SELECT model, domain, 'k_samples', k_samples FROM d
  UNION ALL SELECT model, domain, 'year', year FROM d) WHERE distinct_values > 1""")
def identity_drift(spark, sf):
    meta = ab.trade(spark, sf).withColumn("year", F.substring("method", 1, 4))
    return checks.identity_drift(meta, ["model", "domain"], ["variant", "k_samples", "year"])


@_register("fleet_cost", f"""WITH {ab.SQL_TRADE},
c AS (SELECT model, k_samples, avg(price) AS value FROM trade GROUP BY ALL)
SELECT k_samples, count(*) AS models, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM c GROUP BY 1""")
def fleet_cost(spark, sf):
    per = ab.trade(spark, sf).groupBy("model", "k_samples").agg(F.avg("price").alias("value"))
    return _round(cost.spread_over_models(per, ["k_samples"], "value"), "mean", "min", "max")
