"""Registered queries of the vector experiment: centroids, search, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from imagora.functions import vector as vx
from imagora.operators import clustered, dense, fusion, hypothesis
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


def vec_long(df, keys):
    """One row per element, for comparison as plain columns."""
    return df.select(*keys, F.posexplode("vec").alias("pos", "x")).select(
        *keys, "pos", F.round("x", 6).alias("x"))


_SQL_LONG = "unnest(range(0, len(v))) AS pos, unnest(list_transform(v, lambda x: round(x, 6))) AS x"


@_register("l2_normalize", f"""
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label - 4)) AS w FROM embeddings),
n AS (SELECT vec_id, {vs.sql_norm('w')} AS v FROM s)
SELECT vec_id, {_SQL_LONG} FROM n""")
def l2_normalize(spark, sf):
    scaled = vs.items(spark, sf).select(
        "vec_id", vx.scale(F.col("vec"), F.col("label") - F.lit(4)).alias("vec"))
    return vec_long(scaled.withColumn("vec", vx.normalize(F.col("vec"))), ["vec_id"])


@_register("centroid_single", f"WITH {vs.sql_base()}, {vs.sql_cent()} "
           f"SELECT template, instance_id, {_SQL_LONG} FROM cent")
def centroid_single(spark, sf):
    cents = vs.hypothesis_queries(spark, sf).withColumn(
        "template", F.regexp_replace("variant", "^hypo_", ""))
    return vec_long(cents, ["template", "instance_id"])


@_register("centroid_fields", f"WITH {vs.sql_base()}, {vs.sql_library()}, {vs.sql_fields()} "
           f"SELECT instance_id, field, {_SQL_LONG} FROM fc")
def centroid_fields(spark, sf):
    return vec_long(vs.skill_field_centroids(spark, sf), ["instance_id", "field"])


@_register("dense_scores", f"""WITH {vs.sql_base()},
s AS (SELECT q.instance_id, e.vec_id AS doc_id, round(list_dot_product(q.v, e.v), 6) AS score FROM q, e)
SELECT instance_id, count(*) AS n_docs, max(score) AS best, count(CASE WHEN rn <= 100 THEN 1 END) AS kept,
  min(CASE WHEN rn <= 100 THEN score END) AS depth_score
FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, doc_id) AS rn FROM s)
GROUP BY 1""")
def dense_scores(spark, sf):
    """Per query: how the whole library scores and what survives at path depth."""
    qs = vs.queries(spark, sf).select("instance_id", F.lit("full").alias("field"), "vec")
    hits = dense.search(vs.library(spark, sf, ("full",)), qs, fusion.PATH_DEPTH, ("instance_id",))
    n_docs = vs.items(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    return hits.groupBy("instance_id").agg(
        F.max("score").alias("best"), F.count(F.lit(1)).alias("kept"),
        F.min("score").alias("depth_score")).withColumn("n_docs", n_docs)


@_register("agreement", f"""WITH {vs.sql_base()}
SELECT g.instance_id, round(coalesce(avg(list_dot_product(a.v, b.v)), 1.0), 6) AS agreement,
  max(g.n) AS n
FROM (SELECT instance_id, count(*) AS n FROM samp WHERE template = 'skill' GROUP BY 1) g
JOIN samp a ON a.instance_id = g.instance_id AND a.template = 'skill'
LEFT JOIN samp b ON b.instance_id = a.instance_id AND b.template = 'skill'
  AND b.sample_index > a.sample_index
GROUP BY 1""")
def agreement(spark, sf):
    return hypothesis.agreement(vs.samples(spark, sf, ("skill",)), vs.K).select(
        "instance_id", F.round("agreement", 6).alias("agreement"), "n")


_SQL_TOPK = f"""WITH {vs.sql_base()}
SELECT * FROM (SELECT instance_id, doc_id, score,
  row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, doc_id) AS rank
FROM (SELECT q.instance_id, e.vec_id AS doc_id, round(list_dot_product(q.v, e.v), 6) AS score FROM q, e))
WHERE rank <= 50"""


@_register("dense_topk_bounded", _SQL_TOPK)
def dense_topk_bounded(spark, sf):
    """The same rows out of a clustered library whose clusters are left out by bounds."""
    lib = clustered.build(vs.library(spark, sf, ("full",)).select("doc_id", "vec"))
    return lib.search(vs.queries(spark, sf).select("instance_id", "vec"), fusion.TOP_K, ["instance_id"])


@_register("dense_topk", _SQL_TOPK)
def dense_topk(spark, sf):
    qs = vs.queries(spark, sf).select("instance_id", F.lit("full").alias("field"), "vec")
    return dense.search(vs.library(spark, sf, ("full",)), qs, fusion.TOP_K,
                        ("instance_id",)).drop("field")


def _hypo(template):
    def build(spark, sf):
        return dense.search(vs.library(spark, sf, ("full",)),
                            vs.hypothesis_queries(spark, sf, (template,)), fusion.TOP_K,
                            ("variant", "instance_id")).drop("field", "variant")
    return build


for _t in vs.OFFSETS:
    _register(f"hypo_topk_{_t}", vs.sql_run() + f"""
SELECT instance_id, doc_id, score, rank FROM hypo WHERE variant = 'hypo_{_t}'""")(_hypo(_t))


@_register("field_paths", f"WITH {vs.sql_base()}, {vs.sql_library()}, {vs.sql_fields()} "
           "SELECT instance_id, field, doc_id, score, rank FROM fpath WHERE field IN ('meta', 'body', 'code')")
def field_paths(spark, sf):
    qs = vs.skill_field_centroids(spark, sf)
    return dense.search(vs.library(spark, sf, ("meta", "body", "code")), qs,
                        fusion.PATH_DEPTH, ("instance_id",))


@_register("fused_topk", f"WITH {vs.sql_base()}, {vs.sql_library()}, {vs.sql_fields()} "
           "SELECT instance_id, doc_id, round(score, 9) AS score, rank FROM fused")
def fused_topk(spark, sf):
    paths = dense.search(vs.library(spark, sf), vs.fused_queries(spark, sf), fusion.PATH_DEPTH,
                         ("instance_id",))
    return fusion.rrf(paths).select("instance_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@_register("fused_fallback", f"WITH {vs.sql_base()}, {vs.sql_library()}, {vs.sql_fields()} "
           "SELECT instance_id, doc_id, round(score, 9) AS score, rank FROM fused "
           "WHERE instance_id NOT IN (SELECT instance_id FROM sn)")
def fused_fallback(spark, sf):
    bare = vs.queries(spark, sf).join(vs.sampled_ids(spark, sf), "instance_id", "left_anti")
    qs = vs.field_rows(bare.withColumn("label", F.lit(0)), ["instance_id"], "label", ("full", "lex"))
    paths = dense.search(vs.library(spark, sf, ("full", "lex")), qs, fusion.PATH_DEPTH,
                         ("instance_id",))
    return fusion.rrf(paths).select("instance_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@_register("two_stage_topk", vs.sql_run() + " SELECT instance_id, doc_id, score, rank FROM two")
def two_stage_topk(spark, sf):
    paths = dense.search(vs.library(spark, sf), vs.fused_queries(spark, sf), fusion.PATH_DEPTH,
                         ("instance_id",))
    return fusion.rerank_cosine(
        fusion.rrf(paths), vs.hypothesis_queries(spark, sf, ("skill",)),
        vs.full_vectors(spark, sf), fusion.TOP_K).drop("first_rank")


@_register("rerank_cosine", vs.sql_run() + """
SELECT instance_id, doc_id, score, rank FROM (
  SELECT r.instance_id, r.doc_id, round(list_dot_product(q.v, e.v), 6) AS score,
    row_number() OVER (PARTITION BY r.instance_id
      ORDER BY round(list_dot_product(q.v, e.v), 6) DESC, r.rank) AS rank
  FROM run r JOIN q USING (instance_id) JOIN e ON e.vec_id = r.doc_id
  WHERE r.variant = 'hypo_passage') WHERE rank <= 20""")
def rerank_cosine(spark, sf):
    """The passage run re-ordered by the plain query vector."""
    cands = vs.run(spark, sf).filter(F.col("variant") == "hypo_passage")
    return fusion.rerank_cosine(cands, vs.queries(spark, sf), vs.full_vectors(spark, sf),
                                20).drop("first_rank")


@_register("rrf", vs.sql_run() + """,
s AS (SELECT instance_id, doc_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 12) AS score
      FROM run WHERE variant IN ('hypo_sentence', 'hypo_passage', 'hypo_skill') GROUP BY ALL)
SELECT instance_id, doc_id, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, doc_id) AS rank FROM s)
WHERE rank <= 50""")
def rrf(spark, sf):
    """The three single-vector runs fused."""
    runs = vs.run(spark, sf).filter(F.col("variant").startswith("hypo_"))
    return fusion.rrf(runs).select("instance_id", "doc_id", F.round("score", 9).alias("score"), "rank")
