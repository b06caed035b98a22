"""The vector experiment, built from `embeddings`.

Every vector is both a query and a library document. The gold documents of a
query are its next three ids; its imagined samples are the following vectors
(offset by template) whose label is not lower, so some queries get fewer than
K samples and some none. Slices of a vector stand in for the text fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.functions import vector as vx
from imagora.operators import dense, fusion, hypothesis
from imagora.plans.tables import load, staged

K = 4
K_VALUES = (1, 2, 4, 8, 10)
K_MAX = 10
OFFSETS = {"sentence": 1, "passage": 2, "skill": 3}
GOLD_SPAN = 3
# (field, first element, length); the code field exists for labels below five only
CODE_LABELS = 5
SLICES = {"meta": (1, 16), "body": (17, 32), "code": (49, 16), "lex": (33, 32)}
VARIANTS = ("hypo_sentence", "hypo_passage", "hypo_skill", "fused", "two_stage")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        "vec_id", vx.as_double(F.col("embedding")).alias("vec"), "label")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(
        F.col("vec_id").alias("instance_id"),
        F.concat(F.lit("d"), F.floor(F.col("label") / 2).cast("string")).alias("domain"), "vec")


def query_ids(spark: SparkSession, sf: str) -> DataFrame:
    return queries(spark, sf).select("instance_id", "domain")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    ids = items(spark, sf).select(F.col("vec_id").alias("doc_id"))
    wanted = ids.select(
        F.col("doc_id").alias("instance_id"),
        F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + GOLD_SPAN)).alias("doc_id"))
    return wanted.join(ids, "doc_id").select("instance_id", "doc_id")


def samples(spark: SparkSession, sf: str, templates=tuple(OFFSETS), k: int = K) -> DataFrame:
    """(instance_id, template, sample_index, sample_label, vec)."""
    base = items(spark, sf)
    offs = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(OFFSETS[t]).alias("off"))
                     for t in templates])
    grid = base.select("vec_id", "label", F.explode(offs).alias("o")).select(
        F.col("vec_id").alias("instance_id"), "label", "o.template", "o.off",
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_index"),
    ).withColumn("source_id", F.col("instance_id") + F.col("off") + F.col("sample_index"))
    src = base.select(F.col("vec_id").alias("source_id"), "vec",
                      F.col("label").alias("sample_label"))
    return grid.join(src, "source_id").filter(F.col("sample_label") >= F.col("label")).select(
        "instance_id", "template", "sample_index", "sample_label", "vec")


def _field(vec, name: str):
    if name == "full":
        return vec
    start, length = SLICES[name]
    return vx.normalize(F.slice(vec, start, length))


def field_rows(df: DataFrame, keep: list[str], label: str, fields: tuple[str, ...]) -> DataFrame:
    """One row per field of a vector."""
    structs = [
        F.struct(F.lit(f).alias("field"),
                 (F.when(F.col(label) < CODE_LABELS, _field(F.col("vec"), f)) if f == "code"
                  else _field(F.col("vec"), f)).alias("vec"))
        for f in fields]
    return df.select(*keep, F.explode(F.array(*structs)).alias("f")).select(
        *keep, "f.field", "f.vec").filter(F.col("vec").isNotNull())


def library(spark: SparkSession, sf: str,
            fields=("full", "meta", "body", "code", "lex")) -> DataFrame:
    base = items(spark, sf).withColumnRenamed("vec_id", "doc_id")
    return field_rows(base, ["doc_id"], "label", fields)


def hypothesis_queries(spark: SparkSession, sf: str, templates=tuple(OFFSETS),
                       k: int = K) -> DataFrame:
    """(variant, instance_id, field='full', vec): query + sample centroids."""
    smp = samples(spark, sf, templates, k).withColumn(
        "variant", F.concat(F.lit("hypo_"), "template"))
    names = F.array(*[F.lit(f"hypo_{t}") for t in templates])
    qv = queries(spark, sf).select("instance_id", "vec", F.explode(names).alias("variant"))
    return hypothesis.centroid_with_query(smp, qv, k, ("variant", "instance_id")).select(
        "variant", "instance_id", F.lit("full").alias("field"), "vec")


def sampled_ids(spark: SparkSession, sf: str, template: str = "skill", k: int = K) -> DataFrame:
    return samples(spark, sf, (template,), k).select("instance_id").distinct()


def skill_field_centroids(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    smp = field_rows(samples(spark, sf, ("skill",), k), ["instance_id", "sample_index"],
                     "sample_label", ("meta", "body", "code"))
    anchors = queries(spark, sf).select("instance_id", _field(F.col("vec"), "meta").alias("vec"))
    return hypothesis.field_centroids(smp, anchors, k)


def fused_queries(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """(variant='fused', instance_id, field, vec): the paths of every query.

    Queries without samples take the full-vector path instead of the fields.
    """
    qv = queries(spark, sf)
    fields = skill_field_centroids(spark, sf, k)
    lex = qv.select("instance_id", F.lit("lex").alias("field"), _field(F.col("vec"), "lex").alias("vec"))
    bare = qv.join(sampled_ids(spark, sf, "skill", k), "instance_id", "left_anti").select(
        "instance_id", F.lit("full").alias("field"), "vec")
    return fields.unionByName(lex).unionByName(bare).select(
        F.lit("fused").alias("variant"), "instance_id", "field", "vec")


def full_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(F.col("vec_id").alias("doc_id"), "vec")


def _deep(queries: DataFrame) -> DataFrame:
    """Queries with the depth that lists are made from: single-vector paths end where lists end."""
    return queries.withColumn("depth", F.when(F.col("variant") == "fused", fusion.PATH_DEPTH).otherwise(fusion.TOP_K))


def _used(paths: DataFrame) -> DataFrame:
    """Without the ranks of single-vector paths that no list goes down to, and the scores of
    fused paths, of which only ranks are read."""
    fused = F.col("variant") == "fused"
    return paths.filter(fused | (F.col("rank") <= fusion.TOP_K)).withColumn("score", F.when(~fused, F.col("score")))


def build_paths(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """(variant, instance_id, field, doc_id, score, rank): the paths of every single-vector and fused query."""
    qs = _deep(hypothesis_queries(spark, sf, k=k)).unionByName(_deep(fused_queries(spark, sf, k)))
    return _used(dense.search(library(spark, sf), qs, fusion.PATH_DEPTH, ("variant", "instance_id")))


def build_run(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """All five variants at one K from a single pass over the library."""
    # read three times below, so it is written
    paths = staged(spark, sf, f"vector_paths_{k}", lambda: build_paths(spark, sf, k))
    keys = ("variant", "instance_id")
    hypo = paths.filter((F.col("variant") != "fused") & (F.col("rank") <= fusion.TOP_K)).select(
        *keys, "doc_id", "score", "rank")
    # read twice and an eighth of its paths, so it is written as well
    fused = staged(spark, sf, f"vector_fused_{k}", lambda: fusion.rrf(paths.filter(F.col("variant") == "fused"), keys))
    two = fusion.rerank_cosine(
        fused.select("instance_id", "doc_id", "rank"),
        hypothesis_queries(spark, sf, ("skill",), k).select("instance_id", "vec"),
        full_vectors(spark, sf), fusion.TOP_K,
    ).withColumn("variant", F.lit("two_stage"))
    cols = ["variant", "instance_id", "doc_id", "score", "rank"]
    return hypo.select(*cols).unionByName(fused.select(*cols)).unionByName(two.select(*cols)).join(
        query_ids(spark, sf), "instance_id")


def run(spark: SparkSession, sf: str) -> DataFrame:
    """The written run: domain, variant, instance_id, doc_id, score, rank."""
    return staged(spark, sf, "vector_run", lambda: build_run(spark, sf))


def build_k_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(k_class, variant, instance_id, field, doc_id, score, rank): the paths of every single-vector
    and fused query at every K, from one pass over the library.

    One sample table serves all K, since K is a bound on the sample index. Where a larger K adds
    no sample, a query is the same and asked once: ``k_class`` has a bit for each K it stands for.
    """
    keys = ("k_samples", "instance_id")
    smp = samples(spark, sf, ("skill",), K_MAX)
    own = queries(spark, sf).select("instance_id", "vec")
    qv = own.withColumn("k_samples", F.explode(_k_array()))
    fields = hypothesis.field_centroids_over_k(
        field_rows(smp, ["instance_id", "sample_index"], "sample_label", ("meta", "body", "code")),
        own.select("instance_id", _field(F.col("vec"), "meta").alias("vec")), K_VALUES)
    lex = own.select("instance_id", F.lit("lex").alias("field"), _field(F.col("vec"), "lex").alias("vec")).select(
        F.explode(_k_array()).alias("k_samples"), "instance_id", "field", "vec")
    # a query is sampled at every K above its first sample index
    first = smp.groupBy("instance_id").agg(F.min("sample_index").alias("first"))
    drawn = first.select(F.explode(_k_array()).alias("k_samples"), "instance_id", "first").filter("first < k_samples")
    bare = qv.join(drawn.select(*keys), list(keys), "left_anti").select(
        *keys, F.lit("full").alias("field"), "vec")
    fused = hypothesis.shared_over_k(fields.unionByName(lex).unionByName(bare), ("instance_id",), K_VALUES).withColumn(
        "variant", F.lit("fused"))
    hypo = k_centroids(spark, sf, tuple(OFFSETS), shared=True).withColumn("field", F.lit("full"))
    cols = ["k_class", "variant", "instance_id", "field", "vec"]
    return _used(dense.search(library(spark, sf), _deep(hypo.select(*cols).unionByName(fused.select(*cols))),
                              fusion.PATH_DEPTH, ("k_class", "variant", "instance_id")))


def _at_every_k(rows: DataFrame) -> DataFrame:
    """Rows of classes of K repeated for each of their K."""
    return rows.withColumn("k_samples", F.explode(hypothesis.ks_of(F.col("k_class"), K_VALUES))).drop("k_class")


def _k_array():
    return F.array(*[F.lit(k) for k in K_VALUES])


def k_centroids(spark: SparkSession, sf: str, templates: tuple[str, ...], shared: bool = False) -> DataFrame:
    """(k_samples, variant, instance_id, vec): query + sample centroids at every K, or ``shared`` by classes of K."""
    smp = samples(spark, sf, templates, K_MAX).withColumn("variant", F.concat(F.lit("hypo_"), "template"))
    names = F.array(*[F.lit(f"hypo_{t}") for t in templates])
    qv = queries(spark, sf).select("instance_id", "vec", F.explode(names).alias("variant"))
    return hypothesis.centroids_over_k(smp, qv, K_VALUES, ("variant", "instance_id"), shared)


def build_k_run(spark: SparkSession, sf: str) -> DataFrame:
    """(k_samples, domain, variant, instance_id, doc_id, score, rank): all five variants at every K."""
    paths = staged(spark, sf, "k_paths", lambda: build_k_paths(spark, sf))
    keys = ("k_samples", "instance_id")
    cols = ["k_samples", "variant", "instance_id", "doc_id", "score", "rank"]
    hypo = _at_every_k(paths.filter((F.col("variant") != "fused") & (F.col("rank") <= fusion.TOP_K)))
    fused = _at_every_k(staged(spark, sf, "k_fused", lambda: fusion.rrf(
        paths.filter(F.col("variant") == "fused"), ("k_class", "instance_id"))))
    two = fusion.rerank_cosine(fused.select(*keys, "doc_id", "rank"),
                               k_centroids(spark, sf, ("skill",)).select(*keys, "vec"),
                               full_vectors(spark, sf), fusion.TOP_K, keys)
    return hypo.select(*cols).unionByName(
        fused.withColumn("variant", F.lit("fused")).select(*cols)).unionByName(
        two.withColumn("variant", F.lit("two_stage")).select(*cols)).join(query_ids(spark, sf), "instance_id")


# ------------------------------------------------------------------ oracle SQL

def sql_norm(v: str) -> str:
    return (f"list_transform({v}, lambda x: x / CASE WHEN list_dot_product({v}, {v}) = 0 THEN 1 "
            f"ELSE sqrt(list_dot_product({v}, {v})) END)")


def _sql_field(v: str, name: str) -> str:
    if name == "full":
        return v
    start, length = SLICES[name]
    return sql_norm(f"({v})[{start}:{start + length - 1}]")


def sql_base(k: int = K) -> str:
    offs = ", ".join(f"('{t}', {o})" for t, o in OFFSETS.items())
    return f"""
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT vec_id AS instance_id, 'd' || CAST(label // 2 AS VARCHAR) AS domain, v FROM e),
gold AS (SELECT a.vec_id AS instance_id, b.vec_id AS doc_id
         FROM (SELECT vec_id, unnest(range(1, {GOLD_SPAN + 1})) AS o FROM e) a
         JOIN e b ON b.vec_id = a.vec_id + a.o),
samp AS (SELECT a.vec_id AS instance_id, a.template, a.i AS sample_index,
                b.label AS sample_label, b.v
         FROM (SELECT vec_id, label, t.template, t.off, i.i FROM e,
               (VALUES {offs}) t(template, off), range({k}) i(i)) a
         JOIN e b ON b.vec_id = a.vec_id + a.off + a.i AND b.label >= a.label)"""


def sql_cent() -> str:
    names = ", ".join(f"('{t}')" for t in OFFSETS)
    return f"""
cpos AS (SELECT template, instance_id, pos, avg(x) AS x FROM (
           SELECT template, instance_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM samp
           UNION ALL
           SELECT template, instance_id, unnest(v), unnest(range(1, len(v) + 1))
           FROM q, (VALUES {names}) t(template)) GROUP BY ALL),
craw AS (SELECT template, instance_id, list(x ORDER BY pos) AS v FROM cpos GROUP BY ALL),
cent AS (SELECT template, instance_id, {sql_norm('v')} AS v FROM craw)"""


def sql_library(fields=("full", "meta", "body", "code", "lex")) -> str:
    parts = [
        f"SELECT vec_id AS doc_id, '{f}' AS field, {_sql_field('v', f)} AS v FROM e"
        + (f" WHERE label < {CODE_LABELS}" if f == "code" else "") for f in fields]
    return "lib AS (" + " UNION ALL ".join(parts) + ")"


def sql_fields() -> str:
    parts = [
        f"SELECT instance_id, sample_index, '{f}' AS field, {_sql_field('v', f)} AS v FROM samp "
        f"WHERE template = 'skill'" + (f" AND sample_label < {CODE_LABELS}" if f == "code" else "")
        for f in ("meta", "body", "code")]
    return f"""
sf AS ({' UNION ALL '.join(parts)}),
sn AS (SELECT instance_id, count(DISTINCT sample_index) AS n FROM sf GROUP BY 1),
fpos AS (SELECT instance_id, field, pos, avg(x) AS x FROM (
           SELECT instance_id, field, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM sf)
         GROUP BY ALL),
fraw AS (SELECT instance_id, field, list(x ORDER BY pos) AS v FROM fpos GROUP BY ALL),
fanch AS (SELECT f.instance_id, f.field,
            CASE WHEN f.field = 'meta' THEN list_transform(list_zip(f.v, {_sql_field('q.v', 'meta')}),
              lambda p: (p[1] * sn.n + p[2]) / (sn.n + 1)) ELSE f.v END AS v
          FROM fraw f JOIN sn USING (instance_id) JOIN q USING (instance_id)),
fc AS (SELECT instance_id, field, {sql_norm('v')} AS v FROM fanch),
fq AS (SELECT instance_id, field, v FROM fc
       UNION ALL SELECT instance_id, 'lex', {_sql_field('v', 'lex')} FROM q
       UNION ALL SELECT instance_id, 'full', v FROM q WHERE instance_id NOT IN (SELECT instance_id FROM sn)),
fpath AS (SELECT * FROM (SELECT instance_id, field, doc_id, score,
            row_number() OVER (PARTITION BY instance_id, field ORDER BY score DESC, doc_id) AS rank
          FROM (SELECT fq.instance_id, fq.field, lib.doc_id,
                  round(list_dot_product(fq.v, lib.v), 6) AS score
                FROM fq JOIN lib ON fq.field = lib.field)) WHERE rank <= 100),
fsum AS (SELECT instance_id, doc_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 12) AS score
         FROM fpath GROUP BY ALL),
fused AS (SELECT * FROM (SELECT instance_id, doc_id, score,
            row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, doc_id) AS rank FROM fsum)
          WHERE rank <= 50)"""


def sql_base_over_k() -> str:
    """The base tables for every K at once: instance_id is vec_id * 100 + K."""
    offs = ", ".join(f"('{t}', {o})" for t, o in OFFSETS.items())
    return f"""
kk(k) AS (VALUES {', '.join(f'({k})' for k in K_VALUES)}),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT vec_id * 100 + k AS instance_id, 'd' || CAST(label // 2 AS VARCHAR) AS domain, v FROM e, kk),
gold AS (SELECT a.vec_id * 100 + k AS instance_id, b.vec_id AS doc_id
         FROM (SELECT vec_id, unnest(range(1, {GOLD_SPAN + 1})) AS o FROM e) a
         JOIN e b ON b.vec_id = a.vec_id + a.o, kk),
samp AS (SELECT a.vec_id * 100 + k AS instance_id, a.template, a.i AS sample_index,
                b.label AS sample_label, b.v
         FROM (SELECT vec_id, label, t.template, t.off, i.i FROM e,
               (VALUES {offs}) t(template, off), range({K_MAX}) i(i)) a
         JOIN e b ON b.vec_id = a.vec_id + a.off + a.i AND b.label >= a.label JOIN kk ON a.i < k)"""


def sql_run(base: str = "") -> str:
    """CTE chain ending in run(domain, variant, instance_id, doc_id, score, rank)."""
    return "WITH " + (base or sql_base()) + "," + sql_cent() + "," + sql_library() + "," + sql_fields() + """,
hypo AS (SELECT * FROM (SELECT 'hypo_' || template AS variant, instance_id, doc_id, score,
           row_number() OVER (PARTITION BY template, instance_id ORDER BY score DESC, doc_id) AS rank
         FROM (SELECT c.template, c.instance_id, e.vec_id AS doc_id,
                 round(list_dot_product(c.v, e.v), 6) AS score FROM cent c, e)) WHERE rank <= 50),
two AS (SELECT 'two_stage' AS variant, instance_id, doc_id, score,
          row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, r1) AS rank
        FROM (SELECT f.instance_id, f.doc_id, f.rank AS r1,
                round(list_dot_product(c.v, e.v), 6) AS score
              FROM fused f JOIN cent c ON c.instance_id = f.instance_id AND c.template = 'skill'
              JOIN e ON e.vec_id = f.doc_id)),
run AS (SELECT q.domain, r.* FROM (
          SELECT variant, instance_id, doc_id, score, rank FROM hypo
          UNION ALL SELECT 'fused', instance_id, doc_id, score, rank FROM fused
          UNION ALL SELECT variant, instance_id, doc_id, score, rank FROM two) r
        JOIN q USING (instance_id))"""
