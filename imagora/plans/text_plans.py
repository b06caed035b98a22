"""Registered queries of the text experiment: parsing, encoding, BM25, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from imagora.functions import prompts
from imagora.functions import text as tx
from imagora.functions import vector as vx
from imagora.operators import dense, encode, fusion, gating, hypothesis, lexical, metrics, retrievers, sizing
from imagora.plans import text_setup as ts
from imagora.plans.tables import load
from imagora.session import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


_BODY, _CODE = ts.sql_fields("content")


@_register("split_code", f"""WITH {ts.SQL_CORPUS}
SELECT doc_id, md5({_BODY}) AS body, {_CODE} AS code, length({_BODY}) AS body_chars FROM corpus""")
def split_code(spark, sf):
    c = ts.corpus(spark, sf)
    body = tx.body_without_code(F.col("content"))
    return c.select("doc_id", body.alias("b"), tx.code_blocks(F.col("content")).alias("code")) \
        .select("doc_id", F.md5("b").alias("body"), "code", F.length("b").alias("body_chars"))


@_register("meta_text", f"""WITH m AS (SELECT doc_id, source || '..' AS name,
  CASE WHEN lang = 'es' THEN ' ' ELSE lang END AS description FROM documents)
SELECT doc_id, {ts.sql_meta('name', 'description')} AS meta FROM m""")
def meta_text(spark, sf):
    docs = load(spark, sf, "documents")
    desc = F.when(F.col("lang") == "es", F.lit(" ")).otherwise(F.col("lang"))
    return docs.select("doc_id", tx.meta(F.concat("source", F.lit("..")), desc).alias("meta"))


@_register("parse_fields", f"""WITH {ts.SQL_CORPUS}
SELECT doc_id, {ts.sql_meta('name', 'description')} AS meta, md5({_BODY}) AS body, md5({_CODE}) AS code
FROM corpus""")
def parse_fields(spark, sf):
    f = ts.corpus(spark, sf).select("doc_id", tx.fields(
        F.col("name"), F.col("description"), F.col("content")).alias("f"))
    return f.select("doc_id", "f.meta", F.md5("f.body").alias("body"), F.md5("f.code").alias("code"))


_GBODY, _GCODE = ts.sql_fields("body_src")
_SQL_GENERATED = rf"""
s0 AS (SELECT doc_id, {ts.strip('md')} AS s FROM md),
s1 AS (SELECT doc_id, CASE WHEN regexp_matches(s, '(?s)\A```[a-zA-Z0-9_+-]*\s*\n(.*)\n```\s*\z')
  THEN regexp_extract(s, '(?s)\A```[a-zA-Z0-9_+-]*\s*\n(.*)\n```\s*\z', 1) ELSE s END AS d FROM s0),
s2 AS (SELECT doc_id, d, regexp_matches(d, '(?s)\A---\s*\n(.*?)\n---\s*\n') AS hm,
  string_split_regex(regexp_extract(d, '(?s)\A---\s*\n(.*?)\n---\s*\n', 1), '\r\n|\n|\r') AS hl,
  regexp_replace(d, '(?s)\A---\s*\n(.*?)\n---\s*\n', '') AS rest FROM s1),
s3 AS (SELECT doc_id, rest,
  coalesce({ts.strip("regexp_replace(list_filter(hl, lambda x: regexp_matches(x, '(?i)^\\s*name\\s*:'))[-1], '(?s)\\A[^:]*:', '')")}, '') AS name,
  coalesce({ts.strip("regexp_replace(list_filter(hl, lambda x: regexp_matches(x, '(?i)^\\s*description\\s*:'))[-1], '(?s)\\A[^:]*:', '')")}, '') AS description,
  list_filter(string_split_regex(rest, '\r\n|\n|\r'), lambda x: {ts.strip('x')} <> '') AS lines FROM s2),
s4 AS (SELECT doc_id, description,
  CASE WHEN name <> '' THEN name ELSE coalesce(regexp_replace({ts.strip('lines[1]')}, '\A[# ]+', ''), '') END AS shown,
  CASE WHEN name <> '' THEN rest ELSE array_to_string(lines[2:], chr(10)) END AS body_src FROM s3)
"""


@_register("parse_generated", f"""WITH {ts.SQL_MD}, {_SQL_GENERATED}
SELECT doc_id, md5({ts.sql_meta('shown', 'description')}) AS meta, md5({_GBODY}) AS body, md5({_GCODE}) AS code
FROM s4""")
def parse_generated(spark, sf):
    f = ts.markdown(spark, sf).select("doc_id", tx.generated_fields(F.col("md")).alias("f"))
    return f.select("doc_id", F.md5("f.meta").alias("meta"), F.md5("f.body").alias("body"),
                    F.md5("f.code").alias("code"))


@_register("sentences", f"""WITH s AS (SELECT doc_id, list_filter(list_transform(
    string_split_regex(text, '[.\\n;]+'), lambda x: {ts.strip('x')}), lambda x: length(x) >= 15) AS ss FROM documents)
SELECT doc_id, pos, md5(x) AS sentence FROM (
  SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS x FROM s)""")
def sentences(spark, sf):
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "x")).select(
        "doc_id", "pos", F.md5("x").alias("sentence"))


@_register("tokenize", f"""WITH t AS (SELECT doc_id, {ts.sql_tokens('text')} AS toks FROM documents)
SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct,
  md5(array_to_string(toks, ' ')) AS digest FROM t""")
def tokenize(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"),
                    F.size(F.array_distinct("t")).alias("n_distinct"),
                    F.md5(F.array_join("t", " ")).alias("digest"))


def sql_templates() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''").replace("\n", "' || chr(10) || '"))
                     for n, t in prompts.TEMPLATES.items())
    return f"tpl(template, template_text) AS (VALUES {rows})"


@_register("render_prompts", f"""WITH {ts.SQL_QUERIES}, {sql_templates()}
SELECT instance_id, template, md5(replace(template_text, '{{q}}', query)) AS prompt,
  length(replace(template_text, '{{q}}', query)) AS prompt_chars FROM tq, tpl""")
def render_prompts(spark, sf):
    q = ts.queries(spark, sf).select("instance_id", "query", F.explode(prompts.template_rows()).alias("t"))
    p = prompts.render(F.col("t.template_text"), F.col("query"))
    return q.select("instance_id", "t.template", F.md5(p).alias("prompt"), F.length(p).alias("prompt_chars"))


@_register("embed_text", f"""WITH {ts.sql_embed('emb', 'documents', 'doc_id', 'text')}
SELECT doc_id, bucket AS pos, round(w, 6) AS x FROM emb""")
def embed_text(spark, sf):
    v = load(spark, sf, "documents").select("doc_id", encode.encode_text(F.col("text")).alias("vec"))
    return v.select("doc_id", F.posexplode("vec").alias("pos", "x")).filter("x != 0").select(
        "doc_id", "pos", F.round("x", 6).alias("x"))


# ------------------------------------------------------------------ lexical

@_register("bm25_index", f"""WITH {ts.SQL_BM25}
SELECT p.token, f.df, f.cf::BIGINT AS cf, max(p.tf) AS max_tf, min(d.dl) AS min_dl
FROM post p JOIN freq f USING (token) JOIN dl d USING (doc_id) GROUP BY ALL""")
def bm25_index(spark, sf):
    return ts.lexical_index(spark, sf).tokens.select("token", "df", "cf", "max_tf", "min_dl")


# the leading bits of an id's digest part a long list into blocks of about 128
@_register("bm25_blocks", f"""WITH {ts.SQL_BM25},
bits AS (SELECT token, df, CASE WHEN df <= 128 THEN 0 ELSE length(bin(CAST(ceil(df / 128.0) AS BIGINT) - 1)) END AS bits FROM freq),
placed AS (SELECT p.token, p.tf, d.dl, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT >> (32 - bits) AS block
  FROM post p JOIN bits USING (token) JOIN dl d USING (doc_id), stat s WHERE bits = 0 OR 2 * df < s.n)
SELECT token, CAST(block AS BIGINT) AS block, count(*) AS n,
  round(max(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / s.avgdl))), 9) AS peak
FROM placed, stat s GROUP BY token, block""")
def bm25_blocks(spark, sf):
    """The stored blocks of postings and their maxima."""
    return ts.lexical_index(spark, sf).blocks.select("token", "block", "n", F.round("peak", 9).alias("peak"))


@_register("bm25_topk", f"WITH {ts.SQL_BM25} SELECT * FROM bm25 WHERE rank <= 50")
def bm25_topk(spark, sf):
    return ts.lexical_index(spark, sf).topk(ts.queries(spark, sf), fusion.TOP_K)


@_register("bm25_topk_padded", f"""WITH {ts.SQL_BM25},
allp AS (SELECT b.item_id AS instance_id, d.doc_id, coalesce(s.score, 0) AS score, s.score IS NULL AS pad
  FROM benchmark b CROSS JOIN documents d LEFT JOIN bscore s ON s.instance_id = b.item_id AND s.doc_id = d.doc_id)
SELECT * FROM (SELECT instance_id, doc_id, score,
  row_number() OVER (PARTITION BY instance_id ORDER BY pad, score DESC, doc_id) AS rank FROM allp)
WHERE rank <= 50""")
def bm25_topk_padded(spark, sf):
    asked = ts.queries(spark, sf)
    ids = load(spark, sf, "documents").select("doc_id")
    found = ts.lexical_index(spark, sf).topk(asked, fusion.TOP_K)
    return lexical.pad_with_zero(found, asked.select("instance_id"), ids, fusion.TOP_K)


_SQL_DENSE = f"""
{ts.sql_embed('de', 'documents', 'doc_id', 'text')},
{ts.sql_embed('qe', 'tq', 'instance_id', 'query')},
dsc AS (SELECT q.instance_id, d.doc_id, round(coalesce(x.score, 0), 6) AS score
  FROM tq q CROSS JOIN documents d LEFT JOIN (
    SELECT instance_id, doc_id, sum(de.w * qe.w) AS score FROM qe JOIN de USING (bucket) GROUP BY ALL) x
  ON x.instance_id = q.instance_id AND x.doc_id = d.doc_id),
dense AS (SELECT instance_id, doc_id, score,
  row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, doc_id) AS rank FROM dsc)"""


def _dense_text(spark, sf, k):
    lib = load(spark, sf, "documents").select(
        "doc_id", F.lit("full").alias("field"), encode.encode_text(F.col("text")).alias("vec"))
    qs = ts.queries(spark, sf).select(
        "instance_id", F.lit("full").alias("field"), encode.encode_text(F.col("query")).alias("vec"))
    return dense.search(lib, qs, k, ("instance_id",)).drop("field")


@_register("dense_topk_text", f"WITH {ts.SQL_QUERIES}, {_SQL_DENSE} SELECT * FROM dense WHERE rank <= 50")
def dense_topk_text(spark, sf):
    return _dense_text(spark, sf, fusion.TOP_K)


_SQL_RRF = """SELECT instance_id, doc_id, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT instance_id, doc_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 12) AS score
    FROM paths GROUP BY ALL)) WHERE rank <= 50"""


@_register("hybrid_topk", f"""WITH {ts.SQL_QUERIES}, {_SQL_DENSE}, {ts.SQL_BM25},
paths AS (SELECT instance_id, doc_id, rank FROM dense WHERE rank <= 100
          UNION ALL SELECT instance_id, doc_id, rank FROM bm25 WHERE rank <= 100) {_SQL_RRF}""")
def hybrid_topk(spark, sf):
    lex = ts.lexical_index(spark, sf).topk(ts.queries(spark, sf), fusion.PATH_DEPTH)
    out = fusion.rrf(fusion.union_paths(lex, _dense_text(spark, sf, fusion.PATH_DEPTH)))
    return out.select("instance_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@_register("named_retrievers", f"""WITH {ts.SQL_QUERIES}, {_SQL_DENSE}, {ts.SQL_BM25},
paths AS (SELECT instance_id, doc_id, rank FROM dense WHERE rank <= 100
          UNION ALL SELECT instance_id, doc_id, rank FROM bm25 WHERE rank <= 100),
hyb AS ({_SQL_RRF})
SELECT 'bm25' AS retriever, instance_id, doc_id, score, rank::INTEGER AS rank FROM bm25 WHERE rank <= 10
UNION ALL SELECT 'dense', instance_id, doc_id, score, rank::INTEGER FROM dense WHERE rank <= 10
UNION ALL SELECT 'hybrid', instance_id, doc_id, score, rank::INTEGER FROM hyb WHERE rank <= 10""")
def named_retrievers(spark, sf):
    """Top 10 of the retrievers, each looked up by its name."""
    corpus, queries = load(spark, sf, "documents").select("doc_id", "text"), ts.queries(spark, sf)
    lexical_one = retrievers.named("bm25", stored=ts.lexical_index(spark, sf))
    made = {"bm25": lexical_one, "dense": retrievers.named("dense"),
            "hybrid": retrievers.named("hybrid", of=(lexical_one, retrievers.named("dense")))}
    parts = [r.index(corpus).topk(queries, 10).select(
        F.lit(name).alias("retriever"), "instance_id", "doc_id", F.round("score", 9).alias("score"), "rank") for name, r in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _text_field_library(spark, sf):
    parsed = ts.corpus(spark, sf).select("doc_id", tx.fields(
        F.col("name"), F.col("description"), F.col("content")).alias("f"))
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"f.{n}").alias("text"))
                      for n in ("meta", "body", "code")])
    rows = parsed.select("doc_id", F.explode(parts).alias("p")).filter(
        (F.col("p.field") != "code") | (F.col("p.text") != ""))
    return rows.select("doc_id", "p.field", encode.encode_text(F.col("p.text")).alias("vec"))


def _text_field_queries(spark, sf):
    parsed = ts.stand_in_samples(spark, sf).select(
        "instance_id", "sample_index", tx.generated_fields(F.col("md")).alias("f"))
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"f.{n}").alias("text"))
                      for n in ("meta", "body", "code")])
    rows = parsed.select("instance_id", "sample_index", F.explode(parts).alias("p")).filter(
        F.col("p.text") != "")
    vecs = rows.select("instance_id", "sample_index", "p.field",
                       encode.encode_text(F.col("p.text")).alias("vec"))
    anchors = ts.queries(spark, sf).select("instance_id", encode.encode_text(F.col("query")).alias("vec"))
    return hypothesis.field_centroids(vecs, anchors, ts.K)


_BODY_SQL = "'" + tx.STAND_IN_BODY.replace("\n", "' || chr(10) || '") + "'"
_SQL_STAND = f"""
st AS (SELECT instance_id, i AS sample_index, substr({ts.strip('query')}, CAST(1 + i * 40 AS BIGINT), 120) AS task
       FROM tq, range(4) r(i)),
sfld AS (SELECT instance_id, sample_index, 'meta' AS field, {ts.sql_meta(f"'{tx.STAND_IN_NAME}'", 'split_part(task, chr(10), 1)')} AS txt FROM st
  UNION ALL SELECT instance_id, sample_index, 'body', {_BODY_SQL} FROM st
  UNION ALL SELECT instance_id, sample_index, 'code', '{tx.STAND_IN_CODE}' FROM st)"""
_SQL_FUSED_TEXT = f"""
lfld AS (SELECT doc_id, 'meta' AS field, {ts.sql_meta('name', 'description')} AS txt FROM corpus
  UNION ALL SELECT doc_id, 'body', {_BODY} FROM corpus
  UNION ALL SELECT doc_id, 'code', {_CODE} FROM corpus WHERE {_CODE} <> ''),
{ts.sql_embed('le', 'lfld', 'doc_id, field', 'txt')},
{ts.sql_embed('se', 'sfld', 'instance_id, sample_index, field', 'txt')},
{ts.sql_embed('ae', 'tq', 'instance_id', 'query')},
cen AS (SELECT instance_id, field, bucket, CASE WHEN field = 'meta' THEN (m * 4 + a) / 5 ELSE m END AS x FROM (
  SELECT instance_id, field, bucket, sum(m) AS m, sum(a) AS a FROM (
    SELECT instance_id, field, bucket, sum(w) / 4 AS m, 0 AS a FROM se GROUP BY ALL
    UNION ALL SELECT instance_id, 'meta', bucket, 0, w FROM ae) GROUP BY ALL)),
cun AS (SELECT instance_id, field, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY instance_id, field)) AS w FROM cen),
fsc AS (SELECT g.instance_id, g.field, g.doc_id, round(coalesce(s.score, 0), 6) AS score
  FROM (SELECT q.instance_id, l.field, l.doc_id FROM tq q CROSS JOIN lfld l) g LEFT JOIN (
    SELECT instance_id, le.field, doc_id, sum(cun.w * le.w) AS score
    FROM cun JOIN le ON le.bucket = cun.bucket AND le.field = cun.field GROUP BY ALL) s
  ON s.instance_id = g.instance_id AND s.field = g.field AND s.doc_id = g.doc_id),
frk AS (SELECT instance_id, doc_id, row_number() OVER (PARTITION BY instance_id, field
  ORDER BY score DESC, doc_id) AS rank FROM fsc),
paths AS (SELECT instance_id, doc_id, rank FROM frk WHERE rank <= 100
          UNION ALL SELECT instance_id, doc_id, rank FROM bm25 WHERE rank <= 100)"""


@_register("fused_topk_text", f"""WITH {ts.SQL_QUERIES}, {ts.SQL_CORPUS}, {ts.SQL_BM25}, {_SQL_STAND},
{_SQL_FUSED_TEXT} {_SQL_RRF}""")
def fused_topk_text(spark, sf):
    """Four paths: meta, body and code centroids of the samples, and BM25."""
    paths = dense.search(_text_field_library(spark, sf), _text_field_queries(spark, sf),
                         fusion.PATH_DEPTH, ("instance_id",))
    lex = ts.lexical_index(spark, sf).topk(ts.queries(spark, sf), fusion.PATH_DEPTH)
    out = fusion.rrf(fusion.union_paths(paths, lex))
    return out.select("instance_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@_register("fused_fallback_text", f"""WITH {ts.SQL_QUERIES}, {ts.SQL_CORPUS}, {ts.SQL_BM25}, {_SQL_STAND}, {_SQL_DENSE},
{_SQL_FUSED_TEXT.rsplit("paths AS", 1)[0]}
bare AS (SELECT instance_id FROM tq WHERE domain = 'short'),
paths AS (SELECT instance_id, doc_id, rank FROM frk WHERE rank <= 100 AND instance_id NOT IN (SELECT instance_id FROM bare)
          UNION ALL SELECT instance_id, doc_id, rank FROM dense WHERE rank <= 100 AND instance_id IN (SELECT instance_id FROM bare)
          UNION ALL SELECT instance_id, doc_id, rank FROM bm25 WHERE rank <= 100) {_SQL_RRF}""")
def fused_fallback_text(spark, sf):
    """Short queries got no samples: they search by their own text instead of the fields."""
    bare = ts.queries(spark, sf).filter("domain = 'short'").select("instance_id", "query")
    fields = _text_field_queries(spark, sf).join(bare.select("instance_id"), "instance_id", "left_anti")
    own = bare.select("instance_id", F.lit("full").alias("field"), encode.encode_text(F.col("query")).alias("vec"))
    whole = load(spark, sf, "documents").select(
        "doc_id", F.lit("full").alias("field"), encode.encode_text(F.col("text")).alias("vec"))
    paths = dense.search(_text_field_library(spark, sf).unionByName(whole),
                         fields.select("instance_id", "field", "vec").unionByName(own),
                         fusion.PATH_DEPTH, ("instance_id",))
    lex = ts.lexical_index(spark, sf).topk(ts.queries(spark, sf), fusion.PATH_DEPTH)
    out = fusion.rrf(fusion.union_paths(paths, lex))
    return out.select("instance_id", "doc_id", F.round("score", 9).alias("score"), "rank")


# ------------------------------------------------------------------ coverage of sentences

def _sentence_sides(spark, sf):
    """(instance_id, doc_id, cand, hyp): bounded sentence vectors of the top
    document and of the samples."""
    # one row per query, sent to the scan of the texts, which then move nowhere
    top = sizing.checked_broadcast(written(ts.lexical_index(spark, sf).topk(ts.queries(spark, sf), 1), "top-documents"))
    cand = load(spark, sf, "documents").select("doc_id", "text").join(top, "doc_id").select(
        "instance_id", "doc_id",
        F.slice(tx.sentences(F.col("text")), 1, gating.CANDIDATE_SENTENCES).alias("cand"))
    # sample texts of one query in index order, at most K of them
    hyp = ts.stand_in_samples(spark, sf).groupBy("instance_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("sample_index", "md"))), lambda s: s["md"]).alias("mds")) \
        .select("instance_id", F.slice(F.flatten(F.transform("mds", lambda m: tx.sentences(m))), 1,
                                       gating.HYPOTHESIS_SENTENCES).alias("hyp"))
    both = cand.join(hyp, "instance_id")
    return both.select("instance_id", "doc_id", encode.encode_lists(F.col("cand")).alias("cand"),
                       encode.encode_lists(F.col("hyp")).alias("hyp"))


_SQL_SIDES = f"""
top AS (SELECT instance_id, doc_id FROM bm25 WHERE rank = 1),
cs0 AS (SELECT t.instance_id, t.doc_id, list_filter(list_transform(string_split_regex(d.text, '[.\\n;]+'),
  lambda x: {ts.strip('x')}), lambda x: length(x) >= 15)[1:40] AS ss FROM top t JOIN documents d USING (doc_id)),
csent AS (SELECT instance_id, doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS txt FROM cs0),
mds AS (SELECT instance_id, sample_index, '---' || chr(10) || 'name: {tx.STAND_IN_NAME}' || chr(10) || 'description: '
  || task || chr(10) || '---' || chr(10) || {_BODY_SQL} || chr(10)
  || chr(10) || '```python' || chr(10) || '{tx.STAND_IN_CODE}' || chr(10) || '```' AS md FROM st),
hs0 AS (SELECT instance_id, flatten(list(ss ORDER BY sample_index))[1:60] AS ss FROM (
  SELECT instance_id, sample_index, list_filter(list_transform(string_split_regex(md, '[.\\n;]+'),
    lambda x: {ts.strip('x')}), lambda x: length(x) >= 15) AS ss FROM mds) GROUP BY 1),
hsent AS (SELECT instance_id, unnest(range(0, len(ss))) AS hpos, unnest(ss) AS txt FROM hs0),
{ts.sql_embed('ce', 'csent', 'instance_id, doc_id, pos', 'txt')},
{ts.sql_embed('he', 'hsent', 'instance_id, hpos', 'txt')},
sims AS (SELECT c.instance_id, c.doc_id, c.pos, c.hpos, coalesce(s.sim, 0) AS sim
  FROM (SELECT c.instance_id, c.doc_id, c.pos, h.hpos FROM csent c JOIN hsent h USING (instance_id)) c
  LEFT JOIN (SELECT ce.instance_id, ce.pos, he.hpos, sum(ce.w * he.w) AS sim FROM ce
    JOIN he ON he.instance_id = ce.instance_id AND he.bucket = ce.bucket GROUP BY ALL) s
  ON s.instance_id = c.instance_id AND s.pos = c.pos AND s.hpos = c.hpos),
msim AS (SELECT instance_id, doc_id, pos, max(sim) AS sim FROM sims GROUP BY ALL)"""


@_register("two_stage_topk_text", f"""WITH {ts.SQL_QUERIES}, {ts.SQL_CORPUS}, {ts.SQL_BM25}, {_SQL_STAND}, {_SQL_SIDES.split("hs0 AS", 1)[0].rstrip().rstrip(",")},
{_SQL_FUSED_TEXT},
fz AS ({_SQL_RRF}),
{ts.sql_embed('me', 'mds', 'instance_id, sample_index', 'md')},
{ts.sql_embed('fe', 'documents', 'doc_id', 'text')},
hx AS (SELECT instance_id, bucket, sum(w) / 5 AS x FROM (
  SELECT instance_id, bucket, w FROM me UNION ALL SELECT instance_id, bucket, w FROM ae) GROUP BY ALL),
hu AS (SELECT instance_id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY instance_id)) AS w FROM hx),
rs AS (SELECT f.instance_id, f.doc_id, f.rank AS r1, round(coalesce(sum(hu.w * fe.w), 0), 6) AS score
  FROM fz f LEFT JOIN fe ON fe.doc_id = f.doc_id LEFT JOIN hu ON hu.instance_id = f.instance_id AND hu.bucket = fe.bucket GROUP BY ALL)
SELECT instance_id, doc_id, score, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, r1) AS rank FROM rs""")
def two_stage_topk_text(spark, sf):
    """The fused list of each query in the order of whole sample documents and the query."""
    anchors = ts.queries(spark, sf).select("instance_id", encode.encode_text(F.col("query")).alias("vec"))
    smp = ts.stand_in_samples(spark, sf).select(
        "instance_id", "sample_index", encode.encode_text(F.col("md")).alias("vec"))
    fused = written(fused_topk_text(spark, sf), "fused-text")
    # documents on no list are not encoded
    listed = load(spark, sf, "documents").select("doc_id", "text").join(
        sizing.checked_broadcast(fused.select("doc_id").distinct()), "doc_id", "left_semi")
    whole = written(listed.select("doc_id", encode.encode_text(F.col("text")).alias("vec")), "listed-vectors")
    return fusion.rerank_cosine(fused, hypothesis.centroid_with_query(smp, anchors, ts.K),
                                whole, fusion.TOP_K).drop("first_rank")


@_register("max_sim", f"""WITH {ts.SQL_QUERIES}, {ts.SQL_BM25}, {_SQL_STAND}, {_SQL_SIDES}
SELECT instance_id, doc_id, pos, round(sim, 6) AS sim FROM msim""")
def max_sim(spark, sf):
    best = _sentence_sides(spark, sf).select(
        "instance_id", "doc_id",
        F.posexplode(vx.best_match(F.col("cand"), F.col("hyp"))).alias("pos", "sim"))
    return best.select("instance_id", "doc_id", "pos", F.round("sim", 6).alias("sim"))


@_register("gate_s2_text", f"""WITH {ts.SQL_QUERIES}, {ts.SQL_BM25}, {_SQL_STAND}, {_SQL_SIDES}
SELECT t.instance_id, t.doc_id, coalesce(round(avg(CASE WHEN round(m.sim, 9) < 0.6 THEN 1.0 ELSE 0.0 END), 4), 1.0) AS s2
FROM top t LEFT JOIN msim m ON m.instance_id = t.instance_id GROUP BY ALL""")
def gate_s2_text(spark, sf):
    return _sentence_sides(spark, sf).select(
        "instance_id", "doc_id", gating.novelty(F.col("cand"), F.col("hyp")).alias("s2"))


# ------------------------------------------------------------------ scoring of the text run

@_register("planted_gold", f"WITH {ts.SQL_GOLD} SELECT instance_id, doc_id FROM tgold")
def planted_gold(spark, sf):
    return ts.gold(spark, sf)


def bm25_quality(spark, sf):
    """Flagship: mean recall and nDCG of BM25 on the annotated queries."""
    gold = ts.gold(spark, sf)
    run = ts.lexical_index(spark, sf).topk(ts.queries(spark, sf), fusion.TOP_K)
    wanted = gold.select("instance_id").distinct().join(
        ts.queries(spark, sf).select("instance_id", "domain"), "instance_id")
    runs = run.join(wanted, "instance_id")
    out = metrics.mean_metrics(runs, gold, ["domain"], instances=wanted)
    return out.select("domain", "metric", "n", F.round("value", 6).alias("value"))


_register("bm25_quality", f"""WITH {ts.SQL_QUERIES}, {ts.SQL_BM25}, {ts.SQL_GOLD},
w AS (SELECT DISTINCT q.instance_id, q.domain FROM tq q JOIN tgold USING (instance_id)),
ng AS (SELECT instance_id, count(*) AS n FROM tgold GROUP BY 1),
h AS (SELECT b.instance_id, b.rank FROM bm25 b JOIN tgold g USING (instance_id, doc_id) WHERE rank <= 50),
dep(d) AS (VALUES (1), (5), (10), (50)),
pi AS (SELECT w.domain, w.instance_id, d,
  count(h.rank) / any_value(ng.n) AS rec,
  coalesce(sum(1 / log2(h.rank + 1)), 0) / any_value((SELECT sum(1 / log2(i + 1)) FROM range(1, 51) r(i) WHERE i <= least(ng.n, d))) AS nd
  FROM w CROSS JOIN dep JOIN ng USING (instance_id) LEFT JOIN h ON h.instance_id = w.instance_id AND h.rank <= d
  GROUP BY ALL)
SELECT domain, 'Recall@' || d AS metric, count(*) AS n, round(avg(rec), 6) AS value FROM pi GROUP BY ALL
UNION ALL SELECT domain, 'nDCG@' || d, count(*), round(avg(nd), 6) FROM pi GROUP BY ALL""")(bm25_quality)
