"""Registered queries on files, stored samples, cost and lineage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from imagora.functions import prompts
from imagora.functions import text as tx
from imagora.functions.hashing import row_digest
from imagora.operators import checks, cost, encode, gating, metrics, packs, ranking, routing, samples
from imagora.plans import eval_setup as es
from imagora.plans import text_setup as ts
from imagora.plans import vector_setup as vs
from imagora.plans.tables import load, once, stage_path
from imagora.plans.text_plans import sql_templates
from imagora.sources import json_files, vector_store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


# ------------------------------------------------------------------ files

_BODY, _CODE = ts.sql_fields("content")


@_register("scan_corpus", f"""WITH {ts.SQL_CORPUS},
r AS (SELECT c.doc_id, l.doc_id IS NOT NULL AS has_record, c.text,
  {ts.sql_meta('name', 'description')} AS meta, {_BODY} AS body, {_CODE} AS code FROM corpus c LEFT JOIN labels l USING (doc_id))
SELECT doc_id, has_record, md5(CASE WHEN has_record THEN meta ELSE substr(text, 1, 200) END) AS meta,
  md5(CASE WHEN has_record THEN body ELSE text END) AS body, CASE WHEN has_record THEN code ELSE '' END AS code FROM r""")
def scan_corpus(spark, sf):
    """Records exist for labelled documents; the others fall back to their text."""
    path = stage_path(spark, sf, "corpus_json")
    once(path, lambda: ts.corpus(spark, sf).join(load(spark, sf, "labels"), "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("skill_id"), "name", "description", "content")
        .write.mode("overwrite").json(path))
    records = json_files.read_corpus(spark, path, array_file=False).withColumn(
        "doc_id", F.col("doc_id").cast("bigint"))
    out = json_files.corpus_fields(load(spark, sf, "documents").select("doc_id", "text"), records)
    return out.select("doc_id", "has_record", F.md5("meta").alias("meta"), F.md5("body").alias("body"), "code")


@_register("scan_queries", f"""WITH {ts.SQL_QUERIES}, {ts.SQL_GOLD}
SELECT q.instance_id::VARCHAR AS instance_id, q.domain, md5(q.query) AS query, count(*) AS n_gold
FROM tq q JOIN tgold USING (instance_id) GROUP BY ALL""")
def scan_queries(spark, sf):
    path = stage_path(spark, sf, "instances_json")

    def write():
        gold = ts.gold(spark, sf).groupBy("instance_id").agg(
            F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("skill_annotations"))
        ts.queries(spark, sf).join(gold, "instance_id", "left").select(
            F.col("instance_id").cast("string").alias("instance_id"), F.col("domain").alias("dataset"),
            F.col("query").alias("question"),
            F.coalesce("skill_annotations", F.array().cast("array<string>")).alias("skill_annotations"),
        ).write.mode("overwrite").json(path)
    once(path, write)
    rows = json_files.read_instances(spark, path, array_file=False)
    return rows.select("instance_id", "domain", F.md5("query").alias("query"),
                       F.size("gold").cast("bigint").alias("n_gold"))


def run_files(spark, sf):
    path = stage_path(spark, sf, "run_json")
    once(path, lambda: json_files.write_run_records(vs.run(spark, sf), vs.gold(spark, sf), path))
    return path


@_register("scan_run", vs.sql_run() + """
SELECT domain, variant, instance_id, doc_id, rank, round(score, 6) AS score FROM run""")
def scan_run(spark, sf):
    records = json_files.read_run_records(spark, run_files(spark, sf))
    hits = json_files.explode_hits(records, ("domain", "variant"))
    return hits.select("domain", "variant", F.col("instance_id").cast("bigint").alias("instance_id"),
                       F.col("doc_id").cast("bigint").alias("doc_id"), "rank",
                       F.round("score", 6).alias("score"))


def _pack_files(spark, sf):
    path = stage_path(spark, sf, "pack_jsonl")

    def write():
        s = ts.conversation_samples(spark, sf)
        p = samples.as_instance_packs(samples.prefix_pack(s, None, ("instance_id", "domain", "query")),
                                      ("instance_id", "domain", "query"))
        json_files.write_jsonl(p.withColumn("instance_id", F.col("instance_id").cast("string")), path,
                               ["instance_id"])
    once(path, write)
    return path


@_register("scan_pack", f"""WITH {ts.SQL_CONV}
SELECT instance_id::VARCHAR AS instance_id, domain, template, sample_index, md5(text) AS text FROM cs""")
def scan_pack(spark, sf):
    rows = json_files.pack_texts(json_files.read_packs(spark, _pack_files(spark, sf)))
    return rows.select("instance_id", "domain", "template", "sample_index", F.md5("text").alias("text"))


@_register("write_jsonl", f"""WITH {ts.SQL_CONV},
i AS (SELECT DISTINCT instance_id::VARCHAR AS instance_id FROM cs)
SELECT instance_id, row_number() OVER (ORDER BY instance_id) AS position FROM i""")
def write_jsonl(spark, sf):
    """Line positions in the written order, over all part files."""
    lines = spark.read.text(_pack_files(spark, sf)).select(
        F.get_json_object("value", "$.instance_id").alias("instance_id"),
        F.col("_metadata.file_name").alias("part"),
        F.monotonically_increasing_id().alias("_m"))
    per_part = Window.partitionBy("part").orderBy("_m")
    parts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("_c"))
    before = parts.select("part", (F.sum("_c").over(Window.orderBy("part")) - F.col("_c")).alias("_o"))
    return lines.withColumn("_r", F.row_number().over(per_part)).join(before, "part").select(
        "instance_id", (F.col("_o") + F.col("_r")).alias("position"))


def _outcome_files(spark, sf):
    path = stage_path(spark, sf, "outcome_json")

    def write():
        rows = es.outcomes(spark, sf).withColumn("stem", F.concat(
            "domain", F.lit("-arm-"), "arm", F.lit(".json")))
        # an outcome per line: a fragment of the file that scans alike
        rows.select("stem", F.array(F.struct(
            F.col("instance_id").cast("string").alias("instance_id"), "correct")).alias("details")) \
            .write.mode("overwrite").partitionBy("stem").json(path)
    once(path, write)
    return path


@_register("scan_outcomes", es.SQL_SIGNALS + """
SELECT instance_id, count(*) AS arms, count(CASE WHEN correct THEN 1 END) AS correct FROM outc GROUP BY 1""")
def scan_outcomes(spark, sf):
    rows = json_files.read_outcomes(spark, _outcome_files(spark, sf), array_file=False)
    return rows.groupBy(F.col("instance_id").cast("bigint").alias("instance_id")).agg(
        F.count(F.lit(1)).alias("arms"), F.count_if("correct").alias("correct"))


@_register("scan_by_filename", es.SQL_SIGNALS + """
SELECT domain AS dataset, 'arm-' || arm AS variant, count(*) AS n, count(CASE WHEN correct THEN 1 END) AS correct
FROM outc GROUP BY ALL""")
def scan_by_filename(spark, sf):
    raw = spark.read.schema(json_files.OUTCOMES).json(_outcome_files(spark, sf))
    named = raw.select(F.regexp_replace(F.col("_metadata.file_path"), r".*stem=", "").alias("_p"), "details")
    rows = named.select(*json_files.file_identity(F.col("_p")), F.explode("details").alias("d"))
    return rows.groupBy("dataset", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("d.correct").alias("correct"))


@_register("decode_loaded", """
WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN ['u' || user_id, 'e' || event_id]
  WHEN 'view' THEN ['u' || user_id] WHEN 'error' THEN []::VARCHAR[] WHEN 'purchase' THEN ['[''u' || user_id]
  ELSE ['it''s ' || user_id] END AS l FROM events)
SELECT event_id, len(l) AS n_loaded, array_to_string(l, '|') AS loaded FROM s""")
def decode_loaded(spark, sf):
    """List text, a bare scalar, nothing, a broken list, and a quoted scalar."""
    ev = load(spark, sf, "events")
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    raw = (
        F.when(F.col("event_type") == "click", F.concat(
            F.lit("['"), u, F.lit("', \"e"), F.col("event_id").cast("string"), F.lit('"]')))
        .when(F.col("event_type") == "view", u)
        .when(F.col("event_type") == "error", F.lit(" "))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("['"), u))
        .otherwise(F.concat(F.lit("\"it's "), F.col("user_id").cast("string"), F.lit('"'))))
    d = ev.select("event_id", tx.decode_list(raw).alias("l"))
    return d.select("event_id", F.size("l").cast("bigint").alias("n_loaded"),
                    F.array_join("l", "|").alias("loaded"))


@_register("vector_cache", f"""WITH {ts.sql_embed('emb', 'documents', 'doc_id', 'text')},
n AS (SELECT doc_id, count(*) AS n_nonzero FROM emb GROUP BY 1)
SELECT d.doc_id, coalesce(n.n_nonzero, 0) AS n_nonzero,
  d.text IN (SELECT text FROM documents JOIN labels USING (doc_id)) AS reused FROM documents d LEFT JOIN n USING (doc_id)""")
def vector_cache(spark, sf):
    """Labelled texts are stored first; only contents not stored are encoded."""
    path = stage_path(spark, sf, "vectors")
    docs = load(spark, sf, "documents").select("doc_id", "text")
    first = stage_path(spark, sf, "vector_digests")

    def write():
        vector_store.add_vectors(docs.join(load(spark, sf, "labels"), "doc_id", "left_semi"), path, "hashed64")
        vector_store.stored(spark, path, "hashed64").select("content_digest").write.mode("overwrite").parquet(first)
        todo = encode.missing_vectors(docs, spark.read.parquet(first))
        vector_store.add_vectors(todo.select("doc_id", "text"), path, "hashed64")
    once(path, write)
    old = spark.read.parquet(first).withColumn("reused", F.lit(True))
    vecs = vector_store.vectors_of(docs, path, "hashed64")
    flags = docs.select("doc_id", F.sha2("text", 256).alias("content_digest")).join(
        old, "content_digest", "left")
    return vecs.join(flags, "doc_id").select(
        "doc_id", F.size(F.filter("vec", lambda x: x != 0)).cast("bigint").alias("n_nonzero"),
        F.coalesce("reused", F.lit(False)).alias("reused"))


@_register("pack_samples", es.SQL_ROUTER + """,
pk AS (SELECT domain, instance_id FROM (SELECT domain, instance_id,
  row_number() OVER (PARTITION BY domain ORDER BY md5('0:' || instance_id), instance_id) AS rn
  FROM (SELECT DISTINCT domain, instance_id FROM uni)) WHERE rn <= 10)
SELECT p.domain, p.instance_id,
  (SELECT count(*) FROM samp s WHERE s.instance_id = p.instance_id) AS n_samples,
  (SELECT count(*) FROM run r WHERE r.instance_id = p.instance_id AND rank <= 3) AS n_tops,
  (SELECT string_agg(r.variant || ':' || r.doc_id, ',' ORDER BY r.variant, r.rank) FROM run r WHERE r.instance_id = p.instance_id AND rank <= 3) AS tops,
  (SELECT count(*) FROM run r JOIN documents d USING (doc_id) WHERE r.instance_id = p.instance_id AND rank <= 3) AS n_named,
  (SELECT count(*) FROM gold g WHERE g.instance_id = p.instance_id) AS n_gold FROM pk p""")
def pack_samples(spark, sf):
    """Ten instances per domain with samples, named top documents and gold."""
    ids = es.scores(spark, sf).select("domain", "instance_id").distinct()
    picks = ranking.sample_per_group(ids, ["domain"], ["instance_id"], 10, seed=0)
    smp = vs.samples(spark, sf).select("instance_id", "template", "sample_index",
                                       F.col("sample_label").cast("string").alias("text"))
    q = vs.query_ids(spark, sf).select("instance_id", F.concat(F.lit("vector "), F.col("instance_id").cast("string")).alias("query"))
    pack = packs.sample_pack(picks, q, smp, es.annotated_run(spark, sf), ts.corpus(spark, sf), vs.gold(spark, sf))
    tops = F.transform("tops", lambda t: F.concat(t["variant"], F.lit(":"), t["doc_id"].cast("string")))
    return pack.select(
        "domain", "instance_id", F.coalesce(F.size("imaginations"), F.lit(0)).cast("bigint").alias("_s"),
        F.size("tops").cast("bigint").alias("n_tops"), F.array_join(tops, ",").alias("tops"),
        F.size(F.filter("tops", lambda t: t["name"] != "")).cast("bigint").alias("n_named"),
        F.size("gold").cast("bigint").alias("n_gold"),
    ).withColumn("n_samples", F.greatest("_s", F.lit(0))).drop("_s")


# ------------------------------------------------------------------ stored samples

MODEL = "stand-in"


#: The largest K of the experiments: the grid of every audit and generation.
GRID_K = max(vs.K_VALUES)


def _grid(spark, sf, k=GRID_K):
    return samples.required_grid(ts.conversation_samples(spark, sf), k, MODEL)


def _stored(spark, sf, k=GRID_K):
    """Conversation answers keyed like the grid; short ones blank, long ones unreadable.

    Of several conversations with one query, the first one's answer stands.
    """
    have = ts.conversation_samples(spark, sf).select(
        "query", "template", "sample_index", "instance_id", "text").groupBy("query", "template", "sample_index").agg(
        F.min_by("text", F.struct("instance_id", "text")).alias("text"))
    text = F.when(F.length("text") < 200, F.lit("")).when(
        F.length("text") > 2500, F.lit(None).cast("string")).otherwise(F.col("text"))
    return _grid(spark, sf, k).join(have, ["query", "template", "sample_index"]).select(
        "sample_key", text.alias("text"))


_SQL_GRIDQ = f"""WITH {ts.SQL_CONV}, {sql_templates()},
grid AS (SELECT query, template, template_text, i AS sample_index, replace(template_text, '{{q}}', query) AS prompt
  FROM (SELECT DISTINCT query FROM cs), tpl, range({GRID_K}) r(i)),
st AS (SELECT query, template, sample_index, arg_min(text, (instance_id, text)) AS text FROM cs GROUP BY ALL),
st2 AS (SELECT query, template, sample_index, CASE WHEN length(text) < 200 THEN '' WHEN length(text) > 2500 THEN NULL ELSE text END AS text FROM st)"""


@_register("sample_keys", _SQL_GRIDQ + """,
parts AS (SELECT template, sample_index, md5(query) AS query, 'stand-in|' || substr(template_text, 1, 20) AS tag, template_text, query AS qt, sample_index AS si FROM grid)
SELECT template, sample_index, query, sha256(concat_ws(':', length(tag), tag, 3, '0.7', length(template_text), template_text,
  length(qt), qt, length(si::VARCHAR), si)) AS sample_key FROM parts""")
def sample_keys(spark, sf):
    return _grid(spark, sf).select("template", "sample_index", F.md5("query").alias("query"), "sample_key")


def _offline_client(frame: pd.DataFrame) -> pd.Series:
    """Refuses any batch holding a prompt with a sharp s, else answers in a fixed form."""
    if frame["prompt"].str.contains("ß").any():
        raise RuntimeError("refused")
    return f"---\nname: {tx.STAND_IN_NAME}\n---\n" + frame["prompt"].str.slice(-120)


def _generated(spark, sf):
    return samples.generate_missing(_grid(spark, sf), _stored(spark, sf), _offline_client)


@_register("generate_missing", _SQL_GRIDQ + f"""
SELECT md5(g.query) AS query, g.template, g.sample_index, CASE WHEN g.prompt LIKE '%ß%' THEN 'failed' ELSE 'generated' END AS status,
  CASE WHEN g.prompt LIKE '%ß%' THEN NULL ELSE md5('---' || chr(10) || 'name: {tx.STAND_IN_NAME}' || chr(10) || '---' || chr(10) || right(g.prompt, 120)) END AS text
FROM grid g LEFT JOIN st2 s USING (query, template, sample_index) WHERE s.query IS NULL""")
def generate_missing(spark, sf):
    return _generated(spark, sf).select(F.md5("query").alias("query"), "template", "sample_index",
                                        "status", F.md5("text").alias("text"))


@_register("warm_counts", _SQL_GRIDQ + """
SELECT g.template, CASE WHEN s.query IS NOT NULL THEN 'cached' WHEN g.prompt LIKE '%ß%' THEN 'failed' ELSE 'generated' END AS status, count(*) AS n
FROM grid g LEFT JOIN st2 s USING (query, template, sample_index) GROUP BY ALL""")
def warm_counts(spark, sf):
    cached = _grid(spark, sf).join(_stored(spark, sf), "sample_key", "left_semi").select(
        "template", F.lit("cached").alias("status"))
    return cached.unionByName(_generated(spark, sf).select("template", "status")).groupBy(
        "template", "status").agg(F.count(F.lit(1)).alias("n"))


@_register("cache_audit", _SQL_GRIDQ + """
SELECT g.template, g.sample_index, count(*) AS expected, count(CASE WHEN s.text <> '' THEN 1 END) AS present,
  count(CASE WHEN s.query IS NULL THEN 1 END) AS missing, count(CASE WHEN s.text = '' THEN 1 END) AS empty,
  count(CASE WHEN s.query IS NOT NULL AND s.text IS NULL THEN 1 END) AS unreadable,
  count(CASE WHEN s.text <> '' THEN 1 END) = count(*) AS complete
FROM grid g LEFT JOIN st2 s USING (query, template, sample_index) GROUP BY ALL""")
def cache_audit(spark, sf):
    return samples.audit(_grid(spark, sf), _stored(spark, sf))


@_register("prefix_pack", f"""WITH {ts.SQL_CONV}
SELECT instance_id, template, count(*) AS n, count(*) = 2 AS usable, md5(string_agg(text, chr(10) ORDER BY sample_index)) AS texts
FROM cs WHERE sample_index < 2 GROUP BY ALL""")
def prefix_pack(spark, sf):
    p = samples.prefix_pack(ts.conversation_samples(spark, sf), 2)
    return p.select("instance_id", "template", F.col("n").cast("bigint").alias("n"), "usable",
                    F.md5(F.array_join("texts", "\n")).alias("texts"))


@_register("prefix_check", f"""WITH {ts.SQL_CONV},
i AS (SELECT DISTINCT instance_id, template, domain FROM cs)
SELECT instance_id, template, CASE WHEN domain = 'long' THEN 'absent' ELSE 'differs' END AS problem
FROM i WHERE domain = 'long' OR template = 'passage'
UNION ALL SELECT -1 - instance_id, template, 'extra' FROM cs WHERE domain = 'long' AND sample_index < 2 GROUP BY ALL""")
def prefix_check(spark, sf):
    """The two-sample pack, with long queries under other ids and passages altered."""
    s = ts.conversation_samples(spark, sf)
    altered = s.withColumn("text", F.when(
        F.col("template") == "passage", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn(
        "instance_id", F.when(F.col("domain") == "long", -1 - F.col("instance_id")).otherwise(F.col("instance_id")))
    return samples.prefix_violations(samples.prefix_pack(s), samples.prefix_pack(altered, 2), 2)


def _chain_sql(name, source):
    """CTE of chained digests of every K of (instance_id, template, sample_index, text) rows."""
    return f"""{name}t AS (SELECT instance_id, template, list_transform(list_sort(list({{'i': sample_index, 't': text}})), lambda x: x.t) AS texts
  FROM {source} WHERE sample_index < {GRID_K} GROUP BY ALL),
{name} AS (SELECT instance_id, template, k_samples::INTEGER AS k_samples, least(k_samples, len(texts))::INTEGER AS n,
    list_reduce(list_prepend('', texts[1:k_samples]), lambda d, t: sha256(d || ':' || strlen(t) || ':1:' || t)) AS digest
  FROM {name}t, (VALUES {', '.join(f'({k})' for k in vs.K_VALUES)}) kk(k_samples))"""


@_register("prefix_digests", f"""WITH {ts.SQL_CONV}, {_chain_sql('ch', 'cs')}
SELECT instance_id, template, k_samples, n, digest FROM ch""")
def prefix_digests(spark, sf):
    """The digest of the first K samples of every query, for every K."""
    return samples.chained_digests(samples.prefix_pack(ts.conversation_samples(spark, sf), GRID_K), vs.K_VALUES)


@_register("prefix_proofs", f"""WITH {ts.SQL_CONV},
al AS MATERIALIZED (SELECT CASE WHEN domain = 'long' THEN -1 - instance_id ELSE instance_id END AS instance_id, template, sample_index,
    CASE WHEN template = 'skill' AND sample_index = 2 THEN text || '!' ELSE text END AS text FROM cs),
{_chain_sql('ch', 'cs')}, {_chain_sql('ca', 'al')}
SELECT template, k_samples, count(CASE WHEN a.digest = b.digest THEN 1 END) AS same, count(CASE WHEN a.digest <> b.digest THEN 1 END) AS differs,
  count(CASE WHEN b.digest IS NULL THEN 1 END) AS absent, count(CASE WHEN a.digest IS NULL THEN 1 END) AS extra
FROM ch a FULL JOIN ca b USING (instance_id, template, k_samples) GROUP BY ALL""")
def prefix_proofs(spark, sf):
    """Packs of every K against packs with long queries under other ids and the third skill sample altered."""
    s = ts.conversation_samples(spark, sf)
    third = (F.col("template") == "skill") & (F.col("sample_index") == 2)
    altered = s.withColumn("text", F.when(third, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn(
        "instance_id", F.when(F.col("domain") == "long", -1 - F.col("instance_id")).otherwise(F.col("instance_id")))
    digests = lambda rows: samples.chained_digests(samples.prefix_pack(rows, GRID_K), vs.K_VALUES)
    return samples.prefix_proofs(digests(s), digests(altered))


@_register("dup_query_check", f"""WITH {ts.SQL_CONV},
w AS (SELECT lower(string_split_regex(query, '\\s+')[1]) AS query, template, instance_id, sample_index, text FROM cs),
p AS (SELECT query, template, instance_id, string_agg(sample_index || ':' || text, chr(1) ORDER BY sample_index) AS sig FROM w GROUP BY ALL)
SELECT query, template, count(*) AS instances, count(DISTINCT sig) AS variants FROM p GROUP BY ALL""")
def dup_query_check(spark, sf):
    """Queries reduced to their first word, so that texts repeat with other samples."""
    s = ts.conversation_samples(spark, sf).withColumn(
        "query", F.lower(F.get(F.split("query", r"\s+"), F.lit(0))))
    return samples.duplicate_query_report(s)


@_register("reuse_audit", es.SQL_SIGNALS + """,
old AS (SELECT instance_id, 'always' AS arm, doc_id FROM run WHERE variant = 'hypo_skill' AND rank = 1
  UNION ALL SELECT r.instance_id, 'gated', r.doc_id FROM run r JOIN dec d USING (instance_id) WHERE variant = 'hypo_skill' AND rank = 1 AND decision = 'kept'),
want AS (SELECT instance_id, 'always' AS arm, top1 AS doc_id FROM dec
  UNION ALL SELECT instance_id, 'gated', CASE WHEN decision = 'kept' THEN top1 END FROM dec)
SELECT w.instance_id, w.arm, CASE WHEN o.instance_id IS NULL THEN 'needs_inference' WHEN o.doc_id = w.doc_id THEN 'reused_same_arm' ELSE 'rejected' END AS status,
  CASE WHEN o.instance_id IS NULL THEN 'legacy_record_missing' WHEN o.doc_id = w.doc_id THEN 'identical_loading' ELSE 'loading_differs' END AS reason
FROM want w LEFT JOIN old o USING (instance_id, arm)""")
def reuse_audit(spark, sf):
    """Outcomes of the fixed variant judged against what the routed arms load."""
    dec = es.decisions(spark, sf)
    wanted = packs.loading_arms(dec, vs.gold(spark, sf)).filter(F.col("arm").isin("always", "gated"))
    first = gating.top1(vs.run(spark, sf).filter("variant = 'hypo_skill'")).select(
        "instance_id", F.array("top1").alias("loaded"))
    kept = dec.filter("decision = 'kept'").select("instance_id")
    old = first.withColumn("arm", F.lit("always")).unionByName(
        first.join(kept, "instance_id").withColumn("arm", F.lit("gated")))
    return samples.reuse_audit(wanted, old)


# ------------------------------------------------------------------ cost

def _cost_rows(spark, sf):
    """(instance_id, domain, template, query, prompt, texts) per conversation, up to the largest K texts."""
    p = samples.prefix_pack(ts.conversation_samples(spark, sf), GRID_K, ("instance_id", "domain", "query"))
    tpl = F.create_map(*[F.lit(x) for kv in prompts.TEMPLATES.items() for x in kv])
    return p.select("instance_id", "domain", "template", "query", "texts",
                    prompts.render(F.element_at(tpl, F.col("template")), F.col("query")).alias("prompt"))


def _per_k(rows):
    """The rows once for every K, with the first K texts."""
    ks = rows.withColumn("k_samples", F.explode(F.array(*[F.lit(k).cast("bigint") for k in vs.K_VALUES])))
    return ks.withColumn("texts", F.slice("texts", F.lit(1), F.col("k_samples").cast("int")))


_SQL_COST = f"""WITH {ts.SQL_CONV}, {sql_templates()},
kk(k_samples) AS (VALUES {', '.join(f'({k}::BIGINT)' for k in vs.K_VALUES)}),
cr AS (SELECT k_samples, instance_id, domain, template, query, length(replace(any_value(template_text), '{{q}}', query)) AS prompt_chars,
    sum(length(text)) AS output_chars, count(*) AS generations
  FROM cs JOIN tpl USING (template) JOIN kk ON sample_index < k_samples GROUP BY k_samples, instance_id, domain, template, query),
fo AS (SELECT cr.* FROM cr JOIN (SELECT query, min(instance_id) AS instance_id FROM cr GROUP BY 1) USING (query, instance_id)),
tt AS (SELECT k_samples, 'template' AS scope, '' AS domain, template, count(*) AS queries, sum(prompt_chars)::BIGINT AS prompt_chars,
    sum(output_chars)::BIGINT AS output_chars, sum(generations)::BIGINT AS generations FROM cr GROUP BY k_samples, template
  UNION ALL SELECT k_samples, 'domain_template', domain, template, count(*), sum(prompt_chars)::BIGINT, sum(output_chars)::BIGINT, sum(generations)::BIGINT
    FROM cr GROUP BY k_samples, domain, template
  UNION ALL SELECT k_samples, 'unique_queries', '', template, count(*), sum(prompt_chars)::BIGINT, sum(output_chars)::BIGINT, sum(generations)::BIGINT
    FROM fo GROUP BY k_samples, template)"""


@_register("text_totals", _SQL_COST + " SELECT * FROM tt")
def text_totals(spark, sf):
    rows = _cost_rows(spark, sf)
    per = cost.text_totals(_per_k(rows), ["k_samples", "domain", "template"]).withColumn("scope", F.lit("domain_template"))
    total = cost.sum_totals(per, ["k_samples", "template"]).select(
        "*", F.lit("").alias("domain"), F.lit("template").alias("scope"))
    uniq = cost.text_totals(_per_k(samples.first_occurrence(rows, "query", ["instance_id"])), ["k_samples", "template"]).select(
        "*", F.lit("").alias("domain"), F.lit("unique_queries").alias("scope"))
    return per.unionByName(total).unionByName(uniq)


_SQL_TOK = ("round(prompt_chars * k_samples / 3.8::DOUBLE, 6) AS input_tokens, round(output_chars / 3.8::DOUBLE, 6) AS output_tokens, "
            "round((prompt_chars * k_samples / 3.8::DOUBLE + output_chars / 3.8::DOUBLE) / queries, 6) AS total_per_query, "
            "round(output_chars / 3.8::DOUBLE / generations, 6) AS output_per_generation")


def _tok_cols(df, *keys):
    return df.select(*keys, "queries", "generations", *[
        F.round(c, 6).alias(c) for c in ("input_tokens", "output_tokens", "total_per_query", "output_per_generation")])


@_register("token_cost", _SQL_COST + f" SELECT k_samples, template, queries, generations, {_SQL_TOK} FROM tt WHERE scope = 'template'")
def token_cost(spark, sf):
    """Tokens of every K: the prompt is paid once a sample."""
    totals = cost.text_totals(_per_k(_cost_rows(spark, sf)), ["k_samples", "template"])
    return _tok_cols(cost.token_cost(totals, F.col("k_samples")), "k_samples", "template")


@_register("routed_cost", _SQL_COST + f""",
rt AS (SELECT k_samples, domain, arg_max(template, output_chars) AS template FROM tt WHERE scope = 'domain_template' GROUP BY ALL),
s AS (SELECT k_samples, sum(queries)::BIGINT AS queries, sum(prompt_chars) AS prompt_chars, sum(output_chars) AS output_chars,
    sum(generations)::BIGINT AS generations
  FROM tt JOIN rt USING (k_samples, domain, template) WHERE scope = 'domain_template' GROUP BY k_samples)
SELECT k_samples, queries, generations, {_SQL_TOK} FROM s""")
def routed_cost(spark, sf):
    """Each domain routed to the template with the most text, for every K."""
    per = cost.text_totals(_per_k(_cost_rows(spark, sf)), ["k_samples", "domain", "template"])
    router = per.groupBy("k_samples", "domain").agg(
        F.concat(F.lit("hypo_"), F.max_by("template", "output_chars")).alias("pick"))
    routed = cost.sum_totals(cost.routed_totals(router, per, ["k_samples", "domain"]), ["k_samples"])
    return _tok_cols(cost.token_cost(routed, F.col("k_samples")), "k_samples")


@_register("cost_audit", _SQL_COST + """,
smp AS (SELECT query FROM (SELECT query, row_number() OVER (ORDER BY md5('0:' || query), query) AS rn FROM (SELECT DISTINCT query FROM cs)) WHERE rn <= 150),
cand AS (SELECT avg(length('[' || doc_id || '] ' || source || ': ' || lang)) / 3.8 AS tok FROM (SELECT * FROM (
  SELECT *, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 500))
SELECT 'imagine_' || template AS item, round(avg(length(replace(template_text, '{q}', query))) / 3.8, 6) AS tokens FROM smp, tpl GROUP BY template
UNION ALL SELECT 'query', round(avg(length(query)) / 3.8, 6) FROM smp
UNION ALL SELECT 'rerank_50', round(50 * (SELECT tok FROM cand) + avg(length(query)) / 3.8, 6) FROM smp""")
def cost_audit(spark, sf):
    """Token estimate of an imagination prompt against a 50-candidate prompt, on
    150 seeded queries and 500 seeded documents."""
    one = F.lit(1).alias("g")
    smp = ranking.sample_per_group(ts.conversation_samples(spark, sf).select("query").distinct().select(one, "query"),
                                   ["g"], ["query"], 150, seed=0)
    docs = ranking.sample_per_group(load(spark, sf, "documents").select(one, "doc_id", "source", "lang"),
                                    ["g"], ["doc_id"], 500, seed=1)
    line = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "source", F.lit(": "), "lang")
    cand = docs.agg((F.avg(F.length(line)) / cost.CHARS_PER_TOKEN).alias("t")).scalar()
    imagine = smp.select("query", F.explode(prompts.template_rows()).alias("t")).groupBy(
        F.concat(F.lit("imagine_"), F.col("t.template")).alias("item")).agg(
        (F.avg(F.length(prompts.render(F.col("t.template_text"), F.col("query")))) / cost.CHARS_PER_TOKEN).alias("tokens"))
    q = smp.agg((F.avg(F.length("query")) / cost.CHARS_PER_TOKEN).alias("t"))
    rows = imagine.unionByName(q.select(F.lit("query").alias("item"), F.col("t").alias("tokens"))).unionByName(
        q.select(F.lit("rerank_50").alias("item"), (F.col("t") + 50 * cand).alias("tokens")))
    return rows.withColumn("tokens", F.round("tokens", 6))


@_register("timing_rollup", """
WITH s AS (SELECT user_id AS model, value - 1.0::DOUBLE AS seconds FROM events),
p AS (SELECT model, count(*) AS stages, count(CASE WHEN seconds < 0 THEN 1 END) AS rejected, sum(CASE WHEN seconds >= 0 THEN seconds END) AS t FROM s GROUP BY 1)
SELECT c_custkey AS model, CASE WHEN stages IS NULL THEN 'unavailable' WHEN rejected > 0 THEN 'invalid' ELSE 'recorded' END AS status,
  coalesce(stages, 0) AS stages, coalesce(rejected, 0) AS rejected, round(t, 6) AS total_seconds
FROM customer LEFT JOIN p ON p.model = c_custkey""")
def timing_rollup(spark, sf):
    stages = load(spark, sf, "events").select(F.col("user_id").alias("model"), (F.col("value") - 1.0).alias("seconds"))
    wanted = load(spark, sf, "customer").select(F.col("c_custkey").alias("model"))
    return cost.timing_rollup(wanted, stages, ["model"]).withColumn("total_seconds", F.round("total_seconds", 6))


# ------------------------------------------------------------------ checks

@_register("rule_violations", """
WITH d AS (SELECT *, sha256(text) AS digest FROM documents)
SELECT doc_id, rule, field, value FROM (
  SELECT doc_id, 'min_chars' AS rule, 'n_chars' AS field, n_chars::VARCHAR AS value, n_chars >= 200 AS ok FROM d
  UNION ALL SELECT doc_id, 'text', 'lang', lang, length(trim(lang)) > 0 FROM d
  UNION ALL SELECT doc_id, 'known_source', 'source', source, source IN ('src1', 'src2', 'src3') OR lang = 'en' FROM d
  UNION ALL SELECT doc_id, 'digest', 'digest', digest, regexp_matches(digest, '\\A[0-9a-f]{64}\\z') FROM d
  UNION ALL SELECT doc_id, 'digest', 'text', text, regexp_matches(text, '\\A[0-9a-f]{64}\\z') FROM d WHERE false)
WHERE NOT ok""")
def rule_violations(spark, sf):
    docs = load(spark, sf, "documents").withColumn("digest", F.sha2("text", 256))
    rules = {
        "min_chars": ("n_chars", F.col("n_chars") >= 200),
        "text": ("lang", checks.is_text(F.col("lang"))),
        "known_source": ("source", F.col("source").isin("src1", "src2", "src3") | (F.col("lang") == "en")),
        "digest": ("digest", checks.is_digest(F.col("digest"))),
    }
    return checks.violations(docs, ["doc_id"], rules)


@_register("validate_run", es.SQL_SIGNALS + """
SELECT domain, instance_id, 'missing' AS problem, 0::BIGINT AS detail FROM dec WHERE decision <> 'kept'""")
def validate_run(spark, sf):
    """The gated run against the routed instances: emptied lists are missing."""
    gated = gating.apply_gate(es.routed(spark, sf), es.decisions(spark, sf))
    expected = es.routed(spark, sf).select("domain", "instance_id").distinct()
    return checks.validate_run(gated, expected, ["domain"])


@_register("metric_drift", es.SQL_SCORES + """,
g AS (SELECT domain, variant, metric, avg(value) AS value FROM ml WHERE d <> 20 GROUP BY ALL)
SELECT domain, variant, metric, CASE WHEN variant = 'fused' THEN 'missing'
  WHEN abs(round(value, 4) - value) > 1e-9 THEN 'drift' ELSE 'ok' END AS status FROM g""")
def metric_drift(spark, sf):
    """Means stored with four digits, those of the fused variant under another name."""
    grid = metrics.mean_metrics(es.annotated_run(spark, sf), vs.gold(spark, sf), ["domain", "variant"])
    stored = grid.withColumn("value", F.round("value", 4)).withColumn("variant", F.when(
        F.col("variant") == "fused", F.lit("fused_old")).otherwise(F.col("variant")))
    return checks.metric_drift(grid, stored, ["domain", "variant", "metric"]).select(
        "domain", "variant", "metric", "status")


_SQL_DIGEST = """
rd AS (SELECT lang, sha256(concat_ws(':', length(doc_id::VARCHAR), doc_id, length(text), text)) AS h FROM documents),
fb AS (SELECT lang, substr(h, 1, 2) AS b, count(*) AS n, """ + ", ".join(
    f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS w{i}" for i in range(8)) + """ FROM rd GROUP BY ALL),
fd AS (SELECT lang, sum(n)::BIGINT AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
  SELECT lang, n, concat_ws(':', b, n, """ + ", ".join(f"w{i}" for i in range(8)) + """) AS line FROM fb) GROUP BY 1)"""


@_register("table_digest", f"WITH {_SQL_DIGEST} SELECT lang, n, digest FROM fd")
def table_digest(spark, sf):
    return checks.table_digest(load(spark, sf, "documents"), ["lang"], ["doc_id", "text"])


@_register("manifest_check", """
WITH a AS (SELECT lang, count(*) AS n_rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1),
m AS (SELECT CASE WHEN lang = 'es' THEN 'spa' ELSE lang END AS lang, count(DISTINCT text) AS n_rows, sum(n_chars)::BIGINT AS chars
  FROM documents GROUP BY 1)
SELECT lang, field, recorded, found FROM (
  SELECT lang, 'n_rows' AS field, m.n_rows::VARCHAR AS recorded, a.n_rows::VARCHAR AS found FROM a FULL JOIN m USING (lang)
  UNION ALL SELECT lang, 'chars', m.chars::VARCHAR, a.chars::VARCHAR FROM a FULL JOIN m USING (lang))
WHERE recorded IS DISTINCT FROM found""")
def manifest_check(spark, sf):
    """A manifest that counts distinct texts and names one language otherwise."""
    docs = load(spark, sf, "documents")
    actual = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("chars"))
    renamed = F.when(F.col("lang") == "es", F.lit("spa")).otherwise(F.col("lang"))
    manifest = docs.withColumn("lang", renamed).groupBy("lang").agg(
        F.count_distinct("text").alias("n_rows"), F.sum("n_chars").alias("chars"))
    return checks.reconcile(manifest, actual, ["lang"], ["n_rows", "chars"])


@_register("stamp_run", es.SQL_ROUTER + """
SELECT domain, pick, 'hashed64' AS encoder, 4 AS k_samples, sha256(concat_ws(':', length(domain), domain, length(pick), pick)) AS artifact_sha256 FROM router""")
def stamp_run(spark, sf):
    meta = es.router(spark, sf).select("domain", "pick")
    stamped = checks.stamp(
        meta, {"encoder": F.lit("hashed64"), "k_samples": F.lit(vs.K), "domain": F.col("domain")},
        {"artifact_sha256": row_digest(F.col("domain"), F.col("pick"))})
    return stamped.select("domain", "pick", "identity.encoder", "identity.k_samples", "cache.artifact_sha256")


@_register("pack_check", es.SQL_SCORES + """
SELECT variant, count(*) AS n_rows, true AS same_digest FROM run JOIN ng USING (instance_id) WHERE rank <= 10 GROUP BY 1""")
def pack_check(spark, sf):
    """Digest of the exported top-10 hits against the run they came from."""
    run = es.annotated_run(spark, sf)
    cols = ["instance_id", "rank", "doc_id"]
    packed = packs.top_pack(run, vs.gold(spark, sf), 10).select(
        "variant", "instance_id", F.posexplode("hits").alias("pos", "h")).select(
        "variant", "instance_id", (F.col("pos") + 1).alias("rank"), F.col("h.doc_id").alias("doc_id"))
    a = checks.table_digest(packed, ["variant"], cols)
    b = checks.table_digest(run.filter("rank <= 10"), ["variant"], cols)
    return a.join(b.select("variant", F.col("digest").alias("_d")), "variant").select(
        "variant", F.col("n").alias("n_rows"), (F.col("digest") == F.col("_d")).alias("same_digest"))


@_register("restamp_revision", """
SELECT CASE event_type WHEN 'click' THEN 'migrated' WHEN 'view' THEN 'already_current' ELSE 'rejected' END AS action,
  CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS source_revision, count(*) AS n FROM events GROUP BY ALL""")
def restamp_revision(spark, sf):
    meta = load(spark, sf, "events").select("event_id", F.col("event_type").alias("source_revision"))
    return checks.restamp(meta, "click", "view").groupBy("action", "source_revision").agg(
        F.count(F.lit(1)).alias("n"))


@_register("router_check", es.SQL_ROUTER + """,
ord2(variant, o) AS (VALUES ('hypo_sentence', 1), ('hypo_passage', 2), ('hypo_skill', 3), ('fused', 4), ('two_stage', 5)),
r2 AS (SELECT domain, CASE WHEN max(score) <= 0 THEN 'hypo_skill' ELSE first(variant ORDER BY round(score, 10) DESC, o) END AS pick
  FROM vsc JOIN ord2 USING (variant) GROUP BY 1)
SELECT router.domain, router.pick AS recorded, r2.pick AS recomputed, router.pick = r2.pick AS agrees, n_val, n_variants = 5 AS strict
FROM router JOIN r2 USING (domain)""")
def router_check(spark, sf):
    """Recorded picks against a recomputation in the strict variant order."""
    again = routing.route(es.ndcg10(spark, sf), es.validation(spark, sf), routing.STRICT_ORDER)
    rec = es.router(spark, sf).select("domain", F.col("pick").alias("recorded"), "n_val")
    return rec.join(again.select("domain", F.col("pick").alias("recomputed"), "n_variants"), "domain").select(
        "domain", "recorded", "recomputed", (F.col("recorded") == F.col("recomputed")).alias("agrees"),
        "n_val", (F.col("n_variants") == len(routing.STRICT_ORDER)).alias("strict"))


@_register("provenance_counts", """
SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS cohort, d.lang AS level,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'complete' WHEN l.doc_id IS NULL THEN 'open' ELSE 'rejected' END AS status, count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def provenance_counts(spark, sf):
    j = load(spark, sf, "documents").select("doc_id", "lang").join(
        load(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("complete")).when(
        F.col("known").isNull(), F.lit("open")).otherwise(F.lit("rejected"))
    return j.select(
        F.when(F.col("known").isNull(), F.lit("unlabelled")).otherwise(F.lit("labelled")).alias("cohort"),
        F.col("lang").alias("level"), status.alias("status")).groupBy("cohort", "level", "status").agg(
        F.count(F.lit(1)).alias("n"))
