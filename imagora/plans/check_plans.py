"""Registered queries that hold files, packs, routers and runs against what they should be."""

from __future__ import annotations

from pyspark.sql import functions as F

from imagora.functions import prompts
from imagora.operators import checks, file_checks, gating, metrics, routing, samples, splits
from imagora.plans import eval_plans, ledger_plans
from imagora.plans import eval_setup as es
from imagora.plans import text_setup as ts
from imagora.plans import vector_setup as vs
from imagora.plans.tables import load, once, stage_path
from imagora.plans.text_plans import sql_templates
from imagora.sources import json_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VARIANTS = ("hypo_sentence", "hypo_passage", "hypo_skill", "fused", "two_stage")


def _register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


def sql_digest(name: str, source: str, group: str, cols: tuple[str, ...]) -> str:
    """CTEs ending in ``name``(group, n, digest): the order-free digest of a table's rows."""
    parts = ", ".join(f"length({c}::VARCHAR), {c}::VARCHAR" for c in cols)
    words = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS w{i}" for i in range(8))
    line = ", ".join(f"w{i}" for i in range(8))
    return f"""
{name}_r AS (SELECT {group}, sha256(concat_ws(':', {parts})) AS h FROM {source}),
{name}_f AS (SELECT {group}, substr(h, 1, 2) AS b, count(*) AS n, {words} FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {group}, sum(n)::BIGINT AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
  SELECT {group}, n, concat_ws(':', b, n, {line}) AS line FROM {name}_f) GROUP BY ALL)"""


# ------------------------------------------------------------------ run files

def _payload_files(spark, sf):
    """Run files named `<domain>-<variant>.json` as folders of one record per line, each
    line with the file's metadata and metrics, and `.eval.json` ones beside them."""
    path = stage_path(spark, sf, "payload_json")

    def write():
        cells = metrics.mean_metrics(es.annotated_run(spark, sf), vs.gold(spark, sf), ["domain", "variant"]).groupBy(
            "domain", "variant").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"),
            F.max("n").cast("string").alias("n"))
        cells = cells.select("domain", "variant", "metrics", F.create_map(
            F.lit("dataset"), "domain", F.lit("n_queries"), "n", F.lit("top_k"), F.lit("50")).alias("metadata"))
        records = json_files.read_run_records(spark, ledger_plans.run_files(spark, sf)).filter(
            F.size("gold_skill_ids") > 0)
        stem = F.concat_ws("-", "domain", "variant")
        lines = records.join(cells, ["domain", "variant"]).select(
            F.concat(stem, F.lit(".json")).alias("stem"), "metadata", "metrics",
            F.array(F.struct("instance_id", "gold_skill_ids", "retrieved")).alias("results"))
        evals = cells.select(F.concat(stem, F.lit(".eval.json")).alias("stem"), "metadata", "metrics",
                             F.array().cast(lines.schema["results"].dataType).alias("results"))
        lines.unionByName(evals).write.mode("overwrite").partitionBy("stem").json(path)
    once(path, write)
    return path


_SQL_FILES = es.SQL_SCORES + """,
nq AS (SELECT domain, variant, domain || '-' || variant || '.json' AS file, count(*) AS n FROM uni GROUP BY ALL),
nh AS (SELECT domain, variant, count(*) AS hits FROM run JOIN ng USING (instance_id) GROUP BY ALL)"""


@_register("scan_payload", _SQL_FILES + """
SELECT file, 'metadata' AS part, unnest(['dataset', 'n_queries', 'top_k']) AS name, unnest([domain, n::VARCHAR, '50']) AS told, NULL::DOUBLE AS value FROM nq
UNION ALL SELECT domain || '-' || variant || '.json', 'metric', metric, NULL, round(avg(value), 6) FROM ml WHERE d <> 20 GROUP BY domain, variant, metric
UNION ALL SELECT file, 'results', unnest(['records', 'hits']), NULL, unnest([n, hits])::DOUBLE FROM nq JOIN nh USING (domain, variant)""")
def scan_payload(spark, sf):
    """Metadata, metrics and record counts out of every run file."""
    records, meta, values = json_files.read_run_payload(spark, _payload_files(spark, sf), array_file=False)
    nothing = F.lit(None)
    sizes = records.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("retrieved")).alias("hits")) \
        .unpivot("file", ["records", "hits"], "name", "value")
    return meta.distinct().select("file", F.lit("metadata").alias("part"), F.col("key").alias("name"),
                                  F.col("value").alias("told"), nothing.cast("double").alias("value")).unionByName(
        values.distinct().select("file", F.lit("metric").alias("part"), F.col("metric").alias("name"),
                                 nothing.cast("string").alias("told"), F.round("value", 6).alias("value"))).unionByName(
        sizes.select("file", F.lit("results").alias("part"), "name", nothing.cast("string").alias("told"),
                     F.col("value").cast("double").alias("value")))


@_register("scan_named_runs", es.SQL_SCORES + """
SELECT domain AS dataset, variant, instance_id, doc_id, rank FROM run JOIN ng USING (instance_id)""")
def scan_named_runs(spark, sf):
    """Hits of every run file, named by the file; `.eval.json` files are left out."""
    rows = json_files.read_named_runs(spark, _payload_files(spark, sf), array_file=False)
    hits = json_files.explode_hits(rows, ("dataset", "variant"))
    return hits.select("dataset", "variant", F.col("instance_id").cast("bigint").alias("instance_id"),
                       F.col("doc_id").cast("bigint").alias("doc_id"), "rank")


@_register("run_shape", _SQL_FILES + """
SELECT file, 'n_queries' AS field, (n + 1)::VARCHAR AS recorded, n::VARCHAR AS found FROM nq WHERE variant = 'fused'
UNION ALL SELECT file, 'top_k', '20', '50' FROM nq WHERE variant = 'two_stage'
UNION ALL SELECT file, 'dataset', 'other', domain FROM nq WHERE domain = 'd1'""")
def run_shape(spark, sf):
    """Stated domain, depth and query count of the run files against their records; three kinds are altered."""
    records, meta, _ = json_files.read_run_payload(spark, _payload_files(spark, sf), array_file=False)
    told = meta.groupBy("file").agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("dataset", "n_queries", "top_k")])
    variant = json_files.file_identity(F.col("file"))[1]
    told = told.withColumn("_v", variant).withColumns({
        "n_queries": F.col("n_queries").cast("int") + (F.col("_v") == "fused").cast("int"),
        "top_k": F.when(F.col("_v") == "two_stage", F.lit("20")).otherwise(F.col("top_k")),
        "dataset": F.when(F.col("dataset") == "d1", F.lit("other")).otherwise(F.col("dataset"))})
    found = records.groupBy("file").agg(F.count(F.lit(1)).alias("n_queries"), F.max(F.size("retrieved")).alias("top_k"))
    found = found.withColumn("dataset", json_files.file_identity(F.col("file"))[0])
    return checks.reconcile(told, found, ["file"], ["dataset", "n_queries", "top_k"])


@_register("gold_check", es.SQL_SCORES + """,
want AS (SELECT g.instance_id, CASE WHEN q.domain = 'd1' THEN g.doc_id + 1 ELSE g.doc_id END AS doc_id FROM gold g JOIN q USING (instance_id))
SELECT coalesce(g.instance_id, w.instance_id) AS instance_id, coalesce(g.doc_id, w.doc_id) AS doc_id,
  CASE WHEN w.doc_id IS NULL THEN 'extra' ELSE 'missing' END AS side
FROM gold g FULL JOIN want w ON g.instance_id = w.instance_id AND g.doc_id = w.doc_id WHERE w.doc_id IS NULL OR g.doc_id IS NULL""")
def gold_check(spark, sf):
    """Gold documents written in the run files against the annotations; one domain's are shifted."""
    records = json_files.read_run_records(spark, ledger_plans.run_files(spark, sf))
    told = json_files.explode_gold(records).select(F.col("instance_id").cast("bigint").alias("instance_id"),
                                                   F.col("doc_id").cast("bigint").alias("doc_id"))
    want = vs.gold(spark, sf).join(vs.query_ids(spark, sf), "instance_id").select(
        "instance_id", (F.col("doc_id") + (F.col("domain") == "d1").cast("bigint")).alias("doc_id"))
    return checks.gold_differences(told, want)


@_register("metric_coverage", es.SQL_SCORES + f""",
want AS (SELECT domain, instance_id, unnest([{', '.join(f"'{v}'" for v in VARIANTS)}]) AS variant FROM q)
SELECT w.domain, w.variant, count(*) AS wanted, count(u.instance_id) AS covered, count(*) - count(u.instance_id) AS missing,
  min(CASE WHEN u.instance_id IS NULL THEN w.instance_id END) AS first_missing
FROM want w LEFT JOIN uni u USING (domain, variant, instance_id) GROUP BY ALL""")
def metric_coverage(spark, sf):
    """Every query under every variant against the scored run, which lacks queries without gold."""
    wanted = vs.query_ids(spark, sf).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))
    return metrics.coverage(es.annotated_run(spark, sf), wanted, ["domain", "variant"])


# ------------------------------------------------------------------ instances and values

@_register("instance_problems", f"""
WITH i AS (SELECT conv_id AS id, {ts.SQL_DOMAIN.format('text')} AS domain, CASE WHEN turn > 2 THEN ' ' ELSE text END AS query
  FROM conversations WHERE role = 'user')
SELECT id::VARCHAR AS instance_id, 'duplicate' AS problem, count(*) AS n FROM i GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id::VARCHAR, 'domain', count(*) FROM i WHERE domain <> 'short' GROUP BY id
UNION ALL SELECT id::VARCHAR, 'empty', count(*) FROM i WHERE trim(query) = '' GROUP BY id""")
def instance_problems(spark, sf):
    """User turns as annotated queries of one domain: repeated ids, other domains, blank questions."""
    path = stage_path(spark, sf, "problem_json")
    once(path, lambda: load(spark, sf, "conversations").filter(F.col("role") == "user").select(
        F.col("conv_id").cast("string").alias("instance_id"), ts.domain_of(F.col("text")).alias("dataset"),
        F.when(F.col("turn") > 2, F.lit(" ")).otherwise(F.col("text")).alias("question"),
        F.array(F.lit("any")).alias("skill_annotations")).write.mode("overwrite").json(path))
    rows = json_files.read_instances(spark, path, array_file=False)
    found = json_files.instance_problems(rows, "short")
    repeats = rows.groupBy("instance_id").agg(F.count(F.lit(1)).alias("_n"))
    per = found.groupBy("instance_id", "problem").agg(F.count(F.lit(1)).alias("n")).join(repeats, "instance_id")
    return per.select("instance_id", "problem", F.when(
        F.col("problem") == "duplicate", F.col("_n")).otherwise(F.col("n")).alias("n"))


# what each shape of the written values must fail
_FAILS = {
    "click": "boolean list string", "view": "integer boolean list string",
    "purchase": "integer number finite boolean string",
    "error": "object present integer number finite boolean list string",
    "signup": "object present integer number finite boolean list string",
}


@_register("value_rules", "WITH f(event_type, rule) AS (VALUES " + ", ".join(
    f"('{t}', '{r}')" for t, rules in _FAILS.items() for r in rules.split()) + """)
SELECT event_type, rule, count(*) AS n FROM events JOIN f USING (event_type) GROUP BY ALL""")
def value_rules(spark, sf):
    """Types of values in JSON text: whole and broken numbers, lists, other roots, no JSON at all."""
    ev = load(spark, sf, "events")
    shape = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"v": '), F.col("event_id").cast("string"), F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"v": '), F.col("event_id").cast("string"), F.lit(".25}")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"v": ['), F.col("event_id").cast("string"), F.lit("]}")))
        .when(F.col("event_type") == "error", F.lit('{"v": '))
        .otherwise(F.lit("[true]")))
    rows = ev.select("event_id", "event_type", shape.alias("payload"))
    found = checks.violations(rows, ["event_id", "event_type"], checks.value_rules("payload", "$.v"))
    return found.groupBy("event_type", "rule").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ packs and stored samples

_SQL_KEYS = ledger_plans._SQL_GRIDQ + """,
tagged AS (SELECT *, 'stand-in|' || substr(template_text, 1, 20) AS tag FROM grid),
keyed AS (SELECT query, template, sample_index, sha256(concat_ws(':', length(tag), tag, 3, '0.7', length(template_text), template_text,
  length(query), query, length(sample_index::VARCHAR), sample_index)) AS sample_key FROM tagged)"""


@_register("audit_errors", _SQL_KEYS + f"""
SELECT template, sample_index, sample_key, rank::INTEGER AS rank FROM (
  SELECT k.*, row_number() OVER (PARTITION BY template, sample_index ORDER BY sample_key) AS rank
  FROM keyed k LEFT JOIN st2 s USING (query, template, sample_index) WHERE s.text IS NULL OR s.text = '')
WHERE rank <= {samples.ERROR_EXAMPLES}""")
def audit_errors(spark, sf):
    """The first failing keys of each template and index, as an audit reports them."""
    return samples.audit_errors(ledger_plans._grid(spark, sf), ledger_plans._stored(spark, sf)).select(
        "template", F.col("sample_index").cast("bigint").alias("sample_index"), "sample_key", "rank")


@_register("prefix_queries", f"""WITH {ts.SQL_CONV},
i AS (SELECT DISTINCT instance_id, domain FROM cs)
SELECT instance_id, CASE domain WHEN 'long' THEN 'absent' ELSE 'query' END AS problem FROM i WHERE domain IN ('long', 'short')
UNION ALL SELECT -1 - instance_id, 'extra' FROM i WHERE domain = 'long'""")
def prefix_queries(spark, sf):
    """Query rows of two packs: long queries under other ids, short ones with an added mark."""
    big = ts.conversation_samples(spark, sf).select("instance_id", "domain", "query")
    small = big.select(
        F.when(F.col("domain") == "long", -1 - F.col("instance_id")).otherwise(F.col("instance_id")).alias("instance_id"),
        F.when(F.col("domain") == "short", F.concat("query", F.lit("!"))).otherwise(F.col("query")).alias("query"))
    return samples.query_differences(big, small)


# ------------------------------------------------------------------ digests

@_register("manifest_digests", f"""WITH {sql_templates()},
d1 AS (SELECT lang, doc_id, text, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS told FROM documents),
{sql_digest('fd', 'd1', 'lang', ('doc_id', 'text'))}, {sql_digest('rd', 'd1', 'lang', ('doc_id', 'told'))},
b AS (SELECT lang, sum(strlen(told))::BIGINT AS told, sum(strlen(text))::BIGINT AS bytes FROM d1 GROUP BY 1),
m AS (SELECT 'lang:' || lang AS item, rd.digest AS rdig, fd.digest AS fdig, b.told AS rb, b.bytes AS fb FROM fd JOIN rd USING (lang) JOIN b USING (lang)
  UNION ALL SELECT 'template:' || template, sha256(template_text || CASE WHEN template = 'skill' THEN chr(10) ELSE '' END), sha256(template_text),
    strlen(template_text) + (template = 'skill')::INT, strlen(template_text) FROM tpl)
SELECT item, 'digest' AS field, rdig AS recorded, fdig AS found FROM m WHERE rdig <> fdig
UNION ALL SELECT item, 'bytes', rb::VARCHAR, fb::VARCHAR FROM m WHERE rb <> fb""")
def manifest_digests(spark, sf):
    """Digests and bytes of texts and templates; German texts and one template end otherwise in the manifest."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "text")

    def items(rows, templates):
        digest = checks.table_digest(rows, ["lang"], ["doc_id", "text"]).join(
            rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")), "lang")
        tpl = spark.range(1).select(F.explode(prompts.template_rows(templates)).alias("t")).select(
            F.concat(F.lit("template:"), "t.template").alias("item"), F.sha2("t.template_text", 256).alias("digest"),
            F.octet_length("t.template_text").cast("bigint").alias("bytes"))
        return digest.select(F.concat(F.lit("lang:"), "lang").alias("item"), "digest", "bytes").unionByName(tpl)

    told = docs.withColumn("text", F.concat("text", F.when(F.col("lang") == "de", F.lit("!")).otherwise(F.lit(""))))
    altered = {n: t + "\n" if n == "skill" else t for n, t in prompts.TEMPLATES.items()}
    return checks.reconcile(items(told, altered), items(docs, prompts.TEMPLATES), ["item"], ["digest", "bytes"])


@_register("json_digests", """
SELECT doc_id, sha256(concat('{"doc_id":', doc_id, ',"lang":', coalesce(to_json(lang)::VARCHAR, 'null'), ',"n_chars":', coalesce(n_chars::VARCHAR, 'null'),
  ',"source":', coalesce(to_json(source)::VARCHAR, 'null'), ',"text":', coalesce(to_json(text)::VARCHAR, 'null'), '}')) AS digest FROM documents""")
def json_digests(spark, sf):
    """Digest of each document's canonical JSON."""
    docs = load(spark, sf, "documents")
    cols = ["text", "source", "n_chars", "lang", "doc_id"]
    return docs.select("doc_id", file_checks.json_digest(docs, cols).alias("digest"))


@_register("file_problems", """
WITH f AS (SELECT item_id, 'item_id=' || item_id AS path, strlen(text) + 1 AS bytes, sha256(text || chr(10)) AS sha256 FROM benchmark)
SELECT path, 'unlisted' AS problem, NULL::VARCHAR AS recorded, bytes::VARCHAR AS found FROM f WHERE item_id % 6 IN (0, 1)
UNION ALL SELECT '../' || path, 'outside', '../' || path, NULL FROM f WHERE item_id % 6 = 0
UNION ALL SELECT 'new/' || path, 'missing', bytes::VARCHAR, NULL FROM f WHERE item_id % 6 = 1
UNION ALL SELECT path, 'bytes', (bytes + 1)::VARCHAR, bytes::VARCHAR FROM f WHERE item_id % 6 = 2
UNION ALL SELECT path, 'sha256', sha256(sha256), sha256 FROM f WHERE item_id % 6 = 3
UNION ALL SELECT path, 'repeated', '2', NULL FROM f WHERE item_id % 6 = 4""")
def file_problems(spark, sf):
    """One file per benchmark item against a manifest whose records go wrong in five ways."""
    root = stage_path(spark, sf, "benchmark-files")
    items = load(spark, sf, "benchmark").select("item_id", "text")
    once(root, lambda: items.repartition("item_id").write.mode("overwrite").partitionBy("item_id").text(root))
    # a folder holds one part; its name is the item's, whatever the part is called
    files = file_checks.file_digests(spark, root).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    rest, path = F.col("item_id") % 6, F.concat(F.lit("item_id="), F.col("item_id").cast("string"))
    told = F.when(rest == 0, F.concat(F.lit("../"), path)).when(rest == 1, F.concat(F.lit("new/./"), path)).otherwise(path)
    digest = F.sha2(F.concat("text", F.lit("\n")), 256)
    manifest = items.select(
        F.explode(F.when(rest == 4, F.array(told, F.concat(F.lit("x/../"), told))).otherwise(F.array(told))).alias("path"),
        (F.octet_length("text") + 1 + (rest == 2).cast("int")).cast("bigint").alias("bytes"),
        F.when(rest == 3, F.sha2(digest, 256)).otherwise(digest).alias("sha256"))
    return file_checks.file_problems(manifest, files)


@_register("restamp_evidence", f"""
WITH b AS (SELECT event_type AS file, event_id, event_type AS rev, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS rev2 FROM events),
{sql_digest('bd', 'b', 'file', ('event_id', 'rev'))}, {sql_digest('ad', 'b', 'file', ('event_id', 'rev2'))}
SELECT file, CASE file WHEN 'click' THEN 'migrated' WHEN 'view' THEN 'already_current' ELSE 'rejected' END AS action,
  bd.n, bd.digest AS before_sha256, ad.digest AS after_sha256 FROM bd JOIN ad USING (file)""")
def restamp_evidence(spark, sf):
    meta = load(spark, sf, "events").select(F.col("event_type").alias("file"), "event_id",
                                            F.col("event_type").alias("source_revision"))
    return checks.restamp_evidence(meta, ["file"], ["event_id", "source_revision"], "click", "view")


# ------------------------------------------------------------------ router and gate

_SQL_BLOCK = es.SQL_ROUTER + f""",
ids0 AS (SELECT domain, instance_id FROM val WHERE is_validation),
ids1 AS (SELECT domain, instance_id FROM (SELECT domain, instance_id, count(*) OVER (PARTITION BY domain) AS n,
    row_number() OVER (PARTITION BY domain ORDER BY md5('1:' || instance_id), instance_id) AS rn FROM val)
  WHERE rn <= greatest(1, floor(0.2::DOUBLE * n))),
{sql_digest('g0', 'ids0', 'domain', ('instance_id',))}, {sql_digest('g1', 'ids1', 'domain', ('instance_id',))},
vsc1 AS (SELECT domain, variant, avg(nd) AS score FROM pi JOIN ids1 USING (domain, instance_id) WHERE d = 10 GROUP BY ALL),
r1 AS (SELECT domain, CASE WHEN max(score) <= 0 THEN 'hypo_skill' ELSE first(variant ORDER BY round(score, 10) DESC, o) END AS pick,
  max(score) <= 0 AS degenerate FROM vsc1 JOIN ord USING (variant) GROUP BY 1),
cmp AS (SELECT domain, a.pick AS p0, b.pick AS p1, a.degenerate AS d0, b.degenerate AS d1, g0.n AS n0, g1.n AS n1, g0.digest AS h0, g1.digest AS h1
  FROM router a JOIN r1 b USING (domain) JOIN g0 USING (domain) JOIN g1 USING (domain))"""


@_register("router_block", _SQL_BLOCK + """
SELECT domain, p0 AS pick, 'nDCG@10' AS validation_metric, 0.2::DOUBLE AS validation_fraction, 0 AS seed, n0 AS n_validation,
  h0 AS validation_ids_sha256, d0 AS degenerate FROM cmp""")
def router_block(spark, sf):
    """The block a routed run carries about how its variant was picked."""
    return checks.router_block(es.router(spark, sf), es.validation(spark, sf), splits.VAL_FRACTION, splits.VAL_SEED)


@_register("router_block_check", _SQL_BLOCK + """
SELECT domain, 'pick' AS field, p0 AS recorded, p1 AS found FROM cmp WHERE p0 <> p1
UNION ALL SELECT domain, 'seed', '0', '1' FROM cmp
UNION ALL SELECT domain, 'n_validation', n0::VARCHAR, n1::VARCHAR FROM cmp WHERE n0 <> n1
UNION ALL SELECT domain, 'validation_ids_sha256', h0, h1 FROM cmp WHERE h0 <> h1
UNION ALL SELECT domain, 'degenerate', d0::VARCHAR, d1::VARCHAR FROM cmp WHERE d0 <> d1""")
def router_block_check(spark, sf):
    """The recorded blocks against routers drawn with another seed: every field that disagrees."""
    again = splits.validation_split(es.validation(spark, sf).select("domain", "instance_id"), seed=1)
    found = checks.router_block(routing.route(es.ndcg10(spark, sf), again), again, splits.VAL_FRACTION, 1)
    told = router_block(spark, sf)
    return checks.reconcile(told, found, ["domain"], [c for c in told.columns if c != "domain"])


def _sql_levels() -> str:
    o = eval_plans.ORACLE
    return f"""
WITH lv AS (
  SELECT domain, CASE level WHEN 'champion' THEN 'L1' ELSE 'L0' END AS level, ndcg FROM ({o['route_l0_l1']}) a WHERE level IN ('champion', 'hypo_skill')
  UNION ALL SELECT domain, 'L2a', ndcg FROM ({o['route_l2a']}) b
  UNION ALL SELECT domain, 'L2b1', round(sum(ndcg_sum) / sum(picked), 6) FROM ({o['route_l2b1']}) c GROUP BY domain
  UNION ALL SELECT domain, 'L2b3', round(sum(ndcg_sum) / sum(picked), 6) FROM ({o['route_l2b3']}) d GROUP BY domain
  UNION ALL SELECT domain, 'oracle', ndcg FROM ({o['route_oracle']}) f WHERE domain <> '{metrics.MACRO}')
SELECT domain, level, ndcg FROM lv UNION ALL SELECT '{metrics.MACRO}', level, round(avg(ndcg), 8) FROM lv GROUP BY level"""


@_register("route_levels", _sql_levels())
def route_levels(spark, sf):
    """All routing levels side by side, with the mean over the domains of each."""
    q = eval_plans.QUERIES
    fixed = q["route_l0_l1"](spark, sf).filter(F.col("level").isin("champion", "hypo_skill")).select(
        "domain", F.when(F.col("level") == "champion", F.lit("L1")).otherwise(F.lit("L0")).alias("level"), "ndcg")
    out = fixed.unionByName(q["route_l2a"](spark, sf).select("domain", F.lit("L2a").alias("level"), "ndcg"))
    for name in ("L2b1", "L2b3"):
        picked = q[f"route_{name.lower()}"](spark, sf).groupBy("domain").agg(
            F.round(F.sum("ndcg_sum") / F.sum("picked"), 6).alias("ndcg"))
        out = out.unionByName(picked.select("domain", F.lit(name).alias("level"), "ndcg"))
    best = q["route_oracle"](spark, sf).filter(F.col("domain") != metrics.MACRO)
    out = out.unionByName(best.select("domain", F.lit("oracle").alias("level"), "ndcg"))
    # the domain rows are few: one per domain and level
    macro = out.groupBy("level").agg(F.round(F.avg("ndcg"), 8).alias("ndcg"))
    return out.unionByName(macro.select(F.lit(metrics.MACRO).alias("domain"), "level", "ndcg"))


@_register("signal_misses", es.SQL_SIGNALS + """,
asked AS (SELECT DISTINCT domain, instance_id FROM routed),
st AS (SELECT a.*, CASE WHEN d.decision <> 'kept' THEN 'no_hits' WHEN a.instance_id IN (SELECT instance_id FROM samp WHERE template = 'skill')
  THEN 'scored' ELSE 'no_samples' END AS st FROM asked a LEFT JOIN dec d USING (domain, instance_id))
SELECT domain, count(*) AS asked, count(CASE WHEN st = 'no_hits' THEN 1 END) AS no_hits,
  count(CASE WHEN st = 'no_samples' THEN 1 END) AS no_samples, count(CASE WHEN st = 'scored' THEN 1 END) AS scored FROM st GROUP BY 1""")
def signal_misses(spark, sf):
    """What a second look at the gated run would skip: emptied lists, and queries without samples."""
    routed = es.routed(spark, sf)
    first = gating.top1(gating.apply_gate(routed, es.decisions(spark, sf)))
    return gating.signal_misses(routed.select("domain", "instance_id").distinct(), first, vs.sampled_ids(spark, sf))
