"""The corpus operators bound to the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.llm import (
    ann, decontam, htmltext, langid, licenses, linededup, mixing, prefixtrie, separators, sharding, simhash,
    spelling, toolcalls)
from imagora.llm.licenserules import BASE, RULES, WINDOW


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_rendezvous_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in one of 24 equal shards, and where it goes with a 25th."""
    return sharding.shard_documents(_table(spark, sf, "documents"))


def op2_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every user and system turn as a tool call, with the next turn as its result."""
    linked = toolcalls.link_calls(*toolcalls.from_conversations(_table(spark, sf, "conversations")))
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op3_separator_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-token files of all documents, scanned for the separator."""
    return separators.token_counts(_table(spark, sf, "documents")).select("doc_id", "file", "doc_no", "start", "n_tokens")


def op4_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.fingerprint_groups(_table(spark, sf, "documents"))


def op5_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_latent_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontam.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_byte_cnn_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(_table(spark, sf, "documents"))


def op8_style_tree_text(spark: SparkSession, sf: str) -> DataFrame:
    return htmltext.extract_pages(_table(spark, sf, "pages"))


def op9_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_collision_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(_table(spark, sf, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every frequent word with its near words, its form and the end of its forms."""
    return spelling.group_spellings(_table(spark, sf, "documents"))


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every prefix that rebuilt conversations share, or end at."""
    return prefixtrie.conversation_trie(_table(spark, sf, "conversations"))


def op13_license_rules(spark: SparkSession, sf: str) -> DataFrame:
    """License labels of every document."""
    return licenses.label_documents(_table(spark, sf, "documents")).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_rendezvous_shards, op2_tool_calls, op3_separator_scan, op4_simhash_groups, op5_mix_sources, op6_latent_leaks,
    op7_byte_cnn_language, op8_style_tree_text, op9_line_runs, op10_collision_neighbours, op11_spelling_variants,
    op12_conversation_trie, op13_license_rules)}

# CRC-32 by bytes; the table k is made from the polynomial
_CRC = ("xor(CAST(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), "
        "lambda b: ('0x' || b)::BIGINT)), lambda c, d: xor(c >> 8, k[(xor(c, d) & 255) + 1])) AS BIGINT), 4294967295)")

_VALUES = ", ".join(f"({r.number}, '{r.keyword}', '{r.pattern}', '{r.label}', {r.priority}, {r.weight}::DOUBLE)" for r in RULES)



def _rounds(name: str, start: str, docs: str) -> str:
    """The rounds that fill the gaps of ``start`` (source, gap, slack) with rows of ``docs``, as a recursive table."""
    took = "gap - coalesce(max(cum) FILTER (cum <= gap), 0)"
    return f"""{name} AS (SELECT source, 0 AS i, CAST(gap AS BIGINT) AS gap, slack, CAST(NULL AS BIGINT) AS lim, '' AS cut,
    9223372036854775807 AS top, true AS more FROM {start}
    UNION ALL SELECT source, i + 1, {took}, slack, top, CASE WHEN bool_or(cum > gap)
      THEN coalesce(max(key) FILTER (cum <= gap), cut) ELSE '~' END, ({took}) // 2, coalesce(bool_or(cum > gap), false)
    FROM (SELECT {name}.*, d.key, CAST(sum(d.size) OVER (PARTITION BY {name}.source ORDER BY d.key) AS BIGINT) AS cum
      FROM {name} LEFT JOIN {docs} d ON d.source IS NOT DISTINCT FROM {name}.source AND d.size <= {name}.top AND d.key > {name}.cut
      WHERE more AND gap > slack) GROUP BY source, i, gap, slack, top, cut),
{name}_end AS (SELECT source, min(gap) AS gap, coalesce(list(struct_pack(lim := lim, cut := cut)) FILTER (i > 0), []) AS steps
    FROM {name} GROUP BY source)"""


ORACLE = {
    "op1_rendezvous_shards": f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS k),
base AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
scored AS (SELECT doc_id, t, key, list_transform(range(25), lambda s: struct_pack(
    score := -ln((('0x' || substr(md5(key || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE),
    shard := s)) AS own FROM base),
placed AS (SELECT doc_id, CAST(strlen(t) + 8 AS BIGINT) AS size, {_CRC} AS text_crc32,
    CAST(list_min(own[1:24]).shard AS INTEGER) AS shard, CAST(list_min(own).shard AS INTEGER) AS grown_shard,
    ('0x' || substr(md5(key), 1, 8))::BIGINT % 4096 AS bucket FROM scored, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (
    PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed""",
    "op5_mix_sources": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
    FROM d GROUP BY source),
lam AS (SELECT *, 2 * s / w AS r, 1.5::DOUBLE * sum(s) OVER () - 2 * coalesce(sum(s) OVER (ORDER BY 2 * s / w
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY 2 * s / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM src),
level AS (SELECT arg_min(rest / ws, r) FILTER (r >= rest / ws) AS l FROM lam),
tgt AS (SELECT source, s, round(least(2.0::DOUBLE * s, w * l), 6) AS target FROM lam, level),
plan AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE least(2, CAST(round(target) AS BIGINT) // s) END AS copies FROM tgt),
want AS (SELECT *, CASE WHEN copies < 2 THEN CAST(round(target) AS BIGINT) - copies * s ELSE 0 END AS gap,
    CAST(round(target) AS BIGINT) // 1000 AS slack FROM plan),
{_rounds("fill", "want", "d")},
run AS (SELECT d.*, s, target, copies, slack, want.gap AS rest, f.gap,
      len(list_filter(steps, lambda x: size <= x.lim AND key <= x.cut)) > 0 AS hit
    FROM d JOIN want ON d.source IS NOT DISTINCT FROM want.source JOIN fill_end f ON d.source IS NOT DISTINCT FROM f.source),
rest AS (SELECT source, key, size, gap, slack, rest, count(*) * size AS total FROM run WHERE NOT hit AND size > 0
    GROUP BY source, key, size, gap, slack, rest),
near AS (SELECT source, arg_min(struct_pack(key := key, size := size), (abs(total - gap), key, size)) AS x FROM rest
    WHERE abs(total - gap) < gap GROUP BY source),
longer AS (SELECT source, any_value(slack) AS slack, any_value(gap) AS was, CAST(min(total - gap) AS BIGINT) AS gap,
    arg_min(struct_pack(key := key, size := size), (total, key, size)) AS x FROM rest
    WHERE gap > slack AND total > gap AND total < gap + rest GROUP BY source),
hits AS (SELECT source, key, size FROM run WHERE hit),
{_rounds("back", "longer", "hits")},
swap AS (SELECT p.source, x, steps FROM longer p JOIN back_end b ON p.source IS NOT DISTINCT FROM b.source WHERE b.gap < was),
pick AS (SELECT run.*, coalesce(swap.x, near.x) AS x, steps FROM run LEFT JOIN swap ON run.source IS NOT DISTINCT FROM swap.source
    LEFT JOIN near ON run.source IS NOT DISTINCT FROM near.source)
SELECT doc_id, size, s AS source_size, target, CAST(size * (copies + CASE WHEN x.key = key AND x.size = size OR hit AND
    coalesce(len(list_filter(steps, lambda y: size <= y.lim AND key <= y.cut)), 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM pick""",
    "op9_line_runs": """
WITH l AS (SELECT doc_id, md5(coalesce(text, '')) AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
rep AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, rep.key IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone FROM k LEFT JOIN rep USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id, r""",
    "op2_tool_calls": """
WITH t AS (SELECT *, conv_id || ':' || turn AS id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT *, conv_id || ':' || (turn - 2) AS parent, CASE WHEN role = 'user' THEN 'ask' ELSE 'instruct' END AS tool
    FROM t WHERE role IN ('user', 'system')),
res AS (SELECT conv_id || ':' || (turn - 1) AS id, count(*) AS n, min(text) AS content FROM t WHERE role = 'assistant' GROUP BY 1),
lev AS (SELECT id, conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, isle ORDER BY turn) - 1 AS level FROM (
    SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS isle FROM calls)),
j AS (SELECT c.*, level, coalesce(n, 0) AS n, content, json_object('n_chars', length(text), 'text', text, 'turn', c.turn)::VARCHAR AS arguments
    FROM calls c JOIN lev USING (id) LEFT JOIN res USING (id))
SELECT id AS call_id, tool, level, n AS n_results, tool = 'ask' AS valid,
    CASE WHEN tool = 'ask' THEN '' ELSE 'unknown n_chars' END AS errors,
    '{"arguments":' || arguments || ',"id":"' || id || '","level":' || level || ',"name":"' || tool || '","result":'
    || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json FROM j""",
    # words one edit apart share what is left when one letter is taken out of one or of both
    "op11_spelling_variants": f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS k),
r AS (SELECT id, run, count(*) AS m, id || ':' || run AS t FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY id, run),
h AS (SELECT run, m, {_CRC} AS h FROM r, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m
    FROM h),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cut AS (SELECT DISTINCT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN v b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS other, max(v.n) AS top
    FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form,
    CASE WHEN top >= 5 * n THEN top END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
walk AS (SELECT word, word AS root, form AS next FROM f
    UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN walk ON f.word = walk.word AND walk.next IS NULL""",
    "op12_conversation_trie": f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS k),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS m, CAST(conv_id AS VARCHAR) AS t FROM o GROUP BY conv_id),
h AS (SELECT conv_id, m, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM c, tab),
g AS (SELECT h.*, least(h.h, coalesce(b.m, 0)) AS got FROM h LEFT JOIN c b ON b.conv_id = base),
r AS (SELECT g.conv_id, i AS pos, role, text FROM g JOIN o ON o.conv_id = base AND i < h
    UNION ALL SELECT g.conv_id, i - h + got, role, text FROM g JOIN o ON o.conv_id = g.conv_id AND i >= h),
path AS (SELECT conv_id, pos + 1 AS depth, length(text) AS size,
    string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
total AS (SELECT conv_id, max(depth) AS m FROM path GROUP BY conv_id),
node AS (SELECT path, any_value(depth) AS depth, any_value(size) AS size, min(path.conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(path.conv_id::VARCHAR, ',' ORDER BY path.conv_id) FILTER (depth = m), '') AS ends
    FROM path JOIN total USING (conv_id) GROUP BY path),
kids AS (SELECT a.path, count(b.path) AS kids FROM node a LEFT JOIN node b
    ON b.depth = a.depth + 1 AND left(b.path, 64 * a.depth::INT) = a.path GROUP BY a.path),
sub AS (SELECT a.path, sum((b.n - 1) * b.size) AS saved, count(*) FILTER (kids = 0) AS leaves
    FROM node a JOIN node b ON starts_with(b.path, a.path) JOIN kids ON kids.path = b.path GROUP BY a.path)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, kids AS n_children,
    leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN kids USING (path) JOIN sub USING (path)
LEFT JOIN node up ON up.depth = node.depth - 1 AND left(node.path, 64 * up.depth::INT) = up.path""",
    "op13_license_rules": f"""
WITH rules(number, keyword, pattern, label, priority, weight) AS (VALUES {_VALUES}),
base(phrase, label) AS (VALUES {", ".join(f"('{phrase} ', '{label}')" for phrase, label in BASE)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
wins AS (SELECT r, i - 1 AS start, w[i] AS word, array_to_string(w[i:i + {WINDOW - 1}], ' ') || ' ' AS win FROM places
    WHERE w[i] IN (SELECT keyword FROM rules UNION SELECT split_part(phrase, ' ', 1) FROM base)),
found AS (SELECT r, start, label, priority, weight, number, regexp_extract(win, '^(?:' || pattern || ') ') AS m
    FROM wins JOIN rules ON word = keyword),
det AS (SELECT *, start + length(m) - length(replace(m, ' ', '')) AS stop FROM found WHERE m <> ''),
lost AS (SELECT DISTINCT a.r, a.start, a.number FROM det a JOIN det b ON a.r = b.r AND b.start <= a.start AND b.stop >= a.stop
    AND (b.priority > a.priority OR b.priority = a.priority AND (b.start < a.start OR b.stop > a.stop OR b.number < a.number))),
kept AS (SELECT det.* FROM det ANTI JOIN lost USING (r, start, number)),
hits AS (SELECT r, start, label FROM wins JOIN base ON starts_with(win, phrase)),
b AS (SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, list_sort(list(DISTINCT label)) AS l FROM hits GROUP BY r),
k AS (SELECT r, list_sort(list(DISTINCT label)) AS l, max(weight) AS top FROM (
    SELECT r, label, weight FROM kept UNION ALL SELECT r, label, 0.6::DOUBLE FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
    coalesce(array_to_string(b.l, ','), '') AS base_labels, coalesce(array_to_string(k.l, ','), '') AS labels,
    coalesce(top, 0)::DOUBLE AS score FROM d LEFT JOIN b USING (r) LEFT JOIN k USING (r)""",
}
