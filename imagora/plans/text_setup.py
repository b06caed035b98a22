"""The text experiment: `documents` as library, `benchmark` as queries,
`conversations` as stored samples."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.functions import text as tx
from imagora.operators import block_index, samples, sizing
from imagora.plans.tables import load, once, stage_path, staged

K = 4
OFFSET_STEP = 40
ANCHOR = 4


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, name, description, content, text); English and French documents
    end in a fenced block."""
    docs = load(spark, sf, "documents")
    block = F.concat(F.lit('\n```python\nprint("'), F.col("source"), F.lit('")\n```\n'))
    return docs.select(
        "doc_id", F.col("source").alias("name"), F.col("lang").alias("description"),
        F.concat("text", F.when(F.col("lang").isin("en", "fr"), block).otherwise(F.lit("")))
        .alias("content"), "text")


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, md): generated-looking documents, one shape per language."""
    c = corpus(spark, sf)
    head = F.concat(F.lit("---\nname: "), F.col("name"), F.lit("\ndescription: "),
                    F.col("description"), F.lit("\n---\n"))
    md = (
        F.when(F.col("description") == "en", F.concat(head, "content"))
        .when(F.col("description") == "fr", F.concat(F.lit("# "), F.col("content")))
        .when(F.col("description") == "de",
              F.concat(F.lit("```markdown\n"), head, F.col("content"), F.lit("\n```")))
        .otherwise(F.concat(F.lit("---\ndescription: "), F.col("description"), F.lit("\n---\n"),
                            F.col("content"))))
    return c.select("doc_id", md.alias("md"))


def domain_of(text) -> F.Column:
    return (F.when(F.length(text) < 180, F.lit("short"))
            .when(F.length(text) < 260, F.lit("medium")).otherwise(F.lit("long")))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("instance_id"),
                    domain_of(F.col("text")).alias("domain"), F.col("text").alias("query"))


def containment(docs: DataFrame, needles: DataFrame,
                keep: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(instance_id, doc_id) where the document text contains the query text.

    A containing document has the query's inner words as a run of its own, so
    four of them (words 2-5) select the candidates and only these are compared
    in full. Queries of fewer than ``ANCHOR`` + 2 words have no such inner words
    and are held against every text. Candidates are ids met by the 64-bit hash of
    the four words; ``keep`` may write and reread them. Where they are of a checked
    small size they go to the scan of the texts, which then move nowhere.
    """
    words = F.split("query", r"\s+")
    sized = needles.withColumn("_n", F.size(words))
    short = sized.filter(F.col("_n") < ANCHOR + 2).select("instance_id", "query")
    anchors = sized.filter(F.col("_n") >= ANCHOR + 2).select(
        "instance_id", "query", F.xxhash64(F.array_join(F.slice(words, 2, ANCHOR), " ")).alias("gram"))
    side = sizing.checked_broadcast(anchors.select("instance_id", "gram"))
    toks = docs.select("doc_id", F.split("text", r"\s+").alias("_t"))
    grams = toks.select("doc_id", F.explode(F.array_distinct(F.expr(
        f"transform(sequence(1, greatest(size(_t) - {ANCHOR - 1}, 1)),"
        f" i -> xxhash64(array_join(slice(_t, i, {ANCHOR}), ' ')))"))).alias("gram"))
    pairs = keep(grams.join(side, "gram").select("doc_id", "instance_id").distinct())
    asked = sizing.checked_broadcast(pairs.join(needles.select("instance_id", "query"), "instance_id"))
    full = docs.select("doc_id", "text").join(asked, "doc_id")
    found = full.filter(F.contains("text", "query")).select("instance_id", "doc_id")
    direct = docs.select("doc_id", "text").join(sizing.checked_broadcast(short), F.contains("text", "query"))
    return found.unionByName(direct.select("instance_id", "doc_id"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return containment(load(spark, sf, "documents").select("doc_id", "text"), queries(spark, sf),
                       lambda pairs: staged(spark, sf, "gold_pairs", lambda: pairs))


def lexical_index(spark: SparkSession, sf: str) -> block_index.BlockIndex:
    """The stored BM25 index of `documents`, made once."""
    path = stage_path(spark, sf, "bm25_index")
    table = "bm25_" + hashlib.md5(path.encode()).hexdigest()[:16]
    once(path, lambda: block_index.build(load(spark, sf, "documents"), path, table))
    return block_index.read(spark, path, table)


def stand_in_samples(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """(instance_id, sample_index, md): offline samples, each from a later part of the task."""
    q = queries(spark, sf).select("instance_id", "query",
                                  F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_index"))
    return q.select("instance_id", "sample_index",
                    tx.stand_in_document(F.col("query"), F.col("sample_index") * OFFSET_STEP).alias("md"))


def conversation_samples(spark: SparkSession, sf: str) -> DataFrame:
    """(instance_id, domain, query, template, sample_index, text) from `conversations`.

    The first user turn is the query, assistant turns are the samples; the
    number of turns decides the template.
    """
    turns = load(spark, sf, "conversations")
    first = turns.filter(F.col("role") == "user").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("query"))
    shape = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", F.when(F.col("n") <= 3, F.lit("sentence")).when(F.col("n") <= 5, F.lit("passage"))
        .otherwise(F.lit("skill")).alias("template"))
    answers = turns.filter(F.col("role") == "assistant")
    return (
        samples.positions_within(answers, ["conv_id"], ["turn"])
        .join(first, "conv_id").join(shape, "conv_id")
        .select(F.col("conv_id").alias("instance_id"), domain_of(F.col("query")).alias("domain"),
                "query", "template", "sample_index", "text"))


# ------------------------------------------------------------------ oracle SQL

def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


def sql_fields(content: str) -> tuple[str, str]:
    fence = "(?s)```[a-zA-Z0-9_+-]*\\n(.*?)```"
    code = strip(f"array_to_string(list_transform(regexp_extract_all({content}, '{fence}', 1), "
                 f"lambda b: {strip('b')}), chr(10))")
    body = strip(f"regexp_replace({content}, '{fence}', ' ', 'g')")
    return body, code


def sql_meta(name: str, desc: str) -> str:
    n, d = strip(name), strip(desc)
    return (f"CASE WHEN {n} <> '' AND {d} <> '' THEN regexp_replace({n}, '\\.+\\z', '') || '. ' || {d} "
            f"ELSE {n} || {d} END")


SQL_CORPUS = """
corpus AS (SELECT doc_id, source AS name, lang AS description, text,
  text || CASE WHEN lang IN ('en', 'fr') THEN chr(10) || '```python' || chr(10) || 'print("' || source || '")'
    || chr(10) || '```' || chr(10) ELSE '' END AS content FROM documents)"""
SQL_MD = SQL_CORPUS + """,
heads AS (SELECT *, '---' || chr(10) || 'name: ' || name || chr(10) || 'description: ' || description
  || chr(10) || '---' || chr(10) AS head FROM corpus),
md AS (SELECT doc_id, CASE description WHEN 'en' THEN head || content WHEN 'fr' THEN '# ' || content
  WHEN 'de' THEN '```markdown' || chr(10) || head || content || chr(10) || '```'
  ELSE '---' || chr(10) || 'description: ' || description || chr(10) || '---' || chr(10) || content END AS md
  FROM heads)"""
SQL_DOMAIN = ("CASE WHEN length({0}) < 180 THEN 'short' WHEN length({0}) < 260 THEN 'medium' "
              "ELSE 'long' END")
SQL_QUERIES = (f"tq AS (SELECT item_id AS instance_id, {SQL_DOMAIN.format('text')} AS domain, "
               "text AS query FROM benchmark)")
SQL_GOLD = ("tgold AS (SELECT b.item_id AS instance_id, d.doc_id FROM benchmark b "
            "JOIN documents d ON contains(d.text, b.text))")


def sql_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '\\s+'), lambda t: t <> '')"


SQL_BM25 = f"""
dt AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
stat AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM dt) GROUP BY ALL),
freq AS (SELECT token, count(*) AS df, sum(tf) AS cf FROM post GROUP BY 1),
qt AS (SELECT item_id AS instance_id, token, count(*) AS qtf
       FROM (SELECT item_id, unnest({sql_tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
bscore AS (SELECT qt.instance_id, p.doc_id,
    round(sum(qt.qtf * ln((s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * p.tf * 2.5::DOUBLE
      / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.dl / s.avgdl))), 6) AS score
  FROM qt JOIN freq f USING (token) JOIN post p USING (token) JOIN dl d USING (doc_id), stat s
  WHERE ln((s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) > 0 GROUP BY ALL),
bm25 AS (SELECT instance_id, doc_id, score,
  row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, doc_id) AS rank FROM bscore)"""

SQL_CONV = f"""
ans AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sample_index
        FROM conversations WHERE role = 'assistant'),
fq1 AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1),
shp AS (SELECT conv_id, CASE WHEN count(*) <= 3 THEN 'sentence' WHEN count(*) <= 5 THEN 'passage'
        ELSE 'skill' END AS template FROM conversations GROUP BY 1),
cs AS (SELECT conv_id AS instance_id, {SQL_DOMAIN.format('query')} AS domain, query, template, sample_index, text
       FROM ans JOIN fq1 USING (conv_id) JOIN shp USING (conv_id))"""


def sql_embed(name: str, source: str, keys: str, text: str, dim: int = 64) -> str:
    """CTEs ending in ``name``(keys, bucket, w): sparse unit vectors of hashed tokens."""
    return f"""
{name}_c AS (SELECT {keys}, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS c
  FROM (SELECT {keys}, unnest({sql_tokens(text)}) AS token FROM {source}) GROUP BY ALL),
{name} AS (SELECT {keys}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS w FROM {name}_c)"""
