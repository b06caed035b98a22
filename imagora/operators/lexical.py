"""BM25: postings, document frequencies and top-k scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.functions import text as tx
from imagora.operators import ranking, sizing

# Fixed values of the weighting.
K1 = 1.5
B = 0.75

# Token that no text can yield; it carries one row per document through the
# same pass, so N and the total length need no second read of the texts.
_DOC_MARK = ""


def _counted(tokens: Column) -> Column:
    """Array of (token, tf) of one row's tokens, and the mark.

    Sorting inside the row brings equal tokens together; a token's count is the
    distance between the starts of two runs. One-element arrays bind the sorted
    tokens and the starts, so each is computed once.
    """
    def runs(s: Column, starts: Column) -> Column:
        end = lambda i: F.coalesce(F.get(starts, i + F.lit(1)), F.size(s) + F.lit(1))
        return F.transform(starts, lambda p, i: F.struct(
            F.get(s, p - F.lit(1)).alias("token"), (end(i) - p).cast("bigint").alias("tf")))

    def first_of_run(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(
            F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 1) | (F.get(s, i - F.lit(1)) != F.get(s, i - F.lit(2))))

    nested = F.transform(F.array(F.sort_array(tokens)), lambda s: F.transform(
        F.array(first_of_run(s)), lambda starts: runs(s, starts)))
    mark = F.array(F.struct(F.lit(_DOC_MARK).alias("token"), F.lit(1).cast("bigint").alias("tf")))
    return F.concat(F.get(F.get(nested, F.lit(0)), F.lit(0)), mark)


def postings(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text",
             vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, token, tf), plus one mark row per document (token '').

    Tokens are counted inside the document's row, so nothing is shuffled; ids
    must be unique. ``vocabulary``, whose size the caller has checked, is
    broadcast and only its tokens are kept.
    """
    toks = corpus.select(F.col(doc_id).alias("doc_id"),
                         F.coalesce(tx.tokens(F.col(text)), F.array().cast("array<string>")).alias("_t"))
    rows = toks.select("doc_id", F.size("_t").cast("bigint").alias("dl"),
                       F.inline(_counted(F.col("_t"))))
    if vocabulary is None:
        return rows
    marked = vocabulary.select("token").unionByName(
        vocabulary.sparkSession.createDataFrame([(_DOC_MARK,)], "token string"))
    return rows.join(F.broadcast(marked), "token", "left_semi").select("doc_id", "dl", "token", "tf")


def token_table(posts: DataFrame) -> DataFrame:
    """(token, df, cf) over real tokens."""
    return posts.filter(F.col("token") != _DOC_MARK).groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def write_index(posts: DataFrame, table: str, buckets: int) -> None:
    """Persist postings bucketed by document: later scoring needs no shuffle
    before the per-query top-k."""
    posts.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(table)


def query_terms(queries: DataFrame, query_id: str = "instance_id",
                query: str = "query") -> DataFrame:
    """(instance_id, token, qtf); a repeated query token counts each time."""
    return (
        queries.select(F.col(query_id).alias("instance_id"),
                       F.explode(tx.tokens(F.col(query))).alias("token"))
        .groupBy("instance_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, *, doc_id: str = "doc_id",
              text: str = "text", query_id: str = "instance_id", query: str = "query",
              k1: float = K1, b: float = B, pad_zero: bool = False,
              index: DataFrame | None = None) -> DataFrame:
    """(instance_id, doc_id, score, rank) of the k best documents per query.

    Tokens found in at least half the documents weigh nothing and are dropped
    before they meet the postings.
    """
    terms = query_terms(queries, query_id, query)
    # vocabulary and weights hold at most one row per query term, so the measured
    # size of the terms bounds both
    small = sizing.fits_broadcast(terms)
    if index is None:
        # a vocabulary too large to broadcast filters little; the weights do it below
        found = postings(corpus, doc_id, text, terms.select("token").distinct() if small else None)
        # counted rows move once: as keys of a local grouping no column is pruned in
        # any branch below, so all of them read this one exchange
        posts = found.filter(F.col("token").isNotNull()).repartition("doc_id").select(
            "doc_id", "dl", "token", "tf").distinct()
    else:
        posts = index
    marks = F.col("token") == _DOC_MARK
    freq = posts.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("dl").alias("len_sum"))
    size = freq.agg(F.struct(
        F.max(F.when(marks, F.col("df"))).alias("n_docs"),
        F.max(F.when(marks, F.col("len_sum") / F.col("df"))).alias("avgdl")).alias("size")).scalar()
    idf = F.log((size["n_docs"] - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    known = freq.select("token", "len_sum", size["avgdl"].alias("avgdl"), idf.alias("idf")).filter("idf > 0 AND len_sum > 0")
    weights = terms.join(known, "token").select(
        "instance_id", "token", "avgdl", (F.col("qtf") * F.col("idf")).alias("w"))
    if small:
        hits = posts.join(F.broadcast(weights), "token")
    else:
        hits = sizing.salted_join(posts, weights, ["token"], F.col("doc_id"))
    part: Column = F.col("w") * F.col("tf") * F.lit(k1 + 1) / (
        F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("instance_id", "doc_id").agg(F.sum(part).alias("score"))
    ranked = ranking.rank_hits(scored, ["instance_id"], k).select(
        "instance_id", "doc_id", "score", "rank")
    if not pad_zero:
        return ranked
    return pad_with_zero(ranked, queries.select(F.col(query_id).alias("instance_id")),
                         corpus.select(F.col(doc_id).alias("doc_id")), k)


def pad_with_zero(ranked: DataFrame, query_ids: DataFrame, doc_ids: DataFrame,
                  k: int) -> DataFrame:
    """Fill lists shorter than k with unmatched documents, score 0, in id order.

    The k smallest ids always hold enough unmatched ones.
    """
    first = doc_ids.orderBy("doc_id").limit(k).agg(
        F.sort_array(F.collect_list("doc_id")).alias("ids"))
    short = (
        query_ids.join(ranked.groupBy("instance_id").agg(F.count(F.lit(1)).alias("have")),
                       "instance_id", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter(F.col("have") < k)
    )
    fill = short.select("instance_id", "have", F.explode(first.scalar()).alias("doc_id")) \
        .join(ranked.select("instance_id", "doc_id"), ["instance_id", "doc_id"], "left_anti")
    padded = ranking.top_k(fill, ["instance_id"], k, [F.asc("doc_id")], "_r") \
        .withColumn("rank", (F.col("have") + F.col("_r")).cast("int")) \
        .filter(F.col("rank") <= k) \
        .select("instance_id", "doc_id", F.lit(0.0).alias("score"), "rank")
    return ranked.unionByName(padded)
