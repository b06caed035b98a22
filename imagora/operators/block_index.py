"""A stored BM25 index: postings in blocks with their maxima, and a top-k that skips blocks.

``blocks`` holds (token, block, n, peak, postings): the documents of a token,
dealt into blocks of about ``BLOCK`` by the leading bits of a digest of their id,
so the block of any (token, document) is known without a search; ``peak`` is the
largest weight-free BM25 part in the block. The table is bucketed by token:
a search for few tokens opens their buckets alone, a join by token moves none of
it. ``tokens`` holds one row per token. The texts are read once, when the index
is made.

The search is exact. Some blocks of each query's strongest tokens name documents,
whose full scores give a lower bound of its k-th score. Tokens whose bounds together stay below it cannot lift
a document by themselves, so documents come only from blocks of the other
tokens, and of those only from blocks whose peak can still reach the bound. The
weak tokens are then read in the blocks that hold such a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imagora.operators import lexical, ranking, sizing
from imagora.session import written

#: Postings a block is made for; the digest deals them, so it may hold some more.
BLOCK = 128
#: Blocks of a strong token that are read for the bound.
FIRST_BLOCKS = 4
#: Distinct query tokens up to which buckets are named in the plan.
NAMED_TOKENS = 2000
#: Scores are compared after rounding to six digits.
SLACK = 2e-6

#: Postings that one bucket of the table, and so one task that makes it, holds about.
BUCKET_POSTINGS = 1 << 20

_HASH_BITS = 32


def doc_hash(doc_id: Column) -> Column:
    """32 bits of a digest of an id."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def block_of(hashed: Column, bits: Column) -> Column:
    """The leading ``bits`` of a hash."""
    return F.call_function("shiftright", hashed, F.lit(_HASH_BITS) - bits)


def bits_of(df: Column, block: int) -> Column:
    """Bits that part ``df`` documents into blocks of about ``block``."""
    parts = F.ceil(df / F.lit(block))
    return F.least(F.when(parts > 1, F.char_length(F.bin(parts - F.lit(1)))).otherwise(F.lit(0)), F.lit(_HASH_BITS - 1)).cast("int")


@dataclass
class BlockIndex:
    """The stored tables and the two numbers of the collection."""

    blocks: DataFrame
    tokens: DataFrame
    n_docs: int
    avgdl: float
    k1: float = lexical.K1
    b: float = lexical.B

    # ------------------------------------------------------------ a search

    def weighted(self, terms: DataFrame) -> DataFrame:
        """(instance_id, token, w, bits, df, most): query tokens that weigh something; ``most`` bounds their part."""
        idf = F.log((F.lit(self.n_docs) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
        known = self.tokens.join(sizing.checked_broadcast(terms.select("token").distinct()), "token", "left_semi")
        return terms.join(known.withColumn("idf", idf).filter("idf > 0"), "token").select(
            "instance_id", "token", (F.col("qtf") * F.col("idf")).alias("w"), "bits", "df",
            (F.col("qtf") * F.col("idf") * F.col("peak")).alias("most"))

    def part(self) -> Column:
        """A posting's part of a score, by the columns w, tf and dl."""
        return F.col("w") * impact(F.col("tf"), F.col("dl"), self.avgdl, self.k1, self.b)

    def named(self, terms: DataFrame) -> DataFrame:
        """The blocks of the tokens asked for; few tokens are named, so other buckets are not opened."""
        tokens = [r[0] for r in terms.select("token").distinct().limit(NAMED_TOKENS + 1).collect()]
        return self.blocks.filter(F.col("token").isin(tokens)) if len(tokens) <= NAMED_TOKENS else self.blocks

    def _postings(self, blocks: DataFrame) -> DataFrame:
        return blocks.select("instance_id", "w", F.inline("postings"))

    def _added(self, blocks: DataFrame, found: DataFrame) -> DataFrame:
        """(instance_id, doc_id, score): the parts that blocks add to documents found."""
        return self._postings(blocks).join(found.select("instance_id", "doc_id"), ["instance_id", "doc_id"], "left_semi").select(
            "instance_id", "doc_id", self.part().alias("score"))

    def bounds(self, blocks: DataFrame, weights: DataFrame, k: int) -> DataFrame:
        """(instance_id, bound): what the k-th best document of a query reaches at least."""
        strong_first = Window.partitionBy("instance_id").orderBy(F.desc("most"), "token")
        before = F.coalesce(F.sum("df").over(strong_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        strong = weights.withColumn("before", before).filter(F.col("before") < 2 * k).select("instance_id", "token", "w")
        near = blocks.filter(F.col("block") < FIRST_BLOCKS).join(sizing.checked_broadcast(strong), "token")
        partial = self._postings(near).groupBy("instance_id", "doc_id").agg(F.sum(self.part()).alias("score"))
        seeds = written(ranking.top_k(partial, ["instance_id"], k, [F.desc("score")]).select(
            "instance_id", "doc_id"), "bm25-seeds")
        full = self._added(self.second_read(blocks, weights, seeds), seeds).groupBy("instance_id", "doc_id").agg(
            F.sum("score").alias("score"))
        last = ranking.top_k(full, ["instance_id"], k, [F.desc("score")]).filter(F.col("rank") == k)
        return weights.select("instance_id").distinct().join(
            last.select("instance_id", F.col("score").alias("bound")), "instance_id", "left").select(
            "instance_id", (F.coalesce("bound", F.lit(0.0)) - F.lit(SLACK)).alias("bound"))

    def roles(self, weights: DataFrame, bounds: DataFrame) -> DataFrame:
        """Weights with the query's bound, ``strong`` tokens told from weak ones, and what the others can add."""
        weak_first = Window.partitionBy("instance_id").orderBy("most", "token")
        whole = Window.partitionBy("instance_id")
        strong = F.sum("most").over(weak_first) >= F.col("bound")
        return weights.join(bounds, "instance_id").withColumn("strong", strong).withColumns({
            "rest": F.sum("most").over(whole) - F.col("most"),
            "weak_sum": F.coalesce(F.sum(F.when(~F.col("strong"), F.col("most"))).over(whole), F.lit(0.0))})

    @staticmethod
    def first_read(blocks: DataFrame, roles: DataFrame) -> DataFrame:
        """Blocks of strong tokens that hold a document which may reach the bound."""
        strong = roles.filter("strong").select("instance_id", "token", "w", "rest", "bound")
        return blocks.join(sizing.checked_broadcast(strong), "token").filter(
            F.col("w") * F.col("peak") + F.col("rest") >= F.col("bound"))

    @staticmethod
    def second_read(blocks: DataFrame, weights: DataFrame, found: DataFrame) -> DataFrame:
        """Blocks of these tokens that may hold documents found."""
        weak = weights.select("instance_id", "token", "w", "bits")
        places = found.select("instance_id", doc_hash(F.col("doc_id")).alias("h"))
        asked = places.join(sizing.checked_broadcast(weak), "instance_id").select(
            "instance_id", "token", "w", block_of(F.col("h"), F.col("bits")).alias("block")).distinct()
        asked = written(asked, "bm25-asked")
        # blocks that are asked for by nobody do not move, and none does where the asked are few
        if sizing.fits_broadcast(asked):
            return blocks.join(F.broadcast(asked), ["token", "block"])
        wanted = sizing.checked_broadcast(asked.select("token", "block").distinct())
        return blocks.join(wanted, ["token", "block"], "left_semi").join(asked, ["token", "block"])

    def topk(self, queries: DataFrame, k: int, query_id: str = "instance_id", query: str = "query") -> DataFrame:
        """(instance_id, doc_id, score, rank) of the k best documents per query."""
        return self.search(queries, k, query_id, query)[0]

    def search(self, queries: DataFrame, k: int, query_id: str = "instance_id",
               query: str = "query") -> tuple[DataFrame, DataFrame, DataFrame]:
        """The ranked documents, and the blocks read first and second."""
        terms = written(lexical.query_terms(queries, query_id, query), "bm25-terms")
        blocks = self.named(terms)
        weights = written(self.weighted(terms), "bm25-weights")
        roles = written(self.roles(weights, self.bounds(blocks, weights, k)), "bm25-roles")
        first = self.first_read(blocks, roles)
        reach = roles.groupBy("instance_id").agg(F.first("bound").alias("bound"), F.first("weak_sum").alias("weak_sum"))
        partial = self._postings(first).groupBy("instance_id", "doc_id").agg(F.sum(self.part()).alias("score"))
        found = written(partial.join(sizing.checked_broadcast(reach), "instance_id").filter(
            F.col("score") + F.col("weak_sum") >= F.col("bound")).select("instance_id", "doc_id", "score"), "bm25-found")
        second = self.second_read(blocks, roles.filter("NOT strong"), found)
        scored = found.unionByName(self._added(second, found)).groupBy("instance_id", "doc_id").agg(F.sum("score").alias("score"))
        ranked = ranking.rank_hits(scored, ["instance_id"], k).select("instance_id", "doc_id", "score", "rank")
        return ranked, first, second


def impact(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    """The part of a BM25 score that no query changes."""
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(avgdl)))


def build(corpus: DataFrame, path: str, table: str, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK,
          buckets: int | None = None, k1: float = lexical.K1, b: float = lexical.B) -> BlockIndex:
    """Write the index of a corpus under ``path``; ``table`` is its name in the catalog.

    Tokens found in half the documents or more weigh nothing and get no blocks,
    which leaves out the longest lists.
    """
    posts = written(lexical.postings(corpus, doc_id, text), "bm25-postings")
    marks = posts.filter(F.col("token") == lexical._DOC_MARK).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).first()
    n_docs, avgdl = int(marks["n"]), float(marks["dl"] or 0) / max(int(marks["n"]), 1)
    real = posts.filter(F.col("token") != lexical._DOC_MARK)
    part = impact(F.col("tf"), F.col("dl"), avgdl, k1, b)
    real.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
        F.max(part).alias("peak")).withColumn("bits", bits_of(F.col("df"), block)).write.mode("overwrite").parquet(f"{path}/tokens")
    tokens = corpus.sparkSession.read.parquet(f"{path}/tokens")
    # only long lists have more than one block
    long = sizing.checked_broadcast(tokens.filter("bits > 0").select("token", "bits", "df"))
    placed = real.join(long, "token", "left").filter((F.lit(2) * F.coalesce("df", F.lit(0)) < n_docs) | F.col("df").isNull())
    number = F.when(F.col("bits").isNull(), F.lit(0).cast("bigint")).otherwise(block_of(doc_hash(F.col("doc_id")), F.col("bits")))
    spark = corpus.sparkSession
    buckets = buckets or _buckets(tokens)
    # postings move once: by token, as the table is bucketed, which also serves the grouping
    blocks = placed.withColumn("block", number).select("token", "block", "doc_id", "dl", "tf").repartition(
        buckets, "token").groupBy("token", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max(part).alias("peak"),
        F.sort_array(F.collect_list(F.struct("doc_id", "dl", "tf"))).alias("postings"))
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    blocks.write.mode("overwrite").option("path", f"{path}/blocks").bucketBy(
        buckets, "token").sortBy("token", "block").saveAsTable(table)
    numbers = spark.createDataFrame([(n_docs, avgdl, k1, b)], "n_docs bigint, avgdl double, k1 double, b double")
    numbers.write.mode("overwrite").parquet(f"{path}/numbers")
    return read(spark, path, table)


def _buckets(tokens: DataFrame) -> int:
    """Buckets of bounded work: they grow with the postings, also where the words stay the same."""
    n, postings = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    return max(8, math.ceil(n / 50_000), math.ceil(postings / BUCKET_POSTINGS))


def read(spark: SparkSession, path: str, table: str) -> BlockIndex:
    """The index written under ``path``."""
    numbers = spark.read.parquet(f"{path}/numbers").first()
    return BlockIndex(spark.table(table), spark.read.parquet(f"{path}/tokens"), **numbers.asDict())
