"""A training corpus out of `documents`: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.llm import decontam, langid, mixing, sharding, simhash
from imagora.llm.common import content_key, stage

#: A document goes if no language is told with more than this score.
MIN_SCORE = 0.3


def beside(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows as one column, so that no name of theirs meets the columns put beside them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[column.alias(name) for name, column in columns.items()])


def rows_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language the network can tell.

    Null and empty texts have no letter and go. Long texts are read whole.
    Repeated rows share their fate; an empty table stays empty.
    """
    model = langid.fit(docs)
    told = beside(docs, guess=langid.predict_column(model, F.col("text"))).filter(
        (F.col("guess.lang") != langid.UNKNOWN) & (F.col("guess.score") > MIN_SCORE))
    return rows_of(told, docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near copies: five words, similarity 0.8.

    Null and empty texts are equal; a null id is an id. Of rows with one id and
    one text one stays. Long texts are compared whole; an empty table stays
    empty. Texts move once: the join and the removal of repeated rows share keys.
    """
    def keys(doc_id: Column, t0: Column, t1: Column) -> dict[str, Column]:
        return {"i0": F.xxhash64(doc_id), "t0": t0, "t1": t1}

    kept = simhash.near_copies(docs).select("doc_id", *[
        c.alias(name) for name, c in keys(F.col("doc_id"), F.col("t0"), F.col("t1")).items()])
    keyed = beside(docs, **keys(F.col("doc_id"), *content_key(F.col("text"))))
    same = [keyed[k] == kept[k] for k in ("i0", "t0", "t1")] + [F.col("row.doc_id").eqNullSafe(kept["doc_id"])]
    return rows_of(keyed.join(kept, same, "left_semi").dropDuplicates(["i0", "t0", "t1"]), docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Long texts are searched whole. Repeated rows
    share their fate; empty tables of documents or items remove nothing.
    """
    model = decontam.Decontaminator(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows_of(beside(docs, hits=model.hits(F.col("text"))).filter(F.size("hits") == 0), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null is a source. Texts without words are taken or not, which changes no
    sum; long texts count whole. Rows of one id and one size are taken
    alike; an empty table stays empty.
    """
    taken = mixing.Mix(docs, F.col("source")).counted(docs).filter(F.col("times") > 0)
    return rows_of(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The network and the near copies are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
