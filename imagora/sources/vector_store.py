"""Stored vectors, keyed by encoder and content digest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.operators import encode


def add_vectors(texts: DataFrame, path: str, encoder_id: str, vector: Column | None = None) -> None:
    """Encode texts (doc_id, text) and append one row per distinct content not stored yet.

    A write that is repeated, whole or half finished, adds nothing twice.
    """
    digest = texts.withColumn("content_digest", F.sha2("text", 256)).dropDuplicates(["content_digest"])
    old = _stored_digests(texts.sparkSession, path, encoder_id)
    if old is not None:
        digest = digest.join(old, "content_digest", "left_anti")
    rows = digest.select("content_digest", (vector if vector is not None else
                                            encode.encode_text(F.col("text"))).alias("vec"))
    rows.withColumn("encoder", F.lit(encoder_id)).write.mode("append").partitionBy("encoder").parquet(path)


def _stored_digests(spark: SparkSession, path: str, encoder_id: str) -> DataFrame | None:
    """Digests stored for an encoder; None where nothing has been written."""
    try:
        return stored(spark, path, encoder_id).select("content_digest")
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored(spark: SparkSession, path: str, encoder_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("encoder") == encoder_id).drop("encoder")


def vectors_of(texts: DataFrame, path: str, encoder_id: str) -> DataFrame:
    """(doc_id, vec) of texts whose content is stored."""
    return texts.select("doc_id", F.sha2("text", 256).alias("content_digest")).join(
        stored(texts.sparkSession, path, encoder_id), "content_digest").select("doc_id", "vec")
