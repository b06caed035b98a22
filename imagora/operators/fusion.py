"""Reciprocal rank fusion, hybrid lists and cosine re-ranking of candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from imagora.operators import ranking, sizing
from imagora.session import written

RRF_K = 60
PATH_DEPTH = 100
TOP_K = 50
FUSED_DIGITS = 12
# documents whose vectors meet in one task, in bytes, and pairs scored at a time
CHUNK_BYTES = 64 << 20
PAIRS_AT_ONCE = 1 << 15


def rrf(paths: DataFrame, keys: Sequence[str] = ("instance_id",), k: int = RRF_K,
        top_k: int = TOP_K) -> DataFrame:
    """Fuse ranked lists (keys, doc_id, rank): a list adds 1 / (k + rank).

    Rows move once, by key: the sums and the ranks read that exchange.
    """
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fused = paths.select(*keys, "doc_id", "rank").repartition(parts, *keys).groupBy(*keys, "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("score"))
    return ranking.rank_hits(fused, keys, top_k, digits=FUSED_DIGITS)


def union_paths(*paths: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    cols = [*keys, "doc_id", "rank"]
    out = paths[0].select(*cols)
    for p in paths[1:]:
        out = out.unionByName(p.select(*cols))
    return out


def rerank_cosine(candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame,
                  top_k: int, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Re-order candidates (keys, doc_id, rank) by dot product with the query
    vector; equal scores keep the order of the first stage."""
    # read for their documents and for their scores
    found = written(candidates.filter(F.col("doc_id").isNotNull()).select(*keys, "doc_id", "rank"), "candidates")
    # only vectors of candidates are sent
    docs = doc_vectors.select("doc_id", "vec").join(
        sizing.checked_broadcast(found.select("doc_id").distinct()), "doc_id", "left_semi")
    scored = _dots(found, query_vectors, docs, list(keys))
    rounded = scored.withColumn("score", F.round("score", ranking.SCORE_DIGITS))
    return ranking.top_k(rounded, keys, top_k, [F.desc("score"), F.asc("first_rank")])


def _dots(candidates: DataFrame, query_vectors: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, first_rank, score): the dot product of every candidate with its query.

    A candidate moves as an id, never with a vector: a query's vector goes once to
    each chunk of documents that holds any of its candidates. Documents of measured
    small size are sent to the tasks; else chunks of them meet blocks of queries.
    """
    spark = candidates.sparkSession
    size = sizing.measured_bytes(docs)
    chunks = -(-size // CHUNK_BYTES)
    listed = candidates.select(*keys, F.struct("doc_id", F.col("rank").alias("first_rank")).alias("hit"), (
        F.pmod(F.xxhash64("doc_id"), F.lit(max(1, chunks))).cast("int")).alias("_d"))
    asked = listed.groupBy(*keys, "_d").agg(F.collect_list("hit").alias("hits")).join(
        query_vectors.select(*keys, "vec"), keys)
    out_type = T.StructType([
        *[candidates.schema[c] for c in keys], candidates.schema["doc_id"],
        T.StructField("first_rank", candidates.schema["rank"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out_type)
    if chunks <= 1:
        shared = spark.sparkContext.broadcast(_by_id(docs.toArrow()))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _scored(batch, shared.value, keys, arrow)

        return asked.drop("_d").mapInArrow(task, out_type)
    blocks = -(-2 * spark.sparkContext.defaultParallelism // chunks)
    left = docs.withColumn("_d", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("_q", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))

    def cell(held: pa.Table, rows: pa.Table) -> pa.Table:
        index, found = _by_id(held), []
        for batch in rows.combine_chunks().to_batches():
            found += _scored(batch, index, keys, arrow)
        return pa.Table.from_batches(found, schema=arrow)

    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(cell, out_type)


def _ids(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=object)
    return column.to_numpy(zero_copy_only=False)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, start, length) of an array of vectors; length -1 for a null and one that holds a null."""
    offsets = column.offsets.to_numpy()
    length = np.diff(offsets)
    values = column.values
    if values.null_count:
        nulls = np.r_[0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False))]
        length = np.where(nulls[offsets[1:]] > nulls[offsets[:-1]], -1, length)
    if column.null_count:
        length = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, length)
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), offsets[:-1], length


def _by_id(docs: pa.Table) -> tuple:
    """(ids in order, values, start, length) of the vectors of a table of documents."""
    docs = docs.select(["doc_id", "vec"]).combine_chunks()
    if not docs.num_rows:
        return np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    batch = docs.to_batches()[0]
    ids = _ids(batch.column("doc_id"))
    order = np.argsort(ids, kind="stable")
    values, start, length = _lists(batch.column("vec"))
    return ids[order], values, start[order], length[order]


def _scored(batch: pa.RecordBatch, index: tuple, keys: list[str], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Candidates of some queries with their scores; vectors of unlike length have none, as in an SQL dot product."""
    ids, d_values, d_start, d_length = index
    if not batch.num_rows or not len(ids):
        return
    hits = batch.column("hits")
    row = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
    hit = hits.flatten()
    wanted = _ids(hit.field("doc_id"))
    first = np.searchsorted(ids, wanted, side="left")
    times = np.searchsorted(ids, wanted, side="right") - first
    q_values, q_start, q_length = _lists(batch.column("vec"))
    of = np.repeat(np.arange(len(row)), times)
    doc = np.repeat(first, times) + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    for i in range(0, len(of), PAIRS_AT_ONCE):
        o, d = of[i:i + PAIRS_AT_ONCE], doc[i:i + PAIRS_AT_ONCE]
        q = row[o]
        alike = np.where(q_length[q] == d_length[d], d_length[d], -1)
        score = np.zeros(len(o))
        for n in np.unique(alike[alike > 0]).tolist():
            at = np.flatnonzero(alike == n)
            a, b = q_start[q[at]], d_start[d[at]]
            total = np.zeros(len(at))
            for j in range(n):  # in this order, as the expression over rows adds them
                total += q_values[a + j] * d_values[b + j]
            score[at] = total
        columns = {name: batch.column(name).take(pa.array(q)) for name in keys}
        columns["doc_id"] = hit.field("doc_id").take(pa.array(o))
        columns["first_rank"] = hit.field("first_rank").take(pa.array(o))
        columns["score"] = pa.array(score, mask=alike < 0)
        yield pa.RecordBatch.from_arrays([columns[n].cast(arrow.field(n).type) for n in arrow.names], schema=arrow)
