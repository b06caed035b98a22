"""Nearest neighbours by collision counting over sorted projections.

Each block of vectors keeps ``M`` arrays of one random projection each, sorted.
A query opens a window around its own projection in every array and widens all
of them step by step (virtual rehashing); a vector that falls into the windows
of at least ``SHARE`` of the arrays has enough collisions to be verified. Inner
products become distances by one more coordinate that lifts every vector to the
largest norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imagora.llm.common import stage

M = 64
SHARE = 0.6
START = 0.7
GROWTH = 1.15
RADII = 14
CANDIDATES = 0.2
EXTRA = 60
BLOCK = 1 << 14
QUERY_BLOCK = 1 << 13
QUERIES_AT_ONCE = 256
SEED = 11
EVERY = 20
NEAREST = 20


def directions(dim: int, seed: int) -> np.ndarray:
    """``M`` random directions: orthonormal sets, as many as it takes."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-M // dim))]
    return np.concatenate(sets, axis=1)[:, :M].T


class SortedProjections:
    """The index of one block: vectors, ids and ``M`` sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, seed: int = SEED):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.longest = longest
        self.lines = directions(vectors.shape[1] + 1, seed)
        missing = np.sqrt(np.maximum(longest ** 2 - (self.vectors ** 2).sum(axis=1), 0))
        places = np.concatenate([self.vectors, missing[:, None]], axis=1) @ self.lines.T
        order = np.argsort(places, axis=0, kind="stable")
        self.places = [places[order[:, j], j] for j in range(M)]
        self.order = [np.ascontiguousarray(order[:, j]) for j in range(M)]
        self.spread = float(places.std()) or 1.0

    def windows(self, queries: np.ndarray) -> np.ndarray:
        """(radius, side, query, array): ends of the windows, one radius after the other.

        Queries are scaled to the lifted vectors' length; their extra coordinate is 0.
        The last window is all of the array.
        """
        length = np.maximum(np.sqrt((queries ** 2).sum(axis=1, keepdims=True)), 1e-300)
        centres = (queries / length * self.longest) @ self.lines[:, :-1].T
        half = START * self.spread * GROWTH ** np.arange(RADII)
        ends = np.empty((RADII + 1, 2, len(queries), M), dtype=np.int64)
        for j in range(M):
            for side, sign in ((0, -1), (1, 1)):
                edge = centres[None, :, j] + sign * half[:, None]
                ends[:RADII, side, :, j] = np.searchsorted(self.places[j], edge, "right" if side else "left")
        ends[RADII, 0], ends[RADII, 1] = 0, len(self.ids)
        return ends

    def candidates(self, ends: np.ndarray, want: int) -> np.ndarray:
        """Vectors with enough collisions at the first radius that gives ``want`` of them."""
        counts = np.zeros(len(self.ids), dtype=np.int64)
        least = int(np.ceil(SHARE * M))
        lo = hi = ends[0, 0]
        found = np.empty(0, np.int64)
        for new_lo, new_hi in ends:
            added = [self.order[j][a:b] for j in range(M) for a, b in ((new_lo[j], lo[j]), (hi[j], new_hi[j])) if b > a]
            if added:
                counts += np.bincount(np.concatenate(added), minlength=len(counts))
            lo, hi = new_lo, new_hi
            found = np.flatnonzero(counts >= least)
            if len(found) >= want:
                break
        return found

    def nearest(self, query: np.ndarray, own: int, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k largest inner products among verified vectors."""
        n = len(self.ids)
        found = self.candidates(ends, min(n, k + EXTRA + int(CANDIDATES * n)))
        found = found[self.ids[found] != own]
        # one row at a time is summed the same way, so equal vectors have equal scores
        scores = (self.vectors[found] * query).sum(axis=1)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][best], scores[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that can take part, as doubles."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)) \
        .filter(~F.coalesce(bad, F.lit(True))).filter(F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def search(vectors: DataFrame, every: int = EVERY, k: int = NEAREST, id_col: str = "vec_id",
           vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's own id. The score is the inner product in double
    precision, ties go to the smaller id. Null, zero and non-finite vectors and null
    ids take no part; vectors of another length than a query are none of its
    candidates. Rows of a repeated id are candidates one by one, and queries of a
    repeated id are answered once, for the first vector in lexical order. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "ann-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = {r["dim"]: r for r in rows.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"),
        F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    out = None
    for dim, fact in sorted(facts.items()):
        blocks = -(-fact["n"] // block)
        longest = float(np.sqrt(fact["m"]))
        mine = rows.filter(F.col("dim") == dim).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        queries = mine.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        parts = -(-fact["q"] // QUERY_BLOCK)
        for p in range(parts):
            chosen = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(parts)) == p) if parts > 1 else queries
            table = chosen.toArrow()  # about QUERY_BLOCK rows
            if not len(table):
                continue
            sent = spark.sparkContext.broadcast(
                (np.asarray(table.column("vec_id")), matrix(table.column("v"))))
            hits = mine.select("block", "vec_id", "v").groupBy("block").applyInArrow(
                block_search(sent, longest, k), "query_id bigint, vec_id bigint, score double")
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def block_search(sent, longest: float, k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, queries = sent.value
        index = SortedProjections(np.asarray(table.column("vec_id")), matrix(table.column("v")), longest)
        qs, vs, ss = [], [], []
        for i in range(0, len(ids), QUERIES_AT_ONCE):
            ends = index.windows(queries[i:i + QUERIES_AT_ONCE])
            for at, own in enumerate(ids[i:i + QUERIES_AT_ONCE].tolist()):
                found, scores = index.nearest(queries[i + at], own, ends[:, :, at], k)
                qs.append(np.full(len(found), own))
                vs.append(found)
                ss.append(scores)
        return pa.table({"query_id": pa.array(np.concatenate(qs), pa.int64()),
                         "vec_id": pa.array(np.concatenate(vs), pa.int64()),
                         "score": pa.array(np.concatenate(ss), pa.float64())})

    return run


def brute_force(ids: np.ndarray, vectors: np.ndarray, every: int = EVERY, k: int = NEAREST) -> Iterator[tuple]:
    """(query, rank, id, score) by comparing everything; for measuring recall on small tables."""
    for i in np.flatnonzero(ids % every == 0):
        other = np.flatnonzero(ids != ids[i])
        scores = (vectors[other] * vectors[i]).sum(axis=1)
        for rank, j in enumerate(np.lexsort((ids[other], -scores))[:k], 1):
            yield int(ids[i]), rank, int(ids[other][j]), float(scores[j])
