"""Exact dense search that leaves out clusters by bounds.

The library is dealt once to the nearest of at most ``MOST_CLUSTERS`` centres,
which come from a few rounds of k-means on a hashed sample of bounded size; every
vector is stored with its cluster. A vector x at distance r or less from centre c
scores at most q.c + |q| r, so with the true radius of each cluster the bound
holds for every vector, however the centres were found.

A query first meets the clusters nearest to it that hold k vectors together. Their
k-th score is what a document must reach; only clusters whose bound reaches it
are met in a second step. A task holds a block of queries and reads the stored
chunks of clusters through, so neither queries nor vectors are copied to cells,
and no query meets what it need not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from imagora.operators import ranking, sizing
from imagora.operators.dense import (BLOCK_QUERIES, CELL_HITS, GRID_BYTES, _best_of, _Docs, _matrix, _sortable, packet_rows,
                                     query_blocks, read_through, table_of, write_packets)
from imagora.session import written

MOST_CLUSTERS = 4096
#: Sampled vectors per centre, and bytes of all centres.
SAMPLE_PER_CLUSTER = 16
CENTRE_BYTES = 16 << 20
ROUNDS = 6
CHUNK = 8192
QUERY_BLOCK = 4096
#: Queries times clusters that a task keeps track of.
MET_BYTES = 64 << 20
#: Rounded scores and sums of doubles may differ by this much.
SLACK = 2e-6


def centres_of(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres; the first are spread: each next one is the row farthest from those taken."""
    count = min(count, len(sample))
    taken = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(taken) < count:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[taken[-1]]) ** 2).sum(1))
    centres = sample[taken].copy()
    for _ in range(rounds):
        own = nearest(sample, centres)[0]
        size = np.bincount(own, minlength=count)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and the distance to it."""
    own = ((centres ** 2).sum(1)[None, :] - 2 * (vectors @ centres.T)).argmin(1)
    return own, np.sqrt(((vectors - centres[own]) ** 2).sum(1))


def meets(q: np.ndarray, known: tuple, k: int, floor: np.ndarray | None) -> np.ndarray:
    """Which clusters each query meets: the nearest that hold k vectors together, or with a
    ``floor``, the score to reach, the others whose bound reaches it."""
    centres, radius, counts = known
    near = q @ centres.T
    order = np.argsort(-near, axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1) - counts[order]
    begun = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(begun, order, held < k, axis=1)
    if floor is None:
        return begun
    return ~begun & (near + np.sqrt((q ** 2).sum(1))[:, None] * radius[None, :] >= floor[:, None])


@dataclass
class ClusteredLibrary:
    """Stored vectors (cluster, chunk, doc_id, vec), their packets by chunk, and what is known of each cluster."""

    vectors: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    packets: DataFrame

    def chunks(self) -> np.ndarray:
        return np.maximum(1, -(-self.counts // CHUNK))

    # ------------------------------------------------------------ routing

    def _routed(self, queries: DataFrame, keys: Sequence[str], k: int, first: bool) -> DataFrame:
        """(keys, cluster, chunk): queries with every chunk they meet in one of the two steps.

        The second step needs the column ``floor``, the score to reach.
        """
        spark = queries.sparkSession
        shared = spark.sparkContext.broadcast(((self.centres, self.radius, self.counts), self.chunks()))
        out = T.StructType([*[queries.schema[c] for c in keys],
                            T.StructField("cluster", T.IntegerType()), T.StructField("chunk", T.IntegerType())])
        arrow = to_arrow_schema(out)
        names = [*keys]

        def task(batches):
            known, chunks = shared.value
            for batch in batches:
                if not batch.num_rows or not len(known[0]):
                    continue
                floor = None if first else batch.column("floor").to_numpy(zero_copy_only=False)
                row, cluster = np.nonzero(meets(_matrix(batch.column("vec")), known, k, floor))
                many = chunks[cluster]
                row, cluster = np.repeat(row, many), np.repeat(cluster, many)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                for lo in range(0, len(row), QUERY_BLOCK):
                    part = slice(lo, lo + QUERY_BLOCK)
                    rows = batch.select(names).take(pa.array(row[part]))
                    columns = [*rows.columns, pa.array(cluster[part], pa.int32()), pa.array(chunk[part], pa.int32())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return queries.mapInArrow(task, out)

    def _scored(self, asked: DataFrame, keys: list[str], k: int, digits: int, blocks: int) -> DataFrame:
        """(keys, doc_id, score): the k best of every query (keys, vec[, floor]) among what it meets in a step."""
        spark = asked.sparkSession
        shared = spark.sparkContext.broadcast((self.centres, self.radius, self.counts))
        out = T.StructType([*[asked.schema[c] for c in keys], self.vectors.schema["doc_id"], T.StructField("score", T.DoubleType())])
        arrow = to_arrow_schema(out)

        def begin(rows: pa.Table) -> list:
            vecs = _matrix(rows.column("vec"))
            floor = rows.column("floor").to_numpy() if "floor" in rows.column_names else None
            state = []
            for lo, acc in _best_of(vecs, k, digits):
                low = None if floor is None else floor[lo:lo + len(acc.floor)]
                met = meets(acc.queries, shared.value, k, low)
                if low is not None:
                    acc.floor = low.copy()
                state.append((acc, met, rows.select(keys).slice(lo, len(acc.floor)).combine_chunks()))
            return state

        def take(state: list, row, found: pa.Table) -> None:
            docs = None
            for acc, met, _ in state:
                rows = np.flatnonzero(met[:, row["_f"]])
                if len(rows):
                    docs = docs or _Docs(_sortable(found.column("doc_id")), _matrix(found.column("vec")), k)
                    acc.offer(docs, None if len(rows) == len(met) else rows)

        def end(state: list):
            for acc, _, names in state:
                for batch in acc.hits(names, "", arrow):
                    yield pa.Table.from_batches([batch])

        return table_of(spark, [read_through(query_blocks(asked, blocks, keys), self.packets, begin, take, end)], out)

    def search(self, queries: DataFrame, k: int, keys: Sequence[str], digits: int = ranking.SCORE_DIGITS) -> DataFrame:
        """(keys, doc_id, score, rank) of the k best by inner product; ties go to the smaller id."""
        return self.steps(queries, k, keys, digits)[0]

    def steps(self, queries: DataFrame, k: int, keys: Sequence[str],
              digits: int = ranking.SCORE_DIGITS) -> tuple[DataFrame, list[DataFrame]]:
        """The ranked rows, and the queries as routed in the two steps."""
        keys = list(keys)
        asked = written(queries.filter(F.size("vec") > 0).select(*keys, "vec"), "clustered-queries")
        n, size = sizing.measure(asked)
        blocks = max(1, -(-n * k // CELL_HITS), -(-2 * size // GRID_BYTES), -(-n * len(self.centres) // MET_BYTES),
                     min(2 * asked.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_QUERIES)))
        first = self._routed(asked, keys, k, True)
        near = written(self._scored(asked, keys, k, digits, blocks), "clustered-near")
        last = ranking.top_k(near, keys, k, [F.desc("score"), F.asc("doc_id")]).filter(F.col("rank") == k)
        lowest = F.coalesce(F.col("score") - F.lit(SLACK), F.lit(float("-inf")))
        floors = asked.join(last.select(*keys, "score"), keys, "left").select(*keys, "vec", lowest.alias("floor"))
        second = self._routed(floors, keys, k, False)
        whole = near.unionByName(self._scored(floors, keys, k, digits, blocks))
        return ranking.top_k(whole, keys, k, [F.desc("score"), F.asc("doc_id")]), [first, second]


def build(library: DataFrame, clusters: int | None = None, seed: int = 7) -> ClusteredLibrary:
    """Cluster (doc_id, vec) once; the vectors go to the shared folder with their cluster.

    The driver holds the sample (``SAMPLE_PER_CLUSTER`` vectors a centre) and one row per cluster.
    """
    spark = library.sparkSession
    lib = library.select("doc_id", "vec").filter(F.size("vec") > 0)
    shape = lib.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = int(shape["n"]), int(shape["dim"] or 1)
    most = max(1, min(MOST_CLUSTERS, CENTRE_BYTES // (8 * dim)))
    wanted = min(most, clusters or max(1, round(math.sqrt(n) / 2)))
    rows = lib.select(F.xxhash64(F.lit(seed), "doc_id").alias("h"), "doc_id", "vec").orderBy("h", "doc_id").limit(
        wanted * SAMPLE_PER_CLUSTER).select("vec").toArrow()
    sample = _matrix(rows.column("vec")) if rows.num_rows else np.zeros((0, dim))
    centres = centres_of(sample, wanted) if len(sample) else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(centres)
    out = T.StructType([*lib.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("away", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                own, away = nearest(_matrix(batch.column("vec")), shared.value)
                columns = [*batch.select(["doc_id", "vec"]).columns, pa.array(own, pa.int32()), pa.array(away)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    dealt = written(lib.mapInArrow(deal, out), "clustered-dealt")
    known = dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()
    counts, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for row in known:
        counts[row["cluster"]], radius[row["cluster"]] = row["n"], row["away"]
    sizes = spark.createDataFrame([(r["cluster"], max(1, -(-r["n"] // CHUNK))) for r in known], "cluster int, chunks int")
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    stored = written(dealt.join(F.broadcast(sizes), "cluster").select("cluster", chunk.alias("chunk"), "doc_id", "vec"),
                     "clustered-vectors")
    packed = T.StructType([T.StructField("packet", T.BinaryType()), T.StructField("_f", T.IntegerType())])

    def pack(rows: pa.Table) -> pa.Table:
        number = rows.column("cluster")[0].as_py()
        return pa.Table.from_batches(list(packet_rows(rows.select(["doc_id", "vec"]), number)), to_arrow_schema(packed))

    packets = write_packets(stored.groupBy("cluster", "chunk").applyInArrow(pack, packed), "clustered-packets")
    return ClusteredLibrary(stored, centres, radius, counts, packets)
