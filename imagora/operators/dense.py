"""Exact inner-product search, computed block by block inside the tasks.

Each task multiplies an Arrow batch of library vectors with a block of query
vectors and keeps the k best per query, so only k rows per query leave a task;
score pairs are never rows. Where there are many queries, a task holds a block of
them and reads the stored library through, packet by packet: the library is not
shuffled, and a query's ranks are final when its task ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from imagora.operators import ranking, sizing
from imagora.session import written

BLOCK_CELLS = 1 << 20
BLOCK_QUERIES = 256
CHECKED = 1 << 16
QUERY_BLOCK_BYTES = 64 << 20
GRID_QUERIES = 4096
GRID_BYTES = 64 << 20
# hits that a block of queries holds
CELL_HITS = 2 << 20
HIT_BYTES = 40
# library vectors that a task reads at a time, and sets of them looked at by their largest score
PACKET_BYTES = 8 << 20
LANES = 16


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(arr), -1) if len(arr) else flat.reshape(0, 0)


def _sortable(column) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def _by_field(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each field present in a batch with the mask of its rows."""
    codes = batch.column("field").dictionary_encode()
    index = codes.indices.to_numpy(zero_copy_only=False)
    for code, field in enumerate(codes.dictionary.to_pylist()):
        yield field, index == code


def _largest(values: np.ndarray) -> float:
    return float(np.nan_to_num(np.abs(values), nan=0.0, posinf=np.inf).max(initial=0.0))


class _Docs:
    """Library vectors in steps, as every block of queries needs them."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.largest = _largest(vecs)
        self.finite = bool(np.isfinite(vecs).all())
        step = max(k, BLOCK_CELLS // BLOCK_QUERIES)
        whole = len(ids) - len(ids) % LANES
        self.steps = []
        for lo, hi in [(lo, min(lo + step, whole)) for lo in range(0, whole, step)] + [(whole, len(ids))]:
            if lo == hi:
                continue
            part = vecs[lo:hi]
            norm = np.sqrt(np.nan_to_num(np.einsum("ij,ij->i", part, part)).max())
            with np.errstate(over="ignore"):
                self.steps.append((ids[lo:hi], part, np.ascontiguousarray(part.T, dtype=np.float32), norm))


def _reaching(scores: np.ndarray, bar: np.ndarray, finite: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that reach the bar of their row."""
    n, m = scores.shape
    wide = m // LANES
    if not finite or m % LANES or wide < 64 or not np.isfinite(bar).all():
        return np.divmod(np.flatnonzero(scores >= bar[:, None]), m)
    # the largest of each set first: late in a search few sets hold any score that counts
    sets = scores.reshape(n, LANES, wide)
    row, at = np.nonzero(sets.max(axis=1) >= bar[:, None])
    found, lane = np.nonzero(sets[row, :, at] >= bar[row, None])
    return row[found], lane * wide + at[found]


def _best_first(q: np.ndarray, s: np.ndarray, d: np.ndarray, digits: int) -> np.ndarray:
    """Order of hits by query, falling score (rounded to ``digits``) and id."""
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.rint(s * 10.0 ** digits)
        if not (np.abs(whole).max(initial=0.0) < 1 << 40 and q.max(initial=0) < 1 << 20):
            return np.lexsort((d, -s, q))
    word = q.astype(np.int64) * (1 << 42) - whole.astype(np.int64)
    order = np.argsort(word)
    word = word[order]
    same = np.flatnonzero(word[1:] == word[:-1])
    if len(same):
        tied = np.zeros(len(word), dtype=bool)
        tied[same] = tied[same + 1] = True
        at = np.flatnonzero(tied)
        order[at] = order[at][np.lexsort((d[order[at]], word[at]))]
    return order


class _Best:
    """Running k best documents for every query of one block."""

    def __init__(self, queries: np.ndarray, k: int, digits: int):
        self.queries, self.k, self.digits = queries, k, digits
        # scores that round alike differ by less
        self.slack = 1.01 * 10.0 ** -digits
        # sums of products in single precision are off by less than this, relative to the norms
        self.error = (queries.shape[1] + 4) * 2.0 ** -23 * np.linalg.norm(queries, axis=1)
        self.largest, self.finite = _largest(queries), bool(np.isfinite(queries).all())
        with np.errstate(over="ignore"):
            self.small = queries.astype(np.float32)
        self.q = np.empty(0, dtype=np.int64)
        self.s = np.empty(0)
        self.d: np.ndarray | None = None
        self.rank = np.empty(0, dtype=np.int32)
        self.waiting: list = []
        self.n_waiting = 0
        self.floor = np.full(len(queries), -np.inf)

    def offer(self, docs: _Docs, rows: np.ndarray | None = None) -> None:
        """Single precision leaves out what cannot reach the k-th score, by a bound on its
        error; the rest is scored in double precision. ``rows``: the queries asked, or all."""
        if not len(self.queries):
            return
        plain = max(self.largest, docs.largest) >= 1e15
        queries, asked, error = self.queries, self.small, self.error
        if rows is not None:
            queries, asked, error = queries[rows], asked[rows], error[rows]
        for ids, part, small, norm in docs.steps:
            scores = queries @ part.T if plain else asked @ small
            m = scores.shape[1]
            floor = self.floor if rows is None else self.floor[rows]
            slack = self.slack + error * norm + 1e-30
            if m > self.k and not np.isfinite(floor).all():
                kth = np.partition(np.nan_to_num(scores, nan=-np.inf), m - self.k, axis=1)[:, m - self.k]
                floor = np.maximum(floor, kth - slack)
            bar = np.nextafter((floor - slack).astype(scores.dtype), scores.dtype.type(-np.inf))
            qi, di = _reaching(scores, bar, docs.finite and self.finite)
            if len(qi):
                qi = qi if rows is None else rows[qi]
                exact = np.concatenate([np.einsum("ij,ij->i", self.queries[qi[i:i + CHECKED]], part[di[i:i + CHECKED]])
                                        for i in range(0, len(qi), CHECKED)])
                self.waiting.append((qi, np.round(exact, self.digits) + 0.0, ids[di]))
                self.n_waiting += len(qi)
            if self.n_waiting > 2 * len(self.floor) * self.k or not np.isfinite(self.floor).any():
                self.merge()

    def merge(self) -> None:
        """Take in what was found since the last time; the floors rise."""
        if not self.waiting:
            return
        held = [] if self.d is None else [(self.q, self.s, self.d)]
        q, s, d = (np.concatenate(parts) for parts in zip(*held, *self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = _best_first(q, s, d, self.digits)
        q, s, d = q[order], s[order], d[order]
        start = np.searchsorted(q, np.arange(len(self.floor)))
        pos = np.arange(len(q)) - start[q]
        keep = pos < self.k
        last = pos == self.k - 1
        self.floor[q[last]] = s[last]
        self.q, self.s, self.d = q[keep], s[keep], d[keep]
        self.rank = (pos[keep] + 1).astype(np.int32)

    def hits(self, keys: pa.Table, field: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The rows kept, with the keys of their queries and the columns that ``schema`` names."""
        self.merge()
        if self.d is None or not len(self.q):
            return
        rows = keys.take(pa.array(self.q))
        cols = {name: rows.column(name) for name in keys.column_names}
        cols["field"] = pa.repeat(pa.scalar(field, pa.string()), len(self.q))
        cols["doc_id"] = pa.array(self.d if self.d.dtype.kind in "iuf" else self.d.tolist())
        cols["score"] = pa.array(self.s)
        cols["rank"] = pa.array(self.rank)
        yield from pa.table({n: cols[n] for n in schema.names}).cast(schema).combine_chunks().to_batches()


def _best_of(queries: np.ndarray, k: int, digits: int) -> list[tuple[int, _Best]]:
    return [(lo, _Best(queries[lo:lo + BLOCK_QUERIES], k, digits)) for lo in range(0, len(queries), BLOCK_QUERIES)]


def _score_batches(batches: Iterator[pa.RecordBatch], blocks: dict, k: int, digits: int,
                   schema: pa.Schema, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """blocks: field -> (key table, matrix); batches hold doc_id, vec[, field]."""
    best: dict = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = _sortable(batch.column("doc_id"))
        for field, mask in _by_field(batch):
            if field not in blocks:
                continue
            docs = _Docs(ids[mask], _matrix(batch.column("vec").filter(pa.array(mask))), k)
            if field not in best:
                best[field] = _best_of(blocks[field][1], k, digits)
            for _, acc in best[field]:
                acc.offer(docs)
    for field, parts in best.items():
        for lo, acc in parts:
            yield from acc.hits(blocks[field][0].select(list(keys)).slice(lo, len(acc.floor)), field, schema)


def _blocks(table: pa.Table, keys: Sequence[str]) -> dict:
    out = {}
    fields = table.column("field")
    for field in fields.unique().to_pylist():
        sub = table if field is None else table.filter(pc.equal(fields, field))
        if field is not None:
            out[field] = (sub.select(list(keys)).combine_chunks(), _matrix(sub.column("vec")))
    return out


def search(library: DataFrame, queries: DataFrame, k: int, keys: Sequence[str],
           digits: int = ranking.SCORE_DIGITS,
           query_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """(keys..., field, doc_id, score, rank): k best per query within each field.

    ``library``: doc_id, field, vec. ``queries``: keys..., field, vec[, depth]. A query
    block of measured small size is broadcast; of a larger query side each task holds a
    block and reads the library through. Ranks beyond a query's ``depth`` may be left out.
    The queries are written once and read back, so they are not made again for every use.
    """
    spark = library.sparkSession
    lib = library.select("doc_id", F.col("field").cast("string").alias("field"), "vec") \
        .filter(F.size("vec") > 0)
    depth = F.least(F.col("depth"), F.lit(k)) if "depth" in queries.columns else F.lit(k)
    qs = written(queries.select(*keys, F.col("field").cast("string").alias("field"), "vec", depth.cast("int").alias("_depth"))
                 .filter(F.size("vec") > 0), "dense-queries")
    out_type = T.StructType([
        *[qs.schema[c] for c in keys], T.StructField("field", T.StringType()),
        T.StructField("doc_id", lib.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType())])
    out_arrow = to_arrow_schema(out_type)
    key_list = list(keys)
    asked = {r["field"]: (int(r["n"]), int(r["b"])) for r in qs.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.sum(sizing.row_bytes(qs).cast("bigint")).alias("b")).collect()
        if r["field"] is not None}
    n_queries, q_bytes = (sum(v[i] for v in asked.values()) for i in (0, 1))
    shape = {}
    if q_bytes > query_bytes or n_queries > GRID_QUERIES:
        # rows without a vector are counted too: that needs no vector of the library
        held = {r["field"]: int(r["count"]) for r in library.groupBy(
            F.col("field").cast("string").alias("field")).count().collect()}
        shape = _grid_shape(spark, {f: held[f] for f in asked if f in held}, asked, k)
        if not shape:
            return lib.limit(0).select(*[F.lit(None).cast(qs.schema[c].dataType).alias(c) for c in keys],
                                       "field", "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    best_first = [F.desc("score"), F.asc("doc_id")]
    if not shape or _broadcast_is_cheaper(lib, held, asked, shape, k, query_bytes):
        shared = spark.sparkContext.broadcast(_blocks(qs.toArrow(), key_list))

        def task(batches):
            yield from _score_batches(batches, shared.value, k, digits, out_arrow, key_list)

        return ranking.top_k(lib.mapInArrow(task, out_type), [*keys, "field"], k, best_first)
    return _streamed(lib, qs, shape, k, key_list, digits, out_type)


def _grid_shape(spark, held: dict, asked: dict, k: int) -> dict:
    """field -> (library chunks, query blocks): chunks that a broadcast could send, blocks of bounded
    bytes and hits, and about two of them for every core, dealt to the fields by their products."""
    # a product costs about as much again as 32 of its elements to look at
    work = {f: held[f] * (asked[f][1] + 256 * asked[f][0]) for f in held}
    cells = 2 * spark.sparkContext.defaultParallelism
    shape = {}
    for f, n_docs in held.items():
        n, total = asked[f]
        chunks = max(1, -(-n_docs * (total // n) // GRID_BYTES))
        share = -(-cells * work[f] // max(1, sum(work.values())))
        blocks = max(-(-2 * total // GRID_BYTES), -(-n * k // CELL_HITS), min(-(-share // chunks), -(-n // BLOCK_QUERIES)), 1)
        shape[f] = (chunks, blocks)
    return shape


def _broadcast_is_cheaper(lib: DataFrame, held: dict, asked: dict, shape: dict, k: int, query_bytes: int) -> bool:
    """Whether sending k rows per query from each scan task beats moving every query to its block.

    With many queries each task of a small library would send nearly all its
    scores, so both ways are priced by the bytes they move. A task holds the hits
    of all queries, so there may be no more of them than in a block.
    """
    n_queries, q_bytes = (sum(v[i] for v in asked.values()) for i in (0, 1))
    if q_bytes > query_bytes or n_queries * k > CELL_HITS:
        return False
    tasks = lib.rdd.getNumPartitions()
    by_task = sum(tasks * asked[f][0] * min(k, -(-held[f] // tasks)) * HIT_BYTES for f in shape)
    by_block = sum(asked[f][1] + held[f] * (asked[f][1] // asked[f][0]) for f in shape)
    return by_task <= by_block


def _bytes_of(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows_of(packet: bytes) -> pa.Table:
    return pa.ipc.open_stream(packet).read_all()


def packet_rows(rows: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
    """(packet, _f): rows (doc_id, vec) in packets of bounded size under a number."""
    most = min(PACKET_BYTES, GRID_BYTES)
    step = max(1, most * rows.num_rows // max(1, rows.nbytes))
    for lo in range(0, rows.num_rows, step):
        yield pa.RecordBatch.from_arrays([pa.array([_bytes_of(rows.slice(lo, step).combine_chunks())], pa.binary()),
                                          pa.array([number], pa.int32())], names=["packet", "_f"])


def write_packets(packets: DataFrame, name: str, parted: Sequence[str] = ()) -> DataFrame:
    # a row is as large as a page: sizes are looked at after every row
    return written(packets, name, parted, {"parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false",
                                           "parquet.block.size": str(4 * PACKET_BYTES)})


def _packets(lib: DataFrame, fields: list[str]) -> DataFrame:
    """(packet, _f): the library's vectors as written packets, ``_f`` the place of their field."""
    most = min(PACKET_BYTES, GRID_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            for field, mask in _by_field(batch):
                if field not in fields:
                    continue
                number = fields.index(field)
                parts = waiting.setdefault(number, [])
                parts.append(batch.select(["doc_id", "vec"]).filter(pa.array(mask)))
                if sum(p.nbytes for p in parts) >= most:
                    yield from packet_rows(pa.Table.from_batches(waiting.pop(number)), number)
        for number, parts in waiting.items():
            yield from packet_rows(pa.Table.from_batches(parts), number)

    return write_packets(lib.mapInArrow(pack, "packet binary, _f int"), "dense-library", ["_f"])


def query_blocks(queries: DataFrame, blocks: int, keys: list[str]) -> RDD:
    """One list of packets of the queries' rows for each block; rows of one key share a block."""
    rows = queries.withColumn("_q", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("_q").to_numpy()
            order = np.argsort(block, kind="stable")
            rows = pa.Table.from_batches([batch.drop_columns(["_q"])]).take(pa.array(order))
            numbers, first = np.unique(block[order], return_index=True)
            ends = [*first[1:].tolist(), len(order)]
            packets = [_bytes_of(rows.slice(lo, hi - lo).combine_chunks()) for lo, hi in zip(first.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packets, pa.binary())], names=["_q", "packet"])

    pieces = rows.mapInArrow(cut, "_q int, packet binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    return pieces.partitionBy(blocks, lambda q: q).mapPartitions(lambda found: [[packet for _, packet in found]])


def read_through(blocks: RDD, packets: DataFrame, begin, take, end) -> RDD:
    """Packets of rows that each block's task gives when it has read all ``packets`` (packet, ...).

    ``begin`` makes a task's state of the block's rows, ``take`` (state, row, docs) meets one
    packet, ``end`` gives the tables of the state. The packets are read from where they are
    written, by every task, in one partition: they are not shuffled.
    """
    def task(pairs):
        state = None
        for found, row in pairs:
            if state is None:
                if not found:
                    return
                state = begin(pa.concat_tables([_rows_of(p) for p in found]))
            docs = _rows_of(row["packet"])
            take(state, row, docs)
        if state is not None:
            for rows in end(state):
                yield (_bytes_of(rows),)

    return blocks.cartesian(packets.coalesce(1).rdd).mapPartitions(task)


def table_of(spark: SparkSession, found: list[RDD], kind: T.StructType) -> DataFrame:
    """The rows that tasks gave as packets."""
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet in batch.column(0):
                yield from _rows_of(packet.as_buffer()).to_batches()

    packet_type = T.StructType([T.StructField("packet", T.BinaryType())])
    return spark.createDataFrame(spark.sparkContext.union(found), packet_type, verifySchema=False).mapInArrow(unpacked, kind)


def _streamed(lib: DataFrame, qs: DataFrame, shape: dict, k: int, keys: list[str], digits: int,
              out_type: T.StructType) -> DataFrame:
    """Final ranks: a task holds one block of queries of a field and reads that field's library through.

    The library is written once and read by every task from there, so nothing grows with
    vectors times blocks but reading; queries move once, and hits are not shuffled.
    """
    ranked_type = T.StructType([*out_type.fields, T.StructField("rank", T.IntegerType())])
    schema = to_arrow_schema(ranked_type)
    hit_schema = pa.schema([f for f in schema if f.name != "rank"])
    stored = _packets(lib, list(shape))

    def begin(rows: pa.Table) -> tuple:
        # queries of one depth lie together
        rows = rows.take(pa.array(np.argsort(rows.column("_depth").to_numpy(), kind="stable")))
        depth, vecs = rows.column("_depth").to_numpy(), _matrix(rows.column("vec"))
        return rows.select(keys).combine_chunks(), int(depth.max()), [
            (lo, _Best(vecs[lo:lo + BLOCK_QUERIES], int(depth[lo:lo + BLOCK_QUERIES].max()), digits))
            for lo in range(0, len(vecs), BLOCK_QUERIES)]

    def take(state: tuple, row, found: pa.Table) -> None:
        docs = _Docs(_sortable(found.column("doc_id")), _matrix(found.column("vec")), state[1])
        for _, acc in state[2]:
            acc.offer(docs)

    def ending(field: str):
        def end(state: tuple) -> Iterator[pa.Table]:
            rows, _, best = state
            again = rows.num_rows > rows.group_by(keys).aggregate([]).num_rows
            hits = (b for lo, acc in best for b in acc.hits(
                rows.slice(lo, len(acc.floor)), field, hit_schema if again else schema))
            if again:
                hits = (_ranked(b, keys, k) for b in pa.Table.from_batches(hits, hit_schema).combine_chunks().to_batches())
            for batch in hits:
                yield pa.Table.from_batches([batch]).cast(schema)
        return end

    found = []
    for i, (field, (_, blocks)) in enumerate(shape.items()):
        asked = query_blocks(qs.filter(F.col("field") == field).select(*keys, "vec", "_depth"), blocks, keys)
        found.append(read_through(asked, stored.filter(F.col("_f") == i).select("packet"), begin, take, ending(field)))
    return table_of(lib.sparkSession, found, ranked_type)


def _ranked(hits: pa.RecordBatch, keys: list[str], k: int) -> pa.RecordBatch:
    """The k best rows of every key with their rank; rows of one key may come from several queries."""
    frame = pa.table({name: hits.column(name) for name in keys}).to_pandas()
    group = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((_sortable(hits.column("doc_id")), -hits.column("score").to_numpy(), group))
    first = np.searchsorted(group[order], group[order])
    rank = np.arange(len(order)) - first + 1
    kept = hits.take(pa.array(order[rank <= k]))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(rank[rank <= k], pa.int32())],
                                      names=[*kept.schema.names, "rank"])
