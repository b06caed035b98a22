"""Z-fast prefix trie of conversations, as a table of compacted nodes.

A conversation is a path of turns; ``k0[d]``/``k1[d]`` stand for its first d + 1
turns (128 bits, an xor over turns mixed with their position), so a prefix is
compared by one key. A node of the compacted trie owns the edge of depths
``p + 1`` to ``e`` above it: the depths at which nothing branches or ends. It is
found by its *handle*, the prefix whose length is the 2-fattest number of
(p, e], that is the one with most trailing zero bits.

A batch of conversations is inserted in three steps: a fat binary search joins
the whole batch to the handles once per bit of the longest conversation and
leaves every conversation at its exit node; edges are cut where conversations
leave them; the turns beyond the exits, and only those, become new nodes.
Values of subtrees come from pointer doubling over the compacted tree, in as
many rounds as its height has bits, and edges are expanded at the end.

Defined results: turns without a conversation id are left out; null roles and
texts are empty; turns of one number stand in the order of role and digest of
the text, repeated rows are turns of their own; an empty table has no node, not
even a root. A conversation's keys (24 bytes a turn) are one row; its texts are
read once and never moved. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import stage

#: Batches end at these sixteenths of the key space: later ones meet a trie that knows most prefixes.
BATCH_ENDS = (2, 16)
#: Ids of one piece of a digest's text.
PIECE_BITS = 12

_NODE = ("e int, x0 bigint, x1 bigint, p int, y0 bigint, y1 bigint, before bigint, k0 array<bigint>, k1 array<bigint>, "
         "cum array<bigint>")


# paths

def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, role, digest, size, c0, c1)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        F.char_length(text).cast("bigint").alias("size"))
    turn = F.struct("turn", "role", "digest", "size", F.xxhash64("role", "digest").alias("c0"),
                    F.xxhash64(F.lit(1), "role", "digest").alias("c1"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the block's first conversation, then the own ones after h.

    h is the CRC-32 of the id, modulo ``heads``.
    """
    own = stage(turn_arrays(conversations), "trie-turns")
    base = own.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.slice("turns", 1, 0)
    tail = F.slice("turns", h + F.lit(1), F.greatest(F.size("turns") - h, F.lit(0)))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(base, "base", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), tail).alias("turns"))


def _mixed(content: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Turn contents mixed with their places."""
    with np.errstate(over="ignore"):
        z = content.view(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _path_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        lengths = np.asarray(cols["c0"].value_lengths(), dtype=np.int64)
        ends = np.cumsum(lengths)
        first = np.repeat(ends - lengths, lengths)
        place = np.arange(len(first)) - first
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        out, full = [], []
        for name in ("c0", "c1"):
            content = np.ascontiguousarray(np.asarray(cols[name].flatten(), dtype=np.int64))
            run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mixed(content, place))])
            keys = (run[1:] ^ run[first]).view(np.int64)
            out.append(pa.ListArray.from_arrays(offsets, pa.array(keys)))
            full.append(pa.array((run[ends] ^ run[ends - lengths]).view(np.int64)))
        sizes = np.concatenate([[0], np.cumsum(np.asarray(cols["size"].flatten(), dtype=np.int64))])
        cum = pa.ListArray.from_arrays(offsets, pa.array(sizes[1:] - sizes[first]))
        yield pa.record_batch([cols["conv_id"], full[0], full[1], pa.array(lengths, pa.int32()), out[0], out[1], cum],
                              names=["conv_id", "u0", "u1", "len", "k0", "k1", "cum"])


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, u0, u1, len, k0, k1, cum) out of (conv_id, turns): prefix keys and code points so far."""
    cut = conversations.select("conv_id", "turns.c0", "turns.c1", "turns.size")
    return cut.mapInArrow(_path_keys, "conv_id bigint, u0 bigint, u1 bigint, len int, k0 array<bigint>, k1 array<bigint>, "
                                      "cum array<bigint>")


# the trie

def two_fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] with most trailing zero bits."""
    top = F.char_length(F.bin(low.bitwiseXOR(high))) - F.lit(1)
    return F.call_function("shiftleft", F.lit(-1), top).bitwiseAND(high)


def _at(keys: str, depth: Column, start: Column | int = 0) -> Column:
    """The key at a depth, of an array that starts behind ``start``; 0 at the root."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.get(keys, depth - start - F.lit(1)))


def _edge(low: Column, high: Column, start: Column | int = 0) -> list[Column]:
    """The arrays of the edge (low, high] out of arrays that start behind ``start``."""
    start = F.lit(start) if isinstance(start, int) else start
    return [F.slice(c, low - start + F.lit(1), high - low).alias(c) for c in ("k0", "k1", "cum")]


class ZFastTrie:
    """The compacted nodes of all inserted paths, but for the root: ``nodes``."""

    def __init__(self, spark):
        self.nodes = spark.createDataFrame([], _NODE)
        self.empty = True

    def handles(self) -> DataFrame:
        f = two_fattest(F.col("p"), F.col("e"))
        return self.nodes.select(f.alias("f"), _at("k0", f, F.col("p")).alias("h0"), _at("k1", f, F.col("p")).alias("h1"),
                                 F.col("e").alias("ne"), F.col("p").alias("np"), F.col("x0").alias("n0"), F.col("x1").alias("n1"))

    def locate(self, found: DataFrame, longest: int) -> DataFrame:
        """Paths with their exit: (x0, x1, p, e) of the node whose edge they leave, and the depth ``s`` they share.

        Without an exit node the path shares the whole of a node at depth ``s`` and goes on, or ends there.
        """
        zero = F.lit(0)
        state = found.withColumns({"a": zero, "b": F.col("len"), "x0": F.lit(None).cast("bigint"), "x1": F.lit(None).cast("bigint")})
        handles = self.handles()
        kept = [c for c in state.columns if c not in ("a", "b", "x0", "x1")]
        for _ in range(longest.bit_length()):
            f = F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b")))
            asked = state.withColumn("f", f).withColumns({"h0": F.get("k0", F.col("f") - 1), "h1": F.get("k1", F.col("f") - 1)})
            met = asked.join(handles, ["f", "h0", "h1"], "left")
            hit = F.col("ne").isNotNull()
            whole = hit & (F.col("ne") <= F.col("len")) & (F.get("k0", F.col("ne") - 1) == F.col("n0")) & (
                F.get("k1", F.col("ne") - 1) == F.col("n1"))
            inside = hit & ~F.coalesce(whole, F.lit(False))
            state = met.select(
                *kept, F.when(whole, F.col("ne")).otherwise(F.col("a")).alias("a"),
                F.when(inside, F.col("a")).when(F.col("f").isNotNull() & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
                F.when(inside, F.col("n0")).otherwise(F.col("x0")).alias("x0"),
                F.when(inside, F.col("n1")).otherwise(F.col("x1")).alias("x1"))
        # an edge left before its handle is known by its first turn
        first = self.nodes.select((F.col("p") + 1).alias("f"), F.get("k0", zero).alias("h0"), F.get("k1", zero).alias("h1"),
                                  F.col("x0").alias("n0"), F.col("x1").alias("n1"))
        asks = F.col("x0").isNull() & (F.col("a") < F.col("len"))
        asked = state.withColumn("f", F.when(asks, F.col("a") + 1)).withColumns(
            {"h0": F.get("k0", F.col("f") - 1), "h1": F.get("k1", F.col("f") - 1)})
        exits = asked.join(first, ["f", "h0", "h1"], "left").select(
            *kept, "a", F.coalesce("x0", "n0").alias("x0"), F.coalesce("x1", "n1").alias("x1"))
        edges = self.nodes.select("x0", "x1", "p", "e", F.col("k0").alias("q0"), F.col("k1").alias("q1"))
        shared = F.size(F.filter(F.sequence(zero, F.col("e") - F.col("p") - 1), lambda i: (
            F.get("q0", i) == F.get("k0", F.col("p") + i)) & (F.get("q1", i) == F.get("k1", F.col("p") + i))))
        return exits.join(edges, ["x0", "x1"], "left").select(
            *kept, "x0", "x1", "p", "e", F.when(F.col("e").isNull(), F.col("a")).otherwise(F.col("p") + shared).alias("s"))

    def insert(self, found: DataFrame, longest: int) -> None:
        """Add distinct paths (u0, u1, len, k0, k1, cum) of at most ``longest`` turns."""
        if self.empty:
            none = F.lit(None)
            located = found.withColumns({"x0": none.cast("bigint"), "x1": none.cast("bigint"), "p": none.cast("int"),
                                         "e": none.cast("int"), "s": F.lit(0)})
        else:
            located = self.locate(found, longest)
        located = stage(located, "trie-located")
        cuts = located.filter((F.col("s") > F.col("p")) & (F.col("s") < F.col("e"))).groupBy("x0", "x1").agg(
            F.sort_array(F.collect_set("s")).alias("cuts"))
        self.nodes = stage(self._cut(cuts).unionByName(self._tails(located.filter("len > s"))), "trie-nodes")
        self.empty = False

    def _cut(self, cuts: DataFrame) -> DataFrame:
        """All nodes, those with cuts in pieces."""
        stops = F.concat(F.array("p"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("e"))
        pieces = self.nodes.join(cuts, ["x0", "x1"], "left").withColumn("stops", stops).withColumn(
            "i", F.explode(F.sequence(F.lit(0), F.size("stops") - 2))).withColumns(
            {"low": F.get("stops", F.col("i")), "high": F.get("stops", F.col("i") + 1)})
        low, high, top = F.col("low"), F.col("high"), F.col("p")
        own = lambda key, above: F.when(low == top, F.col(above)).otherwise(F.get(key, low - top - F.lit(1)))
        return pieces.select(
            high.alias("e"), _at("k0", high, top).alias("x0"), _at("k1", high, top).alias("x1"), low.alias("p"),
            own("k0", "y0").alias("y0"), own("k1", "y1").alias("y1"), own("cum", "before").alias("before"), *_edge(low, high, top))

    @staticmethod
    def _tails(located: DataFrame) -> DataFrame:
        """Nodes of the turns beyond the exits: depths at which a path ends or two of them part."""
        steps = located.select("u0", "u1", "len", "s", "k0", "k1", F.explode(F.sequence(F.col("s") + 1, F.col("len"))).alias("d"))
        d = F.col("d")
        steps = stage(steps.select("u0", "u1", "d", (d == F.col("len")).alias("last"), _at("k0", d).alias("x0"),
                                   _at("k1", d).alias("x1"), _at("k0", d - 1).alias("y0"), _at("k1", d - 1).alias("y1")), "trie-steps")
        own = steps.groupBy("x0", "x1").agg(F.max("last").alias("ends"), F.min(F.struct("u0", "u1")).alias("rep"),
                                            F.first("y0").alias("y0"), F.first("y1").alias("y1"))
        forks = own.groupBy(F.col("y0").alias("x0"), F.col("y1").alias("x1")).agg(F.count(F.lit(1)).alias("ways"))
        stops = own.join(forks, ["x0", "x1"], "left").filter(F.col("ends") | (F.col("ways") > 1)).select("x0", "x1", "rep")
        listed = steps.join(stops, ["x0", "x1"]).groupBy("u0", "u1").agg(F.sort_array(F.collect_list(F.struct(
            "d", (F.col("rep") == F.struct("u0", "u1")).alias("mine")))).alias("stops"))
        made = located.join(listed, ["u0", "u1"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("stops") - 1)))
        made = made.withColumns({"low": F.when(F.col("i") == 0, F.col("s")).otherwise(F.get("stops", F.col("i") - 1)["d"]),
                                 "high": F.get("stops", F.col("i"))["d"]}).filter(F.get("stops", F.col("i"))["mine"])
        low, high = F.col("low"), F.col("high")
        return made.select(high.alias("e"), _at("k0", high).alias("x0"), _at("k1", high).alias("x1"), low.alias("p"),
                           _at("k0", low).alias("y0"), _at("k1", low).alias("y1"), _at("cum", low).alias("before"),
                           *_edge(low, high))


def subtree_totals(tree: DataFrame, sums: list[str], lows: list[str] = ()) -> DataFrame:
    """(x0, x1, sums, lows) of every node with all below it, out of nodes (x0, x1, y0, y1) with own values.

    Pointer doubling: after k rounds a node holds what lies less than 2^k below it and points 2^k up.
    A null y0 marks the root.
    """
    values = [*sums, *lows]
    now = stage(tree.select("x0", "x1", "y0", "y1", *values), "trie-totals")
    while not now.filter("y0 IS NOT NULL").isEmpty():
        below = now.filter("y0 IS NOT NULL").groupBy("y0", "y1").agg(
            *[F.sum(c).alias(f"{c}_") for c in sums], *[F.min(c).alias(f"{c}_") for c in lows]).withColumnsRenamed(
            {"y0": "x0", "y1": "x1"})
        up = now.filter("y0 IS NOT NULL").select("x0", "x1", F.col("y0").alias("m0"), F.col("y1").alias("m1")).join(
            now.filter("y0 IS NOT NULL").select(F.col("x0").alias("m0"), F.col("x1").alias("m1"), "y0", "y1"), ["m0", "m1"]
        ).select("x0", "x1", "y0", "y1")
        now = stage(now.drop("y0", "y1").join(below, ["x0", "x1"], "left").join(up, ["x0", "x1"], "left").select(
            "x0", "x1", "y0", "y1", *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums],
            *[F.least(c, f"{c}_").alias(c) for c in lows]), "trie-totals")
    return now.drop("y0", "y1")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per (u0, u1) over sorted pieces; only the state is held."""
    names = ["u0", "u1", "sha"]
    last, state = None, None
    for batch in batches:
        done = []
        for u0, u1, piece in zip(*[batch.column(c).to_pylist() for c in ("u0", "u1", "piece")]):
            if (u0, u1) != last:
                if state is not None:
                    done.append((*last, state.hexdigest()))
                last, state = (u0, u1), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=names)
    if state is not None:
        yield pa.record_batch([pa.array([v]) for v in (*last, state.hexdigest())], names=names)


def member_digests(members: DataFrame) -> DataFrame:
    """(u0, u1, sha): digest of the ascending, comma-joined ids of each path; ids are joined in pieces first."""
    pieces = members.groupBy("u0", "u1", F.shiftright("conv_id", PIECE_BITS).alias("part")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    return pieces.repartition("u0", "u1").sortWithinPartitions("u0", "u1", "part").mapInArrow(
        _digest, "u0 bigint, u1 bigint, sha string")


def trie_nodes(found: DataFrame, batch_ends: tuple[int, ...] = BATCH_ENDS) -> DataFrame:
    """All nodes of the trie of ``paths`` rows: see op12 for the columns."""
    found = stage(found, "trie-paths")
    classes = stage(found.groupBy("u0", "u1", "len").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.first(F.struct("k0", "k1", "cum")).alias("a")
    ).select("u0", "u1", "len", "n", "low", "a.*"), "trie-classes")
    longest = classes.agg(F.max("len")).first()[0]
    trie = ZFastTrie(found.sparkSession)
    part = F.pmod("u0", F.lit(16))
    for start, end in zip((0, *batch_ends), batch_ends):
        trie.insert(classes.filter((F.col("len") > 0) & (part >= start) & (part < end)).select(
            "u0", "u1", "len", "k0", "k1", "cum"), longest or 0)

    at_root = {"p": F.lit(-1), "y0": F.lit(None), "y1": F.lit(None)}
    root = classes.limit(1).select(*[at_root.get(f.name, F.array() if f.name in ("k0", "k1", "cum") else F.lit(0)).cast(
        f.dataType).alias(f.name) for f in trie.nodes.schema.fields])
    kids = trie.nodes.groupBy(F.col("y0").alias("x0"), F.col("y1").alias("x1")).agg(F.count(F.lit(1)).alias("kids"))
    ends = classes.select(F.col("u0").alias("x0"), F.col("u1").alias("x1"), "n", "low")
    nodes = stage(trie.nodes.unionByName(root).join(kids, ["x0", "x1"], "left").join(ends, ["x0", "x1"], "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "kids": F.coalesce("kids", F.lit(0)), "leaves": F.col("kids").isNull().cast("bigint")}),
        "trie-all")
    totals = subtree_totals(nodes, ["n", "leaves"], ["low"])
    nodes = stage(nodes.drop("n", "leaves", "low").join(totals, ["x0", "x1"]), "trie-counted")
    edge = F.when(F.size("cum") > 0, F.element_at("cum", -1) - F.col("before")).otherwise(F.lit(0))
    saved = subtree_totals(nodes.withColumn("saved", (F.col("n") - 1) * edge), ["saved"])
    above = nodes.select(F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("low").alias("above"))
    full = nodes.join(saved, ["x0", "x1"]).join(above, ["y0", "y1"], "left").join(
        member_digests(found).withColumnsRenamed({"u0": "x0", "u1": "x1"}), ["x0", "x1"], "left")

    # edges expand: every depth but the last has one child and no end
    depth = F.explode(F.when(F.col("e") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("p") + 1, F.col("e"))))
    rows = full.withColumn("d", depth)
    at_end, d = F.col("d") == F.col("e"), F.col("d")
    spent = F.when(d - F.col("p") <= 1, F.lit(0)).otherwise(F.get("cum", d - F.col("p") - 2) - F.col("before"))
    return rows.select(
        F.col("low").alias("conv_id"), d.cast("bigint").alias("depth"),
        F.when(d - F.col("p") == 1, F.col("above")).otherwise(F.when(d > 0, F.col("low"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_end, F.col("kids")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - (F.col("n") - 1) * spent).alias("saved_tokens"),
        F.coalesce(F.when(at_end, F.col("sha")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie_nodes(paths(rebuilt(conversations)))
