"""Mixing sources to target weights as a minimum-cost flow.

Documents are aggregated by the set of sources they belong to. Token capacity
flows from those patterns to the quotas of the sources; the c-th copy of a
token costs c, so repeats are spread as thinly as the quotas allow. Inside a
pattern, whole documents are then taken in a seeded order, in rounds: what a
document too long for the rest leaves open is filled by shorter ones behind it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagora.llm.common import BROADCAST_BYTES, small, stage, word_count
from imagora.operators.sizing import measure, salted_join

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
PREFIX = 3
SEED = "mix"
DIGITS = 6
#: A pattern is full when less than this part of its tokens is missing.
SLACK = 1000
#: Each round after the first at least halves what is missing, or is a pattern's last.
ROUNDS = 2 + SLACK.bit_length()

_END = "~"  # behind every key


def source_order(sources: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]


def share_out(sizes: Mapping, weights: Mapping, total: float, limit: float = MAX_COPIES) -> dict:
    """Targets by weight, none above ``limit`` times its size; the excess is shared again."""
    target, open_, left = {}, list(sizes), float(total)
    while open_:
        per = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * per > limit * sizes[s]]
        if not full:
            target.update({s: weights[s] * per for s in open_})
            break
        for s in full:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def min_cost_flow(capacity: Mapping, members: Mapping, quota: Mapping, copies: int = MAX_COPIES) -> dict:
    """{(pattern, source): tokens} that fills the quotas with the fewest repeats.

    ``capacity``: tokens of each pattern; ``members``: its sources. The c-th copy
    of a pattern costs c a token. Copies are opened one price at a time, which is
    the successive shortest path order here: only edges out of the start have a
    price, so every path of one price is a plain augmenting path.
    """
    flow = {(p, s): 0.0 for p in capacity for s in members[p]}
    need = dict(quota)
    by_source: dict = {}
    for p, s in flow:
        by_source.setdefault(s, []).append(p)
    for p in capacity:
        # a source of one pattern that has no other source needs no search
        if len(members[p]) == 1 and len(by_source[members[p][0]]) == 1:
            s = members[p][0]
            flow[p, s] = float(min(need.pop(s, 0.0), copies * capacity[p]))
    shared = [p for p in capacity if any(s in need for s in members[p])]
    spare = dict.fromkeys(shared, 0.0)
    for _ in range(copies):
        for p in shared:
            spare[p] += capacity[p]
        while True:
            # breadth first from patterns with spare tokens to a source in need
            came: dict = {("p", p): None for p in shared if spare[p] > 1e-9}
            queue, end = list(came), None
            while queue and end is None:
                kind, x = node = queue.pop(0)
                if kind == "p":
                    steps = [("s", s) for s in members[x]]
                else:
                    steps = [("p", p) for p in by_source[x] if flow[p, x] > 1e-9]
                for step in steps:
                    if step not in came:
                        came[step] = node
                        queue.append(step)
                        if step[0] == "s" and need.get(step[1], 0.0) > 1e-9:
                            end = step
                            break
            if end is None:
                break
            path, node = [], end
            while node is not None:
                path.append(node)
                node = came[node]
            path.reverse()
            room = min(spare[path[0][1]], need[end[1]], *[
                flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"] or [float("inf")])
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    flow[a[1], b[1]] += room
                else:
                    flow[b[1], a[1]] -= room
            spare[path[0][1]] -= room
            need[end[1]] -= room
    return flow


def draw_key(id_col: Column, seed: str = SEED) -> Column:
    """The seeded place of a document; rows of one id share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def _meet(rows: DataFrame, table: DataFrame, on: list[str], fits: bool) -> DataFrame:
    """Rows with those of a table of one row per pattern: broadcast if it fits, else salted by the rows' keys."""
    return rows.join(F.broadcast(table), on) if fits else salted_join(rows, table, on, F.col("key"))


def _fits(wanted: DataFrame) -> bool:
    """Whether plans of these patterns may be broadcast: a plan holds at most ``ROUNDS`` limits and cuts, twice."""
    count, size = measure(wanted)
    return size + count * (2 * ROUNDS * 64 + 256) <= BROADCAST_BYTES


def _reached(limits: Column, cuts: Column, size: Column, key: Column) -> Column:
    """Whether a round took the documents of this size up to this key."""
    return F.exists(F.arrays_zip(limits.alias("limit"), cuts.alias("cut")),
                    lambda r: (size <= r["limit"]) & (key <= r["cut"]))


def _round(sized: DataFrame, active: DataFrame, fits: bool) -> DataFrame:
    """(pattern, cut, gap, open): how far the order is taken, what is then missing.

    ``active``: (pattern, gap, top, last). Documents of at most ``top`` tokens
    behind ``last`` are taken in order of their keys while they fit into
    ``gap``; open patterns stopped at one that did not. Sums are taken per digest
    prefix first, and only rows of the prefix in which a pattern runs full are
    put in order.
    """
    upto = Window.partitionBy("pattern").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = _meet(sized, active, ["pattern"], fits).filter("size <= top AND key > last") \
        .withColumn("prefix", F.substring("key", 1, PREFIX))
    sums = rest.groupBy("pattern", "prefix", "gap").agg(F.sum("size").alias("s")).withColumn("cum", F.sum("s").over(upto))
    over = F.when(F.col("cum") > F.col("gap"), F.struct("prefix", (F.col("gap") - F.col("cum") + F.col("s")).alias("room")))
    edge = stage(sums.groupBy("pattern").agg(F.max("cum").alias("total"), F.min(over).alias("e")).select(
        "pattern", "total", "e.prefix", "e.room"), "mix-edge")
    inside = Window.partitionBy("pattern").orderBy("key")  # rows of one key together
    taken = F.when(F.col("cum") <= F.col("room"), F.struct("cum", "key"))
    last = _meet(rest, edge.filter("prefix IS NOT NULL").drop("total"), ["pattern", "prefix"], fits) \
        .withColumn("cum", F.sum("size").over(inside)).groupBy("pattern").agg(F.max(taken).alias("t"))
    full = F.col("prefix").isNotNull()
    missing = F.when(full, F.col("room") - F.coalesce("t.cum", F.lit(0))).otherwise(
        F.col("gap") - F.coalesce("total", F.lit(0)))
    return active.join(edge, "pattern", "left").join(last, "pattern", "left").select(
        "pattern", F.when(full, F.coalesce("t.key", "prefix")).otherwise(F.lit(_END)).alias("cut"),
        missing.alias("gap"), full.alias("open"))


def _fill(sized: DataFrame, wanted: DataFrame, fits: bool) -> DataFrame:
    """(pattern, slack, gap, limits, cuts): what the rounds take of each pattern, and what is then missing.

    ``wanted``: (pattern, gap, slack). The first round has no limit; the limit of
    a later one is half of what is missing, so that a round either closes half
    of the gap or uses up the documents of that size.
    """
    nothing = [F.array().cast("array<bigint>").alias("limits"), F.array().cast("array<string>").alias("cuts")]
    plan = stage(wanted.select("pattern", "slack", "gap", F.lit((1 << 63) - 1).alias("top"), F.lit("").alias("last"),
                               F.lit(True).alias("open"), *nothing), "mix-plan")
    for _ in range(ROUNDS):
        active = plan.filter("open AND gap > slack").select("pattern", "gap", "top", "last")
        if active.isEmpty():
            break
        done = _round(sized, active, fits).withColumnsRenamed({"cut": "_cut", "gap": "_gap", "open": "_open"})
        ran = F.col("_cut").isNotNull()
        gap = F.coalesce("_gap", "gap")
        plan = stage(plan.join(done, "pattern", "left").select(
            "pattern", "slack", gap.alias("gap"), F.when(ran, F.floor(gap / 2)).otherwise(F.col("top")).alias("top"),
            F.coalesce("_cut", "last").alias("last"), F.coalesce("_open", F.col("open")).alias("open"),
            F.when(ran, F.array_append("limits", F.col("top"))).otherwise(F.col("limits")).alias("limits"),
            F.when(ran, F.array_append("cuts", F.col("_cut"))).otherwise(F.col("cuts")).alias("cuts")), "mix-plan")
    return plan.select("pattern", "slack", "gap", "limits", "cuts")


def _least(rows: DataFrame, order: Column) -> DataFrame:
    """(pattern, order, key, size) of the row with the least order, then key and size."""
    return rows.groupBy("pattern").agg(F.min(F.struct(order.alias("order"), "key", "size")).alias("x")).select("pattern", "x.*")


def cut_points(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, copies, limits, cuts, drop_limits, drop_cuts, extra_key, extra_size): what a pattern takes.

    Every document is taken ``copies`` times, and once more if a round reaches
    it: its size is at most the round's limit and its key at most the round's
    cut. Rounds end when less than 1 / ``SLACK`` of the pattern's tokens is
    missing. If they run out of documents before, the shortest one left is
    taken as the extra document and the same rounds give back (``drop_``) what is
    then too much, if that comes nearer. Else the extra document is the one left
    that comes nearest to the gap, if it helps. ``sized``: (pattern, key, size);
    ``wanted``: (pattern, copies, rest, slack), one row per pattern.
    """
    fits = _fits(wanted)
    plan = _fill(sized, wanted.select("pattern", "slack", F.col("rest").alias("gap")), fits).join(
        wanted.select("pattern", "copies", "rest"), "pattern")
    short = plan.filter("gap > 0")
    row = [F.col("size"), F.col("key")]
    met = _meet(sized, short, ["pattern"], fits).withColumn(
        "hit", _reached(F.col("limits"), F.col("cuts"), *row))
    left = met.filter("NOT hit AND size > 0 AND size < gap + rest").groupBy("pattern", "gap", "slack", "rest", "key", "size") \
        .agg((F.count(F.lit(1)) * F.col("size")).alias("total"))
    off = F.abs(F.col("total") - F.col("gap"))
    near = _least(left.filter(off < F.col("gap")), off).drop("order")
    pivot = stage(_least(left.filter("gap > slack AND total > gap AND total < gap + rest"), F.col("total") - F.col("gap"))
                  .join(plan.select("pattern", "slack", F.col("gap").alias("gap_before")), "pattern"), "mix-pivot")
    back = _fill(met.filter("hit").select("pattern", "key", "size"), pivot.select("pattern", "slack", F.col("order").alias("gap")), fits)
    swap = back.join(pivot.drop("slack", "order"), "pattern").filter("gap < gap_before").select(
        "pattern", F.col("limits").alias("drop_limits"), F.col("cuts").alias("drop_cuts"),
        F.col("key").alias("swap_key"), F.col("size").alias("swap_size"))
    swapped = F.col("swap_key").isNotNull()
    return stage(plan.join(near, "pattern", "left").join(swap, "pattern", "left").select(
        "pattern", "copies", "limits", "cuts", F.coalesce("drop_limits", F.array().cast("array<bigint>")).alias("drop_limits"),
        F.coalesce("drop_cuts", F.array().cast("array<string>")).alias("drop_cuts"),
        F.when(swapped, F.col("swap_key")).otherwise(F.col("key")).alias("extra_key"),
        F.when(swapped, F.col("swap_size")).otherwise(F.col("size")).alias("extra_size")), "mix-cuts")


def weight_rule(sources: Sequence[str | None], weights: Sequence[float] = WEIGHTS) -> dict:
    """The weights in turn, over the sources by code point."""
    return {s: weights[i % len(weights)] for i, s in enumerate(source_order(sources))}


class Mix:
    """Copies per document for target shares of overlapping sources.

    ``sources``: a string column, or an array of them for documents of several
    sources. Fitting aggregates the corpus; what reaches the driver is one row
    per distinct set of sources. ``targets`` and ``sizes`` are by source.
    """

    def __init__(self, docs: DataFrame, sources: Column, weights=weight_rule, share: float = SHARE,
                 max_copies: int = MAX_COPIES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        self.size = word_count(F.col(f"`{text_col}`"))
        self.key = draw_key(F.col(f"`{id_col}`"), seed)
        kind = docs.select(sources.alias("s")).schema["s"].dataType.typeName()
        own = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))) \
            if kind == "array" else F.array(sources.cast("string"))
        self.pattern = F.to_json(own)
        sized = stage(docs.select(self.pattern.alias("pattern"), own.alias("own"), self.key.alias("key"),
                                  self.size.alias("size")), "mix-sizes")
        rows = sized.groupBy("pattern").agg(F.first("own").alias("own"), F.sum("size").alias("size")).collect()
        capacity = {r["pattern"]: int(r["size"]) for r in rows}
        members = {r["pattern"]: source_order(r["own"]) for r in rows}
        self.sizes: dict = {}
        for p in sorted(capacity):
            for s in members[p]:
                self.sizes[s] = self.sizes.get(s, 0) + capacity[p]
        total = share * sum(capacity.values())
        wanted = share_out(self.sizes, weights(list(self.sizes)), total, max_copies)
        self.targets = {s: round(t, DIGITS) for s, t in wanted.items()}
        self.flow = min_cost_flow(capacity, members, self.targets, max_copies)
        plan = []
        for p, cap in capacity.items():
            tokens = math.floor(sum(self.flow[p, s] for s in members[p]) + 0.5)
            copies = min(max_copies, tokens // cap) if cap else 0
            # with no further copy to give, nothing is missing
            plan.append((p, copies, tokens - copies * cap if copies < max_copies else 0, tokens // SLACK))
        wanted_rows = spark.createDataFrame(plan, "pattern string, copies int, rest bigint, slack bigint")
        self.fits = _fits(wanted_rows)
        self.plan = cut_points(sized.drop("own"), wanted_rows)

    def copies(self, docs: DataFrame, name: str = "copies") -> DataFrame:
        """The rows of ``docs`` with the number of times that the mix takes each."""
        found = self.counted(docs)
        return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("times").alias(name))

    def counted(self, docs: DataFrame) -> DataFrame:
        """(row, times): whole rows, and the number of times that the mix takes each."""
        own = [F.col(f"`{c}`") for c in docs.columns]
        row = docs.select(F.struct(*own).alias("row"), self.pattern.alias("pattern"), self.key.alias("key"),
                          self.size.alias("size"))
        size, key = F.col("size"), F.col("key")
        once_more = (_reached(F.col("limits"), F.col("cuts"), size, key)
                     & ~_reached(F.col("drop_limits"), F.col("drop_cuts"), size, key)) | (
            key.eqNullSafe(F.col("extra_key")) & size.eqNullSafe(F.col("extra_size")))
        return _meet(row, self.plan, ["pattern"], self.fits).select(
            "row", (F.col("copies") + once_more.cast("int")).alias("times"))


def mix_documents(docs: DataFrame, share: float = SHARE, max_copies: int = MAX_COPIES, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row.

    Size is the number of words, 0 for a null text; a text of any length counts
    whole. Null is a source of its own, ordered last. Rows of one id and one size
    are taken together, so repeated rows are equal. Documents without words are
    never short of anything: they take 0. A corpus without words has targets of 0.
    Other columns are not read. An empty table gives an empty result. What a
    source takes misses its target by more than 1 / ``SLACK`` only if it has too few
    documents short enough to fill what its long ones leave open.
    """
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`")
    mix = Mix(docs, source, share=share, max_copies=max_copies, id_col=id_col, text_col=text_col)
    rows = [(s, mix.sizes[s], mix.targets[s]) for s in mix.sizes]
    table = spark.createDataFrame(rows, "_s string, source_size bigint, target double")
    taken = mix.copies(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), source), "_copies")
    return taken.join(small(table), source.cast("string").eqNullSafe(F.col("_s"))).select(
        F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), mix.size.alias("size"), "source_size", "target",
        (F.col("_copies") * mix.size).alias("taken"))
