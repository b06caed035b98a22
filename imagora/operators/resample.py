"""Bootstrap of means: paired, stratified and hierarchical.

Two engines give the replicate means. ``hashed_means`` draws indices by integer
mixing, so SQL can repeat it draw by draw. ``multinomial_means`` is for large groups:
equal values are counted first, the draws of a replicate are split over chunks
of distinct values and then inside each chunk, and no draw ever becomes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from imagora.functions.hashing import MULTIPLIERS, SHIFTS, WORD_MASK, draw, mix_word, seed_word
from imagora.operators import ranking, sizing

MEAN_DIGITS = 12
CHUNK_VALUES = 1 << 16
REPLICATE_BLOCK = 1024
SLAB_CELLS = 1 << 22
# draws a task holds at a time; they stay in the processor's cache
DRAW_CELLS = 1 << 16
# ranks whose values a task holds, and slots it draws for
DRAW_CHUNK = 1 << 21
DRAW_SLOTS = 1 << 20


def named_seed(key: str, base_seed: int = 0) -> int:
    """Seed from a comparison's name, independent of the order of comparisons."""
    head = hashlib.sha256(key.encode()).digest()[:8]
    return (int.from_bytes(head, "big") ^ base_seed) % (1 << 63)


def hashed_means(values: DataFrame, group: Sequence[str], value: str, replicates: int,
                 seed: int | str = 0) -> DataFrame:
    """(group, replicate, mean): each replicate draws n rows of the group with
    replacement. Slot i of replicate b takes index mix(mix(i) xor mix(word + b)) mod n,
    where word is the digest of seed:group; groups hold fewer than 2^31 rows."""
    rows = values.select(*group, "instance_id", F.col(value).cast("double").alias("_v"))
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(g).cast("string") for g in group])
    # digests and slot words once per row, before the rows multiply
    worded = ranking.hashed_rank(rows, group, ["instance_id"], seed).select(
        *group, "draw_rank", "group_n", "_v", seed_word(key).alias("_k"),
        mix_word(F.col("draw_rank").cast("bigint")).alias("_slot"))
    # a measured table of this size bounds every group in it
    draws = _array_draws if sizing.fits_broadcast(rows) else _chunked_draws
    return draws(worded, group, replicates).withColumn("mean", F.round("mean", MEAN_DIGITS))


def _array_draws(worded: DataFrame, group: Sequence[str], replicates: int) -> DataFrame:
    """Draws of small groups as arrays: a task holds one group and one block of
    replicates, and no draw becomes a row."""
    g = list(group)
    blocks = -(-replicates // REPLICATE_BLOCK)
    fields = ", ".join(f"`{c}` {worded.schema[c].dataType.simpleString()}" for c in g)

    def mixed(word: np.ndarray) -> np.ndarray:
        for factor, shift in zip(MULTIPLIERS, SHIFTS):
            word = (word * factor) & WORD_MASK
            word ^= word >> shift
        return word

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw_rank")
        v, slot = pdf["_v"].to_numpy(), pdf["_slot"].to_numpy(dtype=np.int64)
        first = int(pdf["_block"].iloc[0]) * REPLICATE_BLOCK
        reps = np.arange(first, min(replicates, first + REPLICATE_BLOCK), dtype=np.int64)
        word = mixed((int(pdf["_k"].iloc[0]) + reps) & WORD_MASK)
        slab = max(1, DRAW_CELLS // len(v))
        out = np.concatenate([
            v[mixed(word[i:i + slab, None] ^ slot[None, :]) % len(v)].mean(axis=1)
            for i in range(0, len(reps), slab)])
        table = pd.DataFrame({"replicate": reps, "mean": out})
        for c in reversed(g):
            table.insert(0, c, pdf[c].iloc[0])
        return table

    each = worded.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = int(worded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(parts, *g, "_block").groupBy(*g, "_block").applyInPandas(
        means, f"{fields}, replicate int, mean double")


def _mixed(word: np.ndarray) -> np.ndarray:
    """`hashing.mix_word` in 32-bit words, which hold all the bits it keeps; changes its argument."""
    for factor, shift in zip(MULTIPLIERS, SHIFTS):
        word *= np.uint32(factor)
        word &= np.uint32(WORD_MASK)
        word ^= word >> np.uint32(shift)
    return word


def _draw_sums(v: np.ndarray, low: int, n: int, slots: range, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every replicate word: sum and number of the values that the slots draw out of
    ``v``, which holds ranks ``low`` and following of a group of ``n``."""
    known = ~np.isnan(v)
    whole = low == 0 and len(v) == n
    plain = bool(known.all())
    v = np.where(known, v, 0.0)
    sums, counts = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64)
    size, start = np.uint32(n), np.uint32(low)
    for first in range(slots.start, slots.stop, DRAW_CELLS):
        slot = _mixed(np.arange(first, min(slots.stop, first + DRAW_CELLS), dtype=np.uint32))
        for b, word in enumerate(words):
            at = _mixed(slot ^ word)
            at -= at // size * size
            if not whole:
                at -= start
                at = at[at < len(v)]
            sums[b] += v.take(at).sum()
            counts[b] += len(at) if plain else int(known.take(at).sum())
    return sums, counts


def _chunked_draws(worded: DataFrame, group: Sequence[str], replicates: int) -> DataFrame:
    """Draws of groups of any size: a task holds the values of one chunk of ranks and one
    block of replicates, draws the slots itself and keeps those that fall into its chunk,
    so only a sum and a count per replicate leave it and no draw becomes a row."""
    g = list(group)
    key_fields = [worded.schema[c] for c in g]
    long, whole = T.LongType(), T.IntegerType()
    packed_type = T.StructType([*key_fields, T.StructField("_chunk", long), T.StructField("group_n", long),
                                T.StructField("_k", long), T.StructField("_values", T.BinaryType())])
    packed_arrow = to_arrow_schema(packed_type)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("draw_rank")
        values = rows.column("_v").to_numpy().astype(np.float64)
        return rows.slice(0, 1).drop_columns(["draw_rank", "_v"]).append_column(
            "_values", pa.array([values.tobytes()], pa.binary())).select(packed_arrow.names).cast(packed_arrow)

    chunk = F.floor(F.col("draw_rank") / F.lit(DRAW_CHUNK)).cast("bigint")
    packed = worded.select(*g, chunk.alias("_chunk"), F.col("draw_rank").cast("bigint").alias("draw_rank"),
                           F.col("group_n").cast("bigint").alias("group_n"), "_k", "_v").groupBy(
        *g, "_chunk").applyInArrow(pack, packed_type)
    blocks = -(-replicates // REPLICATE_BLOCK)
    parts = F.ceil(F.col("group_n") / F.lit(DRAW_SLOTS)).cast("int")
    cells = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - F.lit(1))))
    out_type = T.StructType([*key_fields, T.StructField("replicate", whole), T.StructField("_s", T.DoubleType()),
                             T.StructField("_c", long)])
    out_arrow = to_arrow_schema(out_type)

    def cell(rows: pa.Table) -> pa.Table:
        row = {name: rows.column(name)[0].as_py() for name in ("_chunk", "group_n", "_k", "_block", "_part", "_values")}
        first, slot = row["_block"] * REPLICATE_BLOCK, row["_part"] * DRAW_SLOTS
        reps = np.arange(first, min(replicates, first + REPLICATE_BLOCK), dtype=np.int64)
        words = _mixed(((row["_k"] + reps) & WORD_MASK).astype(np.uint32))
        sums, counts = _draw_sums(np.frombuffer(row["_values"]), row["_chunk"] * DRAW_CHUNK, row["group_n"],
                                  range(slot, min(row["group_n"], slot + DRAW_SLOTS)), words)
        keys = rows.select(g).take(pa.array(np.zeros(len(reps), dtype=np.int64)))
        for name, column in (("replicate", reps), ("_s", sums), ("_c", counts)):
            keys = keys.append_column(name, pa.array(column))
        return keys.cast(out_arrow)

    # cells, not bytes, are the work
    spread = int(worded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = [*g, "_chunk", "_block", "_part"]
    return cells.repartition(spread, *on).groupBy(*on).applyInArrow(cell, out_type).groupBy(*g, "replicate").agg(
        (F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0).cast("bigint"))).alias("mean"))


def multinomial_means(values: DataFrame, group: Sequence[str], value: str, replicates: int,
                      seed: int = 0, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """(group, replicate, mean) by multinomial counts over distinct values.

    The same distribution as drawing rows, with work that grows with distinct
    values. A task holds one chunk of values or one block of replicates.
    """
    g = list(group)
    cells = values.groupBy(*g, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_w"))
    per_group = cells.groupBy(*g).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(chunk_values)).cast("int").alias("_chunks"))
    chunked = cells.join(per_group, g).withColumn(
        "_chunk", F.pmod(F.xxhash64("_v"), F.col("_chunks")).cast("int")).drop("_chunks")
    weights = chunked.groupBy(*g, "_chunk").agg(F.sum("_w").alias("_cw"))
    blocks = -(-replicates // REPLICATE_BLOCK)
    by_block = weights.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key_fields = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in g)

    def split_draws(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        block = int(pdf["_block"].iloc[0])
        names = ":".join(str(pdf[c].iloc[0]) for c in g)
        w = pdf["_cw"].to_numpy(dtype=np.int64)
        total = int(w.sum())
        rng = np.random.default_rng(named_seed(f"split:{names}:{block}", seed))
        reps = np.arange(block * REPLICATE_BLOCK, min(replicates, (block + 1) * REPLICATE_BLOCK))
        counts = rng.multinomial(total, w / total, size=len(reps))
        out = pd.DataFrame({
            "_chunk": np.tile(pdf["_chunk"].to_numpy(), len(reps)),
            "replicate": np.repeat(reps, len(w)), "_draws": counts.ravel(), "_n": total})
        for c in reversed(g):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    draws = by_block.groupBy(*g, "_block").applyInPandas(
        split_draws, f"{key_fields}, _chunk int, replicate int, _draws bigint, _n bigint")

    def chunk_sums(cell: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        cell, todo = cell.sort_values("_v"), todo.sort_values("replicate")
        names = ":".join(str(cell[c].iloc[0]) for c in [*g, "_chunk"])
        v, w = cell["_v"].to_numpy(), cell["_w"].to_numpy(dtype=np.float64)
        p = w / w.sum()
        rng = np.random.default_rng(named_seed(f"chunk:{names}", seed))
        n = todo["_draws"].to_numpy()
        slab = max(1, SLAB_CELLS // len(v))
        sums = np.concatenate([rng.multinomial(n[i:i + slab], p) @ v
                               for i in range(0, len(n), slab)])
        out = pd.DataFrame({"replicate": todo["replicate"].to_numpy(), "_s": sums,
                            "_n": todo["_n"].to_numpy()})
        for c in reversed(g):
            out.insert(0, c, cell[c].iloc[0])
        return out

    keys = [*g, "_chunk"]
    sums = chunked.groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInPandas(
        chunk_sums, f"{key_fields}, replicate int, _s double, _n bigint")
    return sums.groupBy(*g, "replicate").agg(
        F.round(F.sum("_s") / F.max("_n"), MEAN_DIGITS).alias("mean"))


def p_uncapped(mean: Column) -> Column:
    return F.lit(2.0) * F.least(F.avg((mean <= 0).cast("double")), F.avg((mean >= 0).cast("double")))


def p_capped(mean: Column) -> Column:
    return F.least(F.lit(1.0), p_uncapped(mean))


def p_one_count(mean: Column) -> Column:
    """From the number of non-positive replicates alone."""
    c, b = F.count_if(mean <= 0), F.count(mean)
    return F.least(F.lit(1.0), F.lit(2.0) * F.least(c, b - c) / b)


P_VALUES = {"uncapped": p_uncapped, "capped": p_capped, "one_count": p_one_count}


def summarize(means: DataFrame, group: Sequence[str], p_value: str = "capped") -> DataFrame:
    """(group, ci_low, ci_high, p_two_sided, dist_mean, replicates)."""
    bounds = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    out = means.groupBy(*group).agg(
        bounds.alias("_b"), P_VALUES[p_value](F.col("mean")).alias("p_two_sided"),
        F.avg("mean").alias("dist_mean"), F.count(F.lit(1)).alias("replicates"))
    return out.select(*group, F.get("_b", F.lit(0)).alias("ci_low"),
                      F.get("_b", F.lit(1)).alias("ci_high"), "p_two_sided", "dist_mean", "replicates")


def observed(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, mean_a, mean_b, difference) of paired values a and b."""
    return pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg(F.col("a") - F.col("b")).alias("difference"))


def paired(pairs: DataFrame, group: Sequence[str], replicates: int, seed: int | str = 0,
           p_value: str = "capped", engine=hashed_means) -> DataFrame:
    """Observed statistics joined with the bootstrap summary, one row per group."""
    diffs = pairs.withColumn("_diff", F.col("a") - F.col("b"))
    boot = summarize(engine(diffs, group, "_diff", replicates, seed), group, p_value)
    obs = observed(pairs, group)
    return obs.join(boot, list(group))


def macro(pairs: DataFrame, group: Sequence[str], stratum: str, replicates: int,
          seed: int | str = 0) -> DataFrame:
    """Resampling inside each stratum, replicate means averaged over strata.

    The reported difference is the mean of the distribution.
    """
    diffs = pairs.withColumn("_diff", F.col("a") - F.col("b"))
    per = hashed_means(diffs, [*group, stratum], "_diff", replicates, seed)
    means = per.groupBy(*group, "replicate").agg(F.round(F.avg("mean"), MEAN_DIGITS).alias("mean"))
    boot = summarize(means, group).withColumnRenamed("dist_mean", "difference")
    obs = observed(pairs, [*group, stratum]).groupBy(*group).agg(
        F.sum("n").alias("n_instances"), F.count(F.lit(1)).alias("n_strata"),
        F.avg("mean_a").alias("mean_a"), F.avg("mean_b").alias("mean_b"))
    return obs.join(boot, list(group))


def hierarchical(cells: DataFrame, group: Sequence[str], outer: str, inner: str,
                 replicates: int, seed: int | str = 0) -> DataFrame:
    """Resample outer units, then inner units within each sampled outer unit.

    ``cells``: group, outer, inner, a, b over a full outer x inner matrix; the matrix of a
    group (models x domains) is held as one array.
    """
    diff = cells.withColumn("_d", F.col("a") - F.col("b"))
    units = ranking.hashed_rank(diff.select(*group, outer).distinct(), group, [outer], seed,
                                "_oi", "_on")
    inners = ranking.hashed_rank(diff.select(*group, inner).distinct(), group, [inner], seed,
                                 "_ii", "_in")
    sizes = units.select(*group, "_on").distinct().join(
        inners.select(*group, "_in").distinct(), list(group))
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in group])
    # a group's matrix is one array, so draws look cells up in their own row and nothing is joined per draw
    indexed = diff.join(units.drop("_on"), [*group, outer]).join(inners.drop("_in"), [*group, inner]).join(sizes, list(group))
    place = (F.col("_oi") * F.col("_in") + F.col("_ii")).cast("int")
    cells_at = indexed.select(*group, "_on", "_in", place.alias("_p"), "_d").groupBy(*group, "_on", "_in", "_p").agg(
        F.sum("_d").alias("_s"), F.count("_d").alias("_c"))
    matrix = cells_at.groupBy(*group, "_on", "_in").agg(
        F.map_from_entries(F.collect_list(F.struct("_p", F.struct("_s", "_c")))).alias("_m")).select(
        *group, "_on", "_in", F.transform(F.sequence(F.lit(0), (F.col("_on") * F.col("_in") - 1).cast("int")),
                                          lambda p: F.try_element_at("_m", p)).alias("_m"))
    upto = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    row = lambda i, at: F.transform(upto("_in"), lambda j: F.get("_m", (
        at * F.col("_in") + draw(F.concat_ws(":", key, i.cast("string")), F.col("replicate"), j, F.col("_in"))).cast("int")))
    drawn = F.flatten(F.transform(upto("_on"), lambda i: F.flatten(F.transform(
        F.array(draw(key, F.col("replicate"), i, F.col("_on"))), lambda at: row(i, at)))))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = matrix.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(parts, "replicate")
    so_far = lambda total, count: F.struct(total.alias("total"), count.alias("count"))
    mean = F.aggregate(drawn, so_far(F.lit(0.0), F.lit(0).cast("bigint")), lambda t, x: so_far(
        t["total"] + F.coalesce(x["_s"], F.lit(0.0)), t["count"] + F.coalesce(x["_c"], F.lit(0).cast("bigint"))),
        lambda t: t["total"] / F.nullif(t["count"], F.lit(0).cast("bigint")))
    means = each.select(*group, "replicate", F.round(mean, MEAN_DIGITS).alias("mean"))
    obs = cells.groupBy(*group).agg(
        F.count_distinct(outer).alias("n_outer"), F.count_distinct(inner).alias("n_inner"),
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg(F.col("a") - F.col("b")).alias("difference"))
    boot = summarize(means, group).drop("dist_mean")
    return obs.join(boot, list(group))
