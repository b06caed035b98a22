"""Spelling variants: words one edit apart, by dense tiles of code points.

Two words of at most L code points, one edit apart, share their first L // 2
code points or all the others but one: the rest of the longer word behind the
edit. Words therefore meet in groups of one length L (with words of L - 1) and
one shared part. A group is a run of rows in a sorted partition; blocks of its
rows become padded matrices, and block pairs are compared at once: common
prefix plus common suffix of L - 1 or more is one edit.

A group of more than ``SPLIT`` words is not compared but split by the same
rule at the half of what it does not share, again and again; at one open place
it cannot hold more words than there are letters. A pair is counted in the one
group to which its common prefix leads, so groups need no exchange of pairs:
each sends a count and its best partner per word.

Defined results: a null id is an empty string in the hash, a null text holds
no words; repeated rows count again; an empty table has no words. Texts and
words of any length are taken whole. Of partners with the same count the first
in code-point order is the form. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import LOWER, UPPER, small, stage

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS = 6
MIN_COUNT = 5
DROP_ONE_IN = 199
FORM_FACTOR = 5
#: Words a group may hold before it is split, and code points.
SPLIT = 2048
SPLIT_CHARS = 1 << 22
#: Rows and cells of a block.
BLOCK = 256
BLOCK_CHARS = 1 << 20

_GROUP = ["size", "head", "tail", "below", "key"]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
          min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): letter runs of all texts, one in ``drop_one_in`` (by id and run) short of a letter."""
    low = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    # no run grows, so short ones can go first
    long_runs = runs.filter(F.char_length("run") >= min_chars)
    hashed = long_runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + F.lit(2), F.char_length("run")))
    return hashed.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run")).alias("word")).filter(
        F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _group(size: Column, head: Column, tail: Column, below: Column) -> Column:
    """The group of words of ``size`` or one less that share ``head`` and ``tail`` code points.

    A pair belongs to it if its common prefix is less than ``below``.
    """
    key = F.concat(F.substring("word", F.lit(1), head), F.right(F.col("word"), tail))
    return F.struct(size.alias("size"), head.alias("head"), tail.alias("tail"), below.alias("below"), key.alias("key"))


def _halves(size: Column, head: Column, tail: Column, below: Column) -> list[Column]:
    """The two groups whose pairs are those of (size, head, tail, below)."""
    middle = head + F.floor((size - head - tail) / F.lit(2)).cast("int")
    return [_group(size, middle, tail, below), _group(size, head, size - middle, F.least(below, middle))]


def first_groups(vocabulary: DataFrame) -> DataFrame:
    """(size, head, tail, below, key, word, n): every word in the two halves of its size and of the next."""
    size = F.char_length("word")
    own = [g for longer in (size, size + F.lit(1)) for g in _halves(longer, F.lit(0), F.lit(0), longer)]
    return vocabulary.select("word", "n", F.explode(F.array(*own)).alias("g")).select("g.*", "word", "n")


def _split(grouped: DataFrame, most: int, most_chars: int) -> list[DataFrame]:
    """Groups that are small enough, level by level."""
    done = []
    while True:
        open_places = F.col("size") - F.col("head") - F.col("tail")
        hot = stage(grouped.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("members")).filter(
            ((F.col("members") > most) | (F.col("members") * F.col("size") > most_chars)) & (open_places > 1)
        ).drop("members"), "spelling-hot")
        if hot.isEmpty():
            return [*done, grouped]
        hot = small(hot)
        done.append(grouped.join(hot, _GROUP, "left_anti").select(*_GROUP, "word", "n"))
        parts = _halves(*[F.col(c) for c in _GROUP[:4]])
        grouped = stage(grouped.join(hot, _GROUP, "left_semi").select(
            "word", "n", F.explode(F.array(*parts)).alias("g")).select("g.*", "word", "n"), "spelling-halves")


def _matrix(block: list[str], width: int, left: bool) -> np.ndarray:
    padded = "".join(w.ljust(width, "\0") if left else w.rjust(width, "\0") for w in block)
    cells = np.frombuffer(padded.encode("utf-32-le"), dtype="<u4").reshape(len(block), width)
    return np.ascontiguousarray(cells.astype(np.uint8 if cells.size and cells.max() < 256 else np.uint32).T)


def _common(a: np.ndarray, b: np.ndarray, order: range) -> np.ndarray:
    """Equal leading places of each row of one block with each row of another."""
    alive = np.ones((a.shape[1], b.shape[1]), dtype=bool)
    total = np.zeros(alive.shape, dtype=np.int32)
    for place in order:
        alive &= a[place][:, None] == b[place][None, :]
        if not alive.any():
            break
        total += alive
    return total


def near_pairs(rows: list[str], group: np.ndarray, below: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows one edit apart, of words of one ``size`` or one less, sorted by group."""
    step = max(1, min(BLOCK, BLOCK_CHARS // max(size, 1)))
    longest = np.array([len(w) == size for w in rows])
    starts = range(0, len(rows), step)
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(at: int) -> tuple[np.ndarray, np.ndarray]:
        if at not in made:
            part = rows[at:at + step]
            made[at] = _matrix(part, size, True), _matrix(part, size, False)
        return made[at]

    for i in starts:
        last = group[min(i + step, len(rows)) - 1]
        for j in starts[i // step:]:
            if group[j] != last and j != i:
                break
            (head_a, tail_a), (head_b, tail_b) = block(i), block(j)
            prefix = _common(head_a, head_b, range(size))
            suffix = _common(tail_a, tail_b, range(size - 1, -1, -1))
            one = slice(i, i + step)
            other = slice(j, j + step)
            near = (prefix + suffix >= size - 1) & (group[one][:, None] == group[other][None, :]) & (
                prefix < below[one][:, None]) & (longest[one][:, None] | longest[other][None, :])
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                yield x + i, y + j
        made.pop(i, None)


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _partners(rows: list[str], counts: np.ndarray, group: np.ndarray, below: np.ndarray, size: int) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the rows that have a partner."""
    n_near = np.zeros(len(rows), dtype=np.int64)
    best = np.full(len(rows), -1, dtype=np.int64)
    # rank 0 is the best partner of all: largest count, then first in order
    rank = np.empty(len(rows), dtype=np.int64)
    rank[sorted(range(len(rows)), key=lambda k: (-counts[k], rows[k]))] = np.arange(len(rows))
    at_rank = np.argsort(rank)
    low = np.full(len(rows), len(rows), dtype=np.int64)
    for x, y in near_pairs(rows, group, below, size):
        for a, b in ((x, y), (y, x)):
            np.add.at(n_near, a, 1)
            np.minimum.at(low, a, rank[b])
    have = np.nonzero(n_near)[0]
    best = at_rank[low[have]]
    return pa.record_batch([pa.array([rows[k] for k in have], pa.string()), pa.array(n_near[have]),
                            pa.array(counts[best]), pa.array([rows[k] for k in best], pa.string())], schema=_FOUND)


def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partners within each group of a sorted stream; a group may go over batches."""
    held: list[tuple] = []
    rows: list[str] = []
    counts: list[int] = []
    group: list[int] = []
    below: list[int] = []
    size = -1
    number = 0
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            yield _partners(rows, np.array(counts, dtype=np.int64), np.array(group), np.array(below), size)
        rows.clear(), counts.clear(), group.clear(), below.clear()

    for batch in batches:
        held = list(zip(*[batch.column(c).to_pylist() for c in (*_GROUP, "word", "n")]))
        for *key, word, n in held:
            if key != last:
                if key[0] != size or len(rows) >= 2 * SPLIT or len(rows) * key[0] >= SPLIT_CHARS:
                    yield from flush()
                size, last, number = key[0], key, number + 1
            rows.append(word), counts.append(n), group.append(number), below.append(key[3])
    yield from flush()


def neighbours(vocabulary: DataFrame, split: int = SPLIT, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """(word, n_near, best_n, best): words with a partner one edit apart, and the partner of largest count."""
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for grouped in _split(first_groups(vocabulary), split, split_chars):
        dealt = grouped.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)
        found.append(dealt.mapInArrow(tile, "word string, n_near bigint, best_n bigint, best string"))
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    return total.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) out of (word, form): the end of each chain of forms, by pointer doubling.

    A form's count is a multiple of its word's, so chains are short and have no cycle.
    """
    tops = stage(forms.select("word", F.col("form").alias("root")), "spelling-tops")
    while True:
        up = tops.select(F.col("word").alias("root"), F.col("root").alias("up"))
        jumped = stage(tops.join(up, "root", "left").select(
            "word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "spelling-tops")
        tops = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return tops


def variants(vocabulary: DataFrame, factor: int = FORM_FACTOR, split: int = SPLIT, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    near = neighbours(vocabulary, split, split_chars)
    clear = F.col("best_n") >= F.lit(factor) * F.col("n")
    told = stage(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of all texts."""
    return variants(stage(words(docs, id_col, text_col), "spelling-words"))
