"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words. A randomised
SVD finds the main directions of that matrix: every task multiplies its
passages with a sparse random sign matrix from the left, the sums (a fixed size,
whatever the corpus) are added up, and the right singular vectors of the result
span the latent space, in which a hit is scored by cosine. Candidates are the
sliding windows with enough words of an item for any check to pass: they are
counted for all windows and items, so no bound on the cosine can lose one. They
are then checked word by word with the longest common subsequence, and the
item's answer separately. Where the words of an item are there in another order,
the cosine decides: common words alone do not lift it, those that tell the
item from other texts do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import byte_chunks, flat_bytes

FEATURES = 1 << 14
SKETCH = 64
SKETCH_ROWS = 4
COMMON = 8
STEP = 8
PASSAGE_STEPS = 6
MIN_COMMON = 0.8
MIN_COMMON_WITH_ANSWER = 0.6
# latent cosine from which an item's words count in any order
MIN_COSINE = 0.9
SHORT = 5
ITEM_BLOCK = 4096
BAG = 1 << 12
CHUNK_BYTES = 2 << 20
STEPS_AT_ONCE = 1 << 11
COUNTS_AT_ONCE = 1 << 21
CANDIDATES_AT_ONCE = 1 << 10
REDUCE = 64
BLOCK_ROWS = 512

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def _byte_classes() -> np.ndarray:
    """Lower-cased value of each byte that belongs to a word, 0 for all others.

    Words are ASCII letters and digits and all bytes of other characters.
    """
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b).isalnum() else 0
    return table


_CLASS = _byte_classes()


@dataclass
class Tokens:
    """Words of several texts: 64-bit hashes, the owner of each, first word of each text."""

    hashes: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    @property
    def features(self) -> np.ndarray:
        return (self.hashes >> np.uint64(50)).astype(np.int64)


def tokens(column: pa.Array) -> Tokens:
    """Hash every word of an array of texts, eight bytes of all words at a time."""
    raw, offsets = flat_bytes(column)
    n_texts, n = len(offsets) - 1, len(raw)
    value = np.zeros(n + 8, dtype=np.uint8)
    value[:n] = _CLASS[raw]
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = value[:n] > 0
    begin = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    begin[offsets] = inside[1:][offsets]  # a text ends what comes before it
    end[offsets] = inside[:-1][offsets]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=value.data, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64)
    at, rest, who = starts, left, None
    while len(at):
        piece = eight[at] & _MASKS[np.minimum(rest, 8)]
        if who is None:
            h = (h ^ piece) * _PRIME
            h ^= h >> np.uint64(29)
        else:
            mixed = (h[who] ^ piece) * _PRIME
            h[who] = mixed ^ (mixed >> np.uint64(29))
        more = np.flatnonzero(rest > 8)
        who = more if who is None else who[more]
        at, rest = at[more] + 8, rest[more] - 8
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= _PRIME
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return Tokens(h, owner, np.searchsorted(owner, np.arange(n_texts + 1)))


def text_tokens(text: str | None) -> np.ndarray:
    return tokens(pa.array([text or ""])).hashes


def steps_of(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step of each word, text of each step, first step of each text); steps are STEP words."""
    counts = np.diff(t.first)
    n_steps = -(-counts // STEP)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_steps)])
    step = first[t.owner] + (np.arange(len(t.owner)) - t.first[t.owner]) // STEP
    return step, np.repeat(np.arange(len(counts)), n_steps), first


# ------------------------------------------------------------------ the latent space

def passages_of(t: Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage of each word, first step of each passage, number of passages)."""
    step, text_of, first = steps_of(t)
    in_text = np.arange(len(text_of)) - first[text_of]
    starts = np.flatnonzero(in_text % PASSAGE_STEPS == 0)
    of_step = np.cumsum(in_text % PASSAGE_STEPS == 0) - 1
    return of_step[step], starts, len(starts)


def _corpus_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: (row block, passages, [document frequency, term frequency, sketch...])."""
    sums = np.zeros((SKETCH + 2, FEATURES), dtype=np.float64)
    passages = 0
    for batch in batches:
        column = batch.column(0)
        for start, stop in byte_chunks(column, CHUNK_BYTES):
            t = tokens(column.slice(start, stop - start))
            if not len(t.hashes):
                continue
            passage, _, n = passages_of(t)
            feats = t.features
            # a passage goes to a few rows of the sketch with a random sign; both follow
            # from its words, so that a retried task repeats them
            seed = np.add.reduceat(t.hashes, np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]))
            cell = np.sort(feats * n + passage)
            new_cell = np.r_[True, cell[1:] != cell[:-1]]
            sums[0] += np.bincount(cell[new_cell] // n, minlength=FEATURES)
            sums[1] += np.bincount(feats, minlength=FEATURES)
            for _ in range(SKETCH_ROWS):
                seed = (seed ^ (seed >> np.uint64(31))) * _PRIME
                seed ^= seed >> np.uint64(29)
                row = (seed >> np.uint64(40)).astype(np.int64) % SKETCH * FEATURES
                sign = 1.0 - 2.0 * (seed >> np.uint64(63)).astype(np.float64)
                sums[2:] += np.bincount(np.take(row, passage) + feats, weights=np.take(sign, passage),
                                        minlength=SKETCH * FEATURES).reshape(SKETCH, FEATURES)
            passages += n
    if passages:
        yield packed(passages, sums.T)


def packed(n: int, sums: np.ndarray) -> pa.RecordBatch:
    """A matrix in blocks of rows, so that blocks can be added up in parallel."""
    ids = list(range(0, len(sums), BLOCK_ROWS))
    blocks = [np.ascontiguousarray(sums[i:i + BLOCK_ROWS], dtype=np.float32).tobytes() for i in ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array([n] * len(ids), pa.int64()), pa.array(blocks, pa.binary())],
        names=["block", "n", "sums"])


def _add_blocks(table: pa.Table) -> pa.Table:
    parts = table.column("sums")
    total = np.zeros(len(parts[0].as_buffer()) // 4, dtype=np.float64)
    for part in parts:
        total += np.frombuffer(part.as_buffer(), dtype=np.float32)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                     "n": pa.array([pc.sum(table.column("n")).as_py()], pa.int64()),
                     "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def summed(docs: DataFrame, text_col: str, task, width: int) -> tuple[int, np.ndarray]:
    """(n, matrix): the blocks that ``task`` makes of each partition, added up in two levels."""
    kind = "block int, n bigint, sums binary"
    parts = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(task, kind)
    part = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(REDUCE)))
    some = part.groupBy("block", "salt").applyInArrow(lambda table: _add_blocks(table), kind)
    rows = some.groupBy("block").applyInArrow(lambda table: _add_blocks(table), kind).collect()
    rows.sort(key=lambda r: r["block"])
    if not rows:
        return 0, np.zeros((0, width))
    return rows[0]["n"], np.concatenate([np.frombuffer(r["sums"], np.float32) for r in rows]).reshape(
        -1, width).astype(np.float64)


@dataclass
class LatentSpace:
    """basis: (features, rank), with idf, centring and scaling in it."""

    basis: np.ndarray

    def project(self, feats: np.ndarray) -> np.ndarray:
        return self.basis[feats]


def _corpus_gram(space: LatentSpace):
    """Second moments of the projected passages of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = space.basis.shape[1]
        gram, n = np.zeros((rank, rank)), 0
        for batch in batches:
            column = batch.column(0)
            for start, stop in byte_chunks(column, CHUNK_BYTES):
                t = tokens(column.slice(start, stop - start))
                if len(t.hashes):
                    z = np.add.reduceat(step_vectors(t, steps_of(t)[0], space), passages_of(t)[1], axis=0)
                    gram += z.T @ z
                    n += len(z)
        if n:
            yield packed(n, gram)

    return run


def fit_space(docs: DataFrame, text_col: str = "text") -> LatentSpace | None:
    """Randomised SVD of the TF-IDF passages of all documents; None without words.

    The first pass multiplies the matrix with random signs from the left; an
    orthonormal basis of the result spans the main right singular directions. The
    second pass takes the second moments of the passages in that basis, whose
    eigenvectors are the singular vectors and whose eigenvalues scale them. The
    first ``COMMON`` directions, shared by most texts, are left out. The driver
    gets FEATURES x (SKETCH + 2) numbers, whatever the corpus.
    """
    n, sums = summed(docs, text_col, _corpus_sketch, SKETCH + 2)
    if not n:
        return None
    df, tf, sketch = sums[:, 0], sums[:, 1], sums[:, 2:]
    idf = np.log((n + 1) / (df + 1)) + 1
    a = sketch * idf[:, None]  # random sums of TF-IDF passages, one per column
    values, right = np.linalg.eigh(a.T @ a)
    order = np.argsort(values)[::-1]
    order = order[values[order] > max(values.max(), 1e-12) * 1e-9]
    order = order[COMMON:] if len(order) > 2 * COMMON else order
    basis = (a @ (right[:, order] / np.sqrt(values[order]))) * idf[:, None]
    basis -= tf @ basis / max(tf.sum(), 1)
    basis /= max(np.abs(basis).max(), 1e-12)
    plain = LatentSpace(basis.astype(np.float32))
    n, gram = summed(docs, text_col, _corpus_gram(plain), basis.shape[1])
    values, vectors = np.linalg.eigh(gram / n)
    keep = values > values.max() * 1e-6
    scaled = basis @ (vectors[:, keep] / np.sqrt(values[keep]))
    return LatentSpace(scaled.astype(np.float32))


# ------------------------------------------------------------------ the items

@dataclass
class Items:
    """Benchmark items of one block: words, answer words, unit vectors, window length in steps."""

    ids: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray
    steps: np.ndarray
    bags: np.ndarray  # (items, BAG): which hashed words an item has

    def candidates(self, chosen: np.ndarray, place: np.ndarray, last: np.ndarray,
                   length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(step, item) of the windows that hold enough words of the ``chosen`` items for any check to pass.

        ``place``: hashed words, one column per step; ``last``: the step after each window.
        """
        table = np.zeros((BAG + 1, len(chosen)), dtype=np.uint8)  # the last row stands for no word
        table[:BAG] = self.bags[chosen].T
        need = self.least_words[chosen]
        rows = max(length, COUNTS_AT_ONCE // len(chosen))
        for i in range(0, len(last), rows):
            part = place[:, i:i + rows + length]
            counts = np.take(table, part[0], axis=0)
            for j in range(1, STEP):
                counts += np.take(table, part[j], axis=0)
            upto = np.zeros((len(counts) + 1, len(chosen)), dtype=np.int32)
            np.cumsum(counts, axis=0, out=upto[1:])
            ends = last[i:i + rows] - i
            at, col = np.nonzero(upto[ends] - upto[:len(ends)] >= need)
            yield at + i, chosen[col]

    def enough(self, item: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray,
               width: int) -> np.ndarray:
        """Whether enough words of each item are in its window, every word of the item counted."""
        out = np.zeros(len(item), dtype=bool)
        for which in np.unique(item).tolist():
            words, mine = self.words[which], np.flatnonzero(item == which)
            for i in range(0, len(mine), CANDIDATES_AT_ONCE):
                rows = mine[i:i + CANDIDATES_AT_ONCE]
                at = begin[rows, None] + np.arange(width)
                window = hashes[np.minimum(at, end[rows, None] - 1)]
                found = np.zeros(len(rows), dtype=np.int64)
                for w, times in zip(*np.unique(words, return_counts=True)):
                    found += np.where((window == w).any(axis=1), times, 0)
                out[rows] = found >= self.least_words[which]
        return out

    @property
    def least_words(self) -> np.ndarray:
        """Words of each item that a window must hold: all of a short one, else the lowest accepted share."""
        n = self.lengths
        return np.where(n < SHORT, n, np.ceil(MIN_COMMON_WITH_ANSWER * n - 1e-9).astype(np.int64))

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(w) for w in self.words])


def answer_of(text: str) -> str:
    """The last sentence of an item, where it has no answer of its own."""
    parts = [p for p in text.replace("\n", ". ").replace("?", ".").split(". ") if p.strip(" .")]
    return parts[-1] if parts else ""


def item_blocks(items: DataFrame, space: LatentSpace, id_col: str = "item_id", text_col: str = "text",
                answer_col: str | None = None) -> Iterator[Items]:
    """Blocks of ``ITEM_BLOCK`` items by id, each small enough to send to every task."""
    columns = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
               (F.col(f"`{answer_col}`") if answer_col else F.lit(None).cast("string")).alias("answer")]
    rows = items.select(*columns).filter("text IS NOT NULL AND id IS NOT NULL").distinct().orderBy("id", "text")
    block: list = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == ITEM_BLOCK:
            yield make_items(block, space)
            block = []
    if block:
        yield make_items(block, space)


def make_items(rows: list, space: LatentSpace) -> Items:
    words = [text_tokens(r["text"]) for r in rows]
    keep = [i for i, w in enumerate(words) if len(w)]
    vectors = np.zeros((len(keep), space.basis.shape[1]), np.float32)
    for at, i in enumerate(keep):
        v = space.project((words[i] >> np.uint64(50)).astype(np.int64)).sum(axis=0)
        vectors[at] = v / max(float(np.linalg.norm(v)), 1e-12)
    answers = [text_tokens(rows[i]["answer"] if rows[i]["answer"] is not None else answer_of(rows[i]["text"]))
               for i in keep]
    words = [words[i] for i in keep]
    steps = np.array([-(-(len(w) + STEP - 1) // STEP) for w in words], dtype=np.int64)
    bags = np.zeros((len(keep), BAG), dtype=bool)
    for i, w in enumerate(words):
        bags[i, (w & np.uint64(BAG - 1)).astype(np.int64)] = True
    return Items(np.array([rows[i]["id"] for i in keep], dtype=np.int64), words, answers, vectors, steps, bags)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def check_item(item: np.ndarray, answer: np.ndarray, window: np.ndarray) -> tuple[float, bool]:
    """(share of the item's words in order, the answer's words all there in order).

    The words in common bound the subsequence from above and are counted first.
    """
    words, inside = item.tolist(), set(window.tolist())
    if sum(w in inside for w in words) < MIN_COMMON_WITH_ANSWER * len(words):
        return 0.0, False
    share = common_subsequence(item, window) / len(item)
    found = len(answer) > 0 and common_subsequence(answer, window) == len(answer)
    return share, found


def is_reordered(item: np.ndarray, window: np.ndarray, cosine: float) -> bool:
    """Whether ``MIN_COMMON`` of the item's words are in the window, in any order, each as often
    as it is used, and the window is near the item in the latent space."""
    if len(item) < SHORT or cosine < MIN_COSINE:
        return False
    words, times = np.unique(item, return_counts=True)
    held, found = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(held, words), len(held) - 1)
    return int(np.minimum(times, np.where(held[at] == words, found[at], 0)).sum()) >= MIN_COMMON * len(item)


def is_leak(item: np.ndarray, share: float, answered: bool) -> bool:
    if len(item) < SHORT:
        return share == 1.0 and answered
    return share >= MIN_COMMON or (answered and share >= MIN_COMMON_WITH_ANSWER)


HIT = "array<struct<item_id: bigint, share: double, cosine: double, word: int>>"


def hits_column(space: LatentSpace, items: Items, text: Column) -> Column:
    """For each text the items found in it: best share, its cosine and first word."""
    spark_type = HIT

    @F.arrow_udf(spark_type)
    def search(column: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for start, stop in byte_chunks(column, CHUNK_BYTES):
            for text_at, hits in find(column.slice(start, stop - start), space, items).items():
                out[start + text_at] = [
                    {"item_id": i, "share": s, "cosine": c, "word": w} for i, (s, c, w) in sorted(hits.items())]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64()),
                                   ("word", pa.int32())]))
        return pa.array(out, kind)

    return search(text)


def step_vectors(t: Tokens, step: np.ndarray, space: LatentSpace) -> np.ndarray:
    """Sums of the projected words of each step; short last steps are filled with a zero row."""
    rank = space.basis.shape[1]
    table = np.vstack([space.basis, np.zeros((1, rank), np.float32)])
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    words = np.full((STEP, len(starts)), FEATURES, dtype=np.int64)
    words[np.arange(len(step)) - starts[step], step] = t.features
    out = np.take(table, words[0], axis=0)
    row = np.empty((STEPS_AT_ONCE, rank), np.float32)
    for i in range(0, len(starts), STEPS_AT_ONCE):
        part = out[i:i + STEPS_AT_ONCE]
        for j in range(1, STEP):
            part += np.take(table, words[j, i:i + STEPS_AT_ONCE], axis=0, out=row[:len(part)], mode="clip")
    return out


def cosine_of(words: np.ndarray, vector: np.ndarray, space: LatentSpace) -> float:
    v = space.project((words >> np.uint64(50)).astype(np.int64)).sum(axis=0)
    return float(v @ vector) / max(float(np.linalg.norm(v)), 1e-9)


def find(column: pa.Array, space: LatentSpace, items: Items) -> dict[int, dict[int, tuple[float, float, int]]]:
    """{text: {item id: (share, cosine, first word)}} of the leaks in an array of texts."""
    t = tokens(column)
    found: dict[int, dict[int, tuple[float, float, int]]] = {}
    if not len(t.hashes) or not len(items.ids):
        return found
    step, text_of, first = steps_of(t)
    n_steps = len(text_of)
    place = np.full((STEP, n_steps), BAG, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    place[np.arange(len(step)) - starts[step], step] = (t.hashes & np.uint64(BAG - 1)).astype(np.int64)
    for length in np.unique(items.steps).tolist():
        chosen = np.flatnonzero(items.steps == length)
        last = np.minimum(np.arange(n_steps) + length, first[1:][text_of])
        for at, item in items.candidates(chosen, place, last, length):
            text = text_of[at]
            begin = t.first[text] + (at - first[text]) * STEP
            end = np.minimum(begin + length * STEP, t.first[text + 1])
            for k in np.flatnonzero(items.enough(item, t.hashes, begin, end, length * STEP)).tolist():
                which, window_words = item[k], t.hashes[begin[k]:end[k]]
                share, answered = check_item(items.words[which], items.answers[which], window_words)
                cosine = cosine_of(window_words, items.vectors[which], space)
                if is_leak(items.words[which], share, answered) or is_reordered(items.words[which], window_words, cosine):
                    mine = found.setdefault(int(text[k]), {})
                    key = int(items.ids[which])
                    hit = (share, cosine, int(begin[k] - t.first[text[k]]))
                    if key not in mine or (hit[0], -hit[2]) > (mine[key][0], -mine[key][2]):
                        mine[key] = hit
    return found


class Decontaminator:
    """A latent space of the documents and the benchmark items in it."""

    def __init__(self, docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", answer_col: str | None = None):
        self.space = fit_space(docs, text_col)
        self.blocks = [] if self.space is None else list(
            item_blocks(items, self.space, item_id_col, item_text_col, answer_col))

    def hits(self, text: Column) -> Column:
        """All items found in a text, over every block of items."""
        if not self.blocks:
            return F.array().cast(HIT)
        found = [hits_column(self.space, block, text) for block in self.blocks]
        return F.concat(*found) if len(found) > 1 else found[0]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, share, cosine, word): benchmark items found in documents.

    An item is found wherever a window of its length holds at least ``MIN_COMMON`` of
    its words in order, or ``MIN_COMMON_WITH_ANSWER`` and its whole answer, or
    ``MIN_COMMON`` in any order at a latent cosine of ``MIN_COSINE``; items
    under ``SHORT`` words must be there in full. ``word`` is the first word of the
    best window (the first one of equals). Null and empty texts hold nothing, items
    without words or id are never found. Repeated rows give repeated results.
    Other columns are not read. Empty tables give an empty result.
    """
    model = Decontaminator(docs, items, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.explode(model.hits(F.col(f"`{text_col}`"))).alias("h"))
    return rows.select("doc_id", "h.item_id", F.round("h.share", 6).alias("share"),
                       F.round("h.cosine", 6).alias("cosine"), "h.word")
