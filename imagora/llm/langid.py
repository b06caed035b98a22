"""Language identification by a convolutional network over bytes.

Filters of several widths slide over one-hot bytes of a window, the largest
response of each filter is kept, and a softmax layer reads them. A text is cut
into windows of fixed length and gets the mean of its windows, weighted by their
bytes. Training is plain numpy on a bounded sample; prediction runs in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import byte_chunks, flat_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
FOLDS = 5
#: Training rows: all rows of a language up to about this many, else a hash sample of them.
SAMPLE_PER_LANG = 1500
SAMPLE_WINDOWS = 4
EPOCHS = 6
BATCH = 64
RATE = 0.01
CHUNK_BYTES = 2 << 20
WINDOWS_AT_ONCE = 128
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of ``FOLDS``; a null id is not."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % FOLDS == 0, F.lit(False))


@dataclass
class ByteCnn:
    """tables[width]: (width, 256, FILTERS) responses; then (filters, languages)."""

    langs: list[str]
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def responses(self, windows: np.ndarray, width: int) -> np.ndarray:
        n = windows.shape[1] - width + 1
        acc = self.tables[width][0][windows[:, :n]]
        for j in range(1, width):
            acc = acc + self.tables[width][j][windows[:, j:j + n]]
        return acc

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages) for (windows, WINDOW) bytes."""
        hidden = np.concatenate([self.fast_max(windows, w) for w in WIDTHS], axis=1) + self.bias
        return softmax(np.maximum(hidden, 0) @ self.out + self.out_bias)

    def fast_max(self, windows: np.ndarray, width: int) -> np.ndarray:
        """Largest response per filter; two neighbouring bytes are one table lookup."""
        n = windows.shape[1] - width + 1
        wide = windows.astype(np.intp)
        acc = None
        for j in range(0, width - 1, 2):
            at = wide[:, j:j + n] * 256 + wide[:, j + 1:j + 1 + n]
            part = np.take(self.pairs(width, j), at, axis=0)
            acc = part if acc is None else np.add(acc, part, out=acc)
        if width % 2:
            acc = np.add(acc, np.take(self.tables[width][width - 1], wide[:, width - 1:width - 1 + n], axis=0), out=acc)
        return acc.max(axis=1)

    def pairs(self, width: int, j: int) -> np.ndarray:
        cache = self.__dict__.setdefault("_pairs", {})
        if (width, j) not in cache:
            a, b = self.tables[width][j], self.tables[width][j + 1]
            cache[width, j] = (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        return cache[width, j]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pad(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros((len(pieces), WINDOW), dtype=np.uint8)
    for i, p in enumerate(pieces):
        out[i, :len(p)] = np.frombuffer(p[:WINDOW], dtype=np.uint8)
    return out


def train(pieces: list[bytes], labels: list[str], seed: int = 7, epochs: int = EPOCHS) -> ByteCnn:
    """Fit the network to labelled windows by Adam on the cross entropy."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = ByteCnn(langs, {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS})
    total = FILTERS * len(WIDTHS)
    model.bias = np.zeros(total, np.float32)
    model.out = rng.normal(0, 0.2, (total, len(langs))).astype(np.float32)
    model.out_bias = np.zeros(len(langs), np.float32)
    if len(langs) < 2:
        return model
    x, y = pad(pieces), np.searchsorted(langs, labels)
    params = [*model.tables.values(), model.bias, model.out, model.out_bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            at = order[i:i + BATCH]
            grads = gradients(model, x[at], y[at])
            step += 1
            rate = RATE * (0.3 if epoch >= epochs - 2 else 1.0)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def gradients(model: ByteCnn, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
    where, tops = {}, []
    for w in WIDTHS:
        r = model.responses(x, w)
        where[w] = r.argmax(axis=1)
        tops.append(r.max(axis=1))
    hidden = np.maximum(np.concatenate(tops, axis=1) + model.bias, 0)
    d = softmax(hidden @ model.out + model.out_bias)
    d[np.arange(len(x)), y] -= 1
    d /= len(x)
    back = (d @ model.out.T) * (hidden > 0)
    grads = []
    for k, w in enumerate(WIDTHS):
        g = np.zeros_like(model.tables[w])
        part = back[:, k * FILTERS:(k + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (x[rows, where[w] + j], cols), part)
        grads.append(g)
    return [*grads, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = SAMPLE_PER_LANG) -> ByteCnn:
    """Train on a bounded hash sample of the labelled rows that are not held out.

    About ``per_lang`` rows of each language, ``SAMPLE_WINDOWS`` windows of each.
    """
    doc, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    usable = docs.filter(doc.isNotNull() & text.isNotNull() & lang.isNotNull() & ~held_out(doc))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ByteCnn([])
    place = F.pmod(F.xxhash64(doc, F.lit("train")), F.lit(1 << 20))
    limit = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (
        k, min(1 << 20, int(per_lang * (1 << 20) / n) + 1))]), lang)
    raw = text.cast("binary")
    size = F.octet_length(raw)
    # windows at hashed places; some are cut short, as short texts are
    windows = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(
        raw, (F.pmod(F.xxhash64(doc, i), F.greatest(size - F.lit(WINDOW) + 1, F.lit(1))) + 1).cast("int"),
        F.when(i == 0, F.pmod(F.xxhash64(doc, F.lit("cut")), F.lit(WINDOW)) + 1).otherwise(F.lit(WINDOW)).cast("int")))
    rows = usable.filter((place < limit) & (size > 0)).select(
        place.alias("place"), doc.cast("string").alias("doc"), lang.alias("lang"), windows.alias("w"))
    sample = rows.limit(2 * per_lang * len(counts) + 1000).collect()
    sample.sort(key=lambda r: (r["place"], r["doc"], r["lang"], bytes(r["w"][0])))
    pieces = [bytes(w) for r in sample for w in r["w"]]
    return train(pieces, [r["lang"] for r in sample for _ in r["w"]])


def predict_column(model: ByteCnn, text: Column) -> Column:
    """(lang, score) of each whole text; ``und`` with score 0 without a letter."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(column: pa.Array, letters: pa.Array) -> pa.Array:
        known = letters.to_pylist()
        langs, scores = [UNKNOWN] * len(column), [0.0] * len(column)
        for start, stop in byte_chunks(column, CHUNK_BYTES) if model.langs else ():
            probs = text_probabilities(model, column.slice(start, stop - start))
            best = probs.argmax(axis=1)
            for i in range(start, stop):
                if known[i]:
                    langs[i], scores[i] = model.langs[best[i - start]], float(probs[i - start, best[i - start]])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          names=["lang", "score"])

    return predict(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def text_probabilities(model: ByteCnn, column: pa.Array) -> np.ndarray:
    """(texts, languages): mean over the windows of each text, weighted by bytes."""
    raw, offsets = flat_bytes(column)
    sizes = np.diff(offsets)
    n_windows = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(sizes)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    length = np.minimum(WINDOW, offsets[1:][owner] - start)
    padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    sums = np.zeros((len(sizes), len(model.langs)))
    for i in range(0, len(owner), WINDOWS_AT_ONCE):
        part = slice(i, i + WINDOWS_AT_ONCE)
        windows = views[start[part]]
        windows[np.arange(WINDOW)[None, :] >= length[part][:, None]] = 0
        probs = model.probabilities(windows) * np.maximum(length[part], 1)[:, None]
        np.add.at(sums, owner[part], probs)
    return sums / sums.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    The language is one that training saw; a null text or one without a letter,
    and every text when nothing could be learned, is ``und`` with score 0. Equal
    scores go to the first language by code point. Repeated rows get equal
    results. A null id is neither held out nor trained on. Other columns are not
    read. An empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col)
    doc = F.col(f"`{id_col}`")
    rows = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"),
                       predict_column(model, F.col(f"`{text_col}`")).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")
