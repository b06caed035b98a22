"""Text to vectors with an injectable batch encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.functions import text as tx
from imagora.functions import vector as vx

# texts arrive as token lists; the result has one row per text
Encoder = Callable[[Sequence[Sequence[str]]], np.ndarray]
HASH_DIM = 64
TOKENS_AT_ONCE = 1 << 20


class HashedEncoder:
    """Offline encoder: token counts in md5 buckets."""

    def __init__(self, dim: int = HASH_DIM):
        self.dim = dim

    def __call__(self, token_lists: Sequence[Sequence[str]]) -> np.ndarray:
        sizes = np.fromiter((len(t) for t in token_lists), dtype=np.int64, count=len(token_lists))
        flat = np.empty(int(sizes.sum()), dtype=object)
        flat[:] = list(chain.from_iterable(token_lists))
        codes, distinct = pd.factorize(flat)
        return self._counted(sizes, codes, distinct)

    def of_lists(self, lists: pa.Array) -> np.ndarray:
        """The same for an Arrow array of token lists: only distinct tokens become Python strings."""
        words = lists.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return self._counted(sizes, words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist())

    def _counted(self, sizes: np.ndarray, codes: np.ndarray, distinct: Sequence[str]) -> np.ndarray:
        buckets = np.fromiter((int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % self.dim for t in distinct),
                              dtype=np.int64, count=len(distinct))
        cells = np.repeat(np.arange(len(sizes)), sizes) * self.dim + buckets[codes]
        return np.bincount(cells, minlength=len(sizes) * self.dim).reshape(len(sizes), self.dim).astype(np.float64)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(matrix, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return matrix / n


def _slices(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """The token lists of a batch in runs of up to ``most`` tokens, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        done = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield lists.slice(at, upto - at)
        at = upto


def _words(lists: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_pandas().to_numpy(dtype=object), ends[:-1])


def encode_tokens(token_col: Column, encoder: Encoder | None = None) -> Column:
    """ARRAY<STRING> tokens -> unit ARRAY<DOUBLE>. Words become Python strings for a bounded
    number of tokens at a time, however long the texts of an Arrow batch are."""
    enc, most = encoder or HashedEncoder(), TOKENS_AT_ONCE
    of_lists = enc.of_lists if isinstance(enc, HashedEncoder) else lambda lists: enc(_words(lists))

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [_unit_rows(np.asarray(of_lists(part), dtype=np.float64)) for part in _slices(batch, most)]
            matrix = np.concatenate(rows) if rows else np.zeros((0, 1))
            offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))

    return run(token_col)


def encode_text(text: Column, encoder: Encoder | None = None) -> Column:
    return encode_tokens(tx.tokens(text), encoder)


def encode_lists(texts: Column, encoder: Encoder | None = None) -> Column:
    """ARRAY<STRING> of texts -> ARRAY<ARRAY<DOUBLE>>, for bounded arrays."""
    enc = encoder or HashedEncoder()

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            flat = [list(t) for row in batch for t in row]
            vecs = _unit_rows(np.asarray(enc(flat), dtype=np.float64)) if flat else np.zeros((0, 1))
            out, at = [], 0
            for row in batch:
                out.append([v.tolist() for v in vecs[at:at + len(row)]])
                at += len(row)
            yield pd.Series(out)

    return run(F.transform(texts, tx.tokens))


def missing_vectors(texts: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose content digest is not among the stored vectors yet."""
    return texts.withColumn("content_digest", F.sha2(F.col(text), 256)).join(
        stored.select("content_digest").distinct(), "content_digest", "left_anti")


def normalize_column(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, vx.normalize(vx.as_double(F.col(vec))))
