"""Retrievers looked up by name, all with one signature.

A retriever is made by ``named(name, **options)``; its ``index(corpus)`` takes
(doc_id, text) and gives something whose ``topk(queries, k)`` takes
(instance_id, query) and returns (instance_id, doc_id, score, rank). Names that
others register are used the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagora.operators import block_index, dense, encode, fusion, lexical


class Index(Protocol):
    def topk(self, queries: DataFrame, k: int) -> DataFrame: ...


class Retriever(Protocol):
    def index(self, corpus: DataFrame) -> Index: ...


_FACTORIES: dict[str, Callable[..., Retriever]] = {}


def register(name: str):
    """Class or factory decorator; a name is given once."""
    def wrap(factory):
        if name in _FACTORIES:
            raise ValueError(f"a retriever named {name} is registered already")
        _FACTORIES[name] = factory
        return factory
    return wrap


def names() -> list[str]:
    return sorted(_FACTORIES)


def named(name: str, **options) -> Retriever:
    if name not in _FACTORIES:
        raise KeyError(f"no retriever named {name}; there are {', '.join(names())}")
    return _FACTORIES[name](**options)


@dataclass
class Search:
    """An index that is a function of queries and k."""

    run: Callable[[DataFrame, int], DataFrame]

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        return self.run(queries, k)


@register("bm25")
@dataclass
class Bm25:
    """BM25 by one scan of the texts, or over a stored block index of the same corpus."""

    stored: block_index.BlockIndex | None = None

    def index(self, corpus: DataFrame) -> Index:
        return self.stored or Search(lambda queries, k: lexical.bm25_topk(corpus, queries, k))


@register("dense")
@dataclass
class Dense:
    """Exact inner products of encoded texts; the queries are encoded as they are."""

    encoder: encode.Encoder | None = None

    def index(self, corpus: DataFrame) -> Index:
        def vectors(df: DataFrame, key: str, text: str) -> DataFrame:
            return df.select(key, F.lit("full").alias("field"), encode.encode_text(F.col(text), self.encoder).alias("vec"))

        library = vectors(corpus, "doc_id", "text")
        return Search(lambda queries, k: dense.search(
            library, vectors(queries, "instance_id", "query"), k, ("instance_id",)).drop("field"))


@register("hybrid")
@dataclass
class Hybrid:
    """Reciprocal rank fusion of registered retrievers, each to ``depth``."""

    of: tuple[Retriever, ...] = ()
    depth: int = fusion.PATH_DEPTH

    def index(self, corpus: DataFrame) -> Index:
        parts = [r.index(corpus) for r in self.of or (named("bm25"), named("dense"))]
        return Search(lambda queries, k: fusion.rrf(
            fusion.union_paths(*[p.topk(queries, max(k, self.depth)) for p in parts]), top_k=k))
