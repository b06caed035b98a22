"""Vector column expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Lambdas are evaluated per element; a bare outer expression inside one would
    be recomputed for each element of the array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scale(vec: Column, factor: Column) -> Column:
    return bind(factor, lambda f: F.transform(vec, lambda x: x * f))


def normalize(vec: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    def unit(v: Column) -> Column:
        n = norm(v)
        return bind(F.when(n == 0, F.lit(1.0)).otherwise(n),
                    lambda d: F.transform(v, lambda x: x / d))
    return bind(vec, unit)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of a non-empty, bounded ARRAY<ARRAY<DOUBLE>>."""
    def mean(vs: Column) -> Column:
        rest = F.slice(vs, F.lit(2), F.greatest(F.size(vs), F.lit(1)))
        total = F.aggregate(rest, F.get(vs, F.lit(0)), add)
        return scale(total, F.lit(1.0) / F.size(vs))
    return bind(vectors, mean)


def best_match(candidates: Column, references: Column) -> Column:
    """For every candidate vector its largest dot product with a reference.

    Works on two bounded arrays inside one row, so no pair rows are made.
    """
    return F.transform(
        candidates, lambda c: F.array_max(F.transform(references, lambda r: dot(c, r)))
    )
