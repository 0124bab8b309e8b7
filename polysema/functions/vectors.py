"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = length(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = length(a) * length(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def quantise(weight: Column) -> Column:
    """floor(10000 w) in the range of a 16-bit number."""
    q = F.floor(weight * 10000).cast("int")
    return F.when(q.between(-32768, 32767), q)


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mixed(sense: Column, word: Column, share: float = 0.5) -> Column:
    """share * sense + (1 - share) * word; where one is missing the other."""
    both = F.zip_with(sense, word, lambda s, w: share * s + (1 - share) * w)
    return F.when(sense.isNull(), word).when(word.isNull(), sense).otherwise(both)


def weighted_sum(rows: Column) -> Column:
    """Sum of weight * v over array<struct<..., weight, v>> in its order (an order fixed by
    the caller gives the same last digits on every run)."""
    first = F.element_at(rows, 1)
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), scaled(first["v"], first["weight"]), lambda s, r: F.zip_with(s, r["v"], lambda a, x: a + r["weight"] * x))
