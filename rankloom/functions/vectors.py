"""Vector columns (arrays of numbers): products, norms, prefixes, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, floor: float | None = None) -> Column:
    """v over its norm. Without a floor, a zero or non-finite vector is an error for valid() to find; with one, zero stays zero."""
    n = norm(v) if floor is None else F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / n)


def prefix(v: Column, size: int, full: int) -> Column:
    """The first components, normalised again; the full size is left as it is."""
    return v if size >= full else unit(F.slice(v, 1, size))


def valid(v: Column, size: int, tolerance: float = 2e-3) -> Column:
    """Of the size, finite and of norm one."""
    good = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.abs(norm(v) - 1) <= tolerance), F.lit(False))


def positive_weights(v: Column) -> Column:
    """(token, weight) of positive components: sparse lexical weights."""
    return F.filter(F.transform(v, lambda x, i: F.struct(i.cast("int").alias("token"), x.alias("weight"))), lambda e: e["weight"] > 0)
