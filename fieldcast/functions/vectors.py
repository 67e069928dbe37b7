"""Vectors and matrices held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def outer(a: Column, b: Column) -> Column:
    """The outer product, row by row."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def head(a: Column, n: int) -> Column:
    """The first n entries as doubles."""
    return F.transform(F.slice(a, 1, n), lambda x: x.cast("double"))
