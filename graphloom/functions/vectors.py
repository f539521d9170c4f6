"""Vector algebra on array columns, all JVM-side higher-order functions in double precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-15


def vec(c: Column | str) -> Column:
    """An array column as array<double>."""
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Element-wise quotient; null where the divisor is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def shift(a: Column, k) -> Column:
    return F.transform(a, lambda x: x + k)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def l1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def squared_l2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def l2(a: Column) -> Column:
    return F.sqrt(squared_l2(a))


def l2_normalized(a: Column) -> Column:
    """a / |a|; null components for the zero vector."""
    return F.transform(a, lambda x: F.try_divide(x, l2(a)))


def swapped_pairs(a: Column) -> Column:
    """Components 2k and 2k+1 change places."""
    return F.transform(a, lambda x, i: F.element_at(a, (i.bitwiseXOR(F.lit(1)) + 1).cast("int")))


def every(a: Column, step: int, offset: int) -> Column:
    """Components offset, offset + step, offset + 2 * step ..."""
    return F.filter(a, lambda x, i: i % step == offset)


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)
