"""Vector expressions over array<double> columns: no Python on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values) -> Column:
    """A literal array<double>."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def total(x: Column) -> Column:
    """Sum, left to right."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def least(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.least(a, b))


def l1(x: Column) -> Column:
    return total(F.transform(x, F.abs))


def gap2(x: Column, y: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def product(x: Column) -> Column:
    return F.aggregate(x, F.lit(1.0), lambda a, v: a * v)


def mix(x: Column, w: Column, beta: float) -> Column:
    return F.zip_with(x, w, lambda a, b: F.lit(beta) * a + F.lit(1 - beta) * b)


def head(w: Column, d: int) -> Column:
    return F.slice(w, 1, d)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def concat(*parts: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)
