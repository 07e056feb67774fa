"""Preparation of rows: bounds, scaling, complement code, channels, binary codes, validation.

Bounds are one row of two arrays, found by one aggregation (partial sums before the
shuffle) and joined back by a broadcast of that row. Nulls are refused by validate();
elsewhere an array with a null gives nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoform.functions.vectors import total


def features(*columns: str | Column) -> Column:
    """array<double> of numeric columns."""
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def find_bounds(*batches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (d_min, d_max) over all batches."""
    rows = batches[0].select(*columns)
    for b in batches[1:]:
        rows = rows.unionByName(b.select(*columns))
    return rows.agg(F.array(*[F.min(F.col(c).cast("double")) for c in columns]).alias("d_min"), F.array(*[F.max(F.col(c).cast("double")) for c in columns]).alias("d_max"))


def scaled(v: Column, low: Column, high: Column) -> Column:
    """A number brought to [0, 1] by its bounds; 0 in a constant column. One scalar expression, which compiles."""
    return F.when(high == low, F.lit(0.0) + v * 0).otherwise((v - low) / (high - low))


def normalize(x: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); 0 in a constant column."""
    span = F.zip_with(low, high, lambda a, b: b - a)
    return F.zip_with(F.zip_with(x, low, lambda v, a: v - a), span, lambda v, s: F.when(s == 0, F.lit(0.0)).otherwise(v / F.when(s == 0, F.lit(1.0)).otherwise(s)))


def de_normalize(x: Column, low: Column, high: Column) -> Column:
    return F.zip_with(F.zip_with(x, F.zip_with(low, high, lambda a, b: b - a), lambda v, s: v * s), low, lambda v, a: v + a)


def complement_code(x: Column) -> Column:
    return F.concat(x, F.transform(x, lambda v: 1 - v))


def de_complement_code(w: Column) -> Column:
    """Midpoints of the boxes that complement-coded weights describe."""
    d = (F.size(w) / 2).cast("int")
    return F.zip_with(F.slice(w, F.lit(1), d), F.slice(w, d + 1, d), lambda a, b: (a + 1 - b) / 2)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.zip_with(F.zip_with(x, low, lambda v, a: F.greatest(v, a)), high, lambda v, b: F.least(v, b))


def binary(x: Column) -> Column:
    """Prepared values cut to 0/1: anything inside (0, 1) becomes 0."""
    return F.transform(x, lambda v: v.cast("int"))


def thermometer(x: Column, bits: int) -> Column:
    """Each scaled value as bits that are 1 below it; one bit is 1 above one half."""
    if bits == 1:
        return F.transform(x, lambda v: (v > 0.5).cast("int"))
    return F.flatten(F.transform(x, lambda v: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: (F.floor(v * bits) > i).cast("int"))))


def pack_bits(x: Column) -> Column:
    """An array of 0/1 numbers as an array of longs, 64 bits in each, the first number in the lowest bit."""
    words = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 64).cast("int"))
    word = lambda k: F.aggregate(F.sequence(k * 64, F.least(k * 64 + 63, F.size(x) - 1)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(F.get(x, i) != 0, F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))))
    return F.when(F.size(x) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def overlap(a: Column, b: Column) -> Column:
    """Bits that two packed arrays share."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseAND(v))), F.lit(0), lambda s, n: s + n)


def positions(widths: Sequence[int]) -> list[tuple[int, int]]:
    """(start, end) of each channel in the joined row."""
    out, at = [], 0
    for w in widths:
        out.append((at, at + w))
        at += w
    return out


def join_channels(channels: Sequence[Column | None], widths: Sequence[int]) -> Column:
    """Channels side by side; a missing one is filled with 0.5, which is legal complement code."""
    return F.concat(*[F.array_repeat(F.lit(0.5), w) if c is None else c for c, w in zip(channels, widths, strict=True)])


def split_channels(joined: Column, widths: Sequence[int]) -> list[Column]:
    return [F.slice(joined, a + 1, b - a) for a, b in positions(widths)]


def prepare(rows: DataFrame, columns: Sequence[str], complement: bool = False, bounds: DataFrame | None = None, out: str = "x") -> DataFrame:
    """rows with a scaled (and complement-coded) array of their columns."""
    bounds = find_bounds(rows, columns=columns) if bounds is None else bounds
    x = [scaled(F.col(c).cast("double"), F.get("d_min", F.lit(i)), F.get("d_max", F.lit(i))) for i, c in enumerate(columns)]
    return rows.crossJoin(F.broadcast(bounds)).withColumn(out, F.array(*x, *[1 - v for v in x]) if complement else F.array(*x)).drop("d_min", "d_max")


def invalid(x: Column, kind: str = "unit", width: int | None = None) -> Column:
    """Whether a row breaks the rules of its kind: unit, fuzzy, binary or geo."""
    hole = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")))
    wrong = F.lit(False) if width is None else F.size(x) != width
    outside = F.exists(x, lambda v: (v < 0) | (v > 1))
    if kind == "fuzzy":
        rule = outside | (F.size(x) % 2 != 0) | (F.abs(total(x) - F.size(x) / 2) > 0.01)
    elif kind == "binary":
        rule = ~F.forall(x, lambda v: v.isin(0, 1))
    elif kind == "geo":
        rule = (F.size(x) != 2) | ~F.get(x, F.lit(0)).between(-90, 90) | ~F.get(x, F.lit(1)).between(-180, 180)
    else:
        rule = outside
    return F.coalesce(hole | wrong | rule, F.lit(True))


def validate(rows: DataFrame, column: str = "x", kind: str = "unit", width: int | None = None) -> None:
    """Raise if any row is invalid."""
    bad = rows.where(invalid(F.col(column), kind, width)).limit(1).count()
    if bad:
        raise ValueError(f"{column} has rows that are not valid {kind} input")
