"""Column expressions on a closed axis of a given length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAP = 1e-9


def on_axis(value: Column, length: Column | float) -> Column:
    """Position in [0, length); within SNAP of the end counts as the start."""
    length = F.lit(length) if isinstance(length, (int, float)) else length
    at = F.pmod(value, length)
    return F.when((F.abs(at) < SNAP) | (F.abs(at - length) < SNAP), F.lit(0.0)).otherwise(at)


def forward(start: Column, end: Column, length: Column | float) -> Column:
    return F.pmod(end - start, F.lit(length) if isinstance(length, (int, float)) else length)


def signed(start: Column, end: Column, length: float) -> Column:
    """Shortest way from start to end, in (-length / 2, length / 2]."""
    ahead = forward(start, end, length)
    return F.when(ahead > length / 2, ahead - length).otherwise(ahead)


def shortest(a: Column, b: Column, length: float) -> Column:
    ahead = forward(a, b, length)
    return F.least(ahead, length - ahead)


def rescaled_shift(a: Column, length_a: float, b: Column, length_b: float) -> Column:
    """Distance of two positions on axes of different lengths, after rescaling the second to the first."""
    return shortest(a, b * (length_a / length_b), length_a)


def interval(start: Column, end: Column, length: float) -> Column:
    """Struct (start, end, length, wraps) with both ends on the axis."""
    a, b = on_axis(start, length), on_axis(end, length)
    return F.struct(a.alias("start"), b.alias("end"), forward(a, b, length).alias("length"), (b < a).alias("wraps"))


def inside(value: Column, start: Column, end: Column) -> Column:
    """In [start, end), which may wrap past the end of the axis."""
    return F.when(start <= end, (value >= start) & (value < end)).otherwise((value >= start) | (value < end))


def near_edge(value: Column, length: float, margin: float) -> Column:
    at = on_axis(value, length)
    return F.least(at, length - at) <= margin


def end_after(start: Column, end: Column, length: Column) -> Column:
    """``end`` plus the fewest whole lengths that bring it to ``start`` or beyond."""
    return F.when(end >= start, end).otherwise(end + length * F.ceil((start - end) / length))
