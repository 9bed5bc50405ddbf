"""Small expressions on names, flags and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(value: Column) -> Column:
    """Parts between semicolons, or between commas where there is none; trimmed, without empty ones."""
    separator = F.when(value.contains(";"), F.lit(";")).otherwise(F.lit(","))
    return F.filter(F.transform(F.split(value, separator), lambda x: F.trim(x)), lambda x: x != "")


def merged_flags(*flags: Column) -> Column:
    """Flags of several arrays, each once, in order of first appearance."""
    return F.array_distinct(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in flags]))


def without_flags(flags: Column, gone: list[str]) -> Column:
    return F.array_except(flags, F.array(*[F.lit(g) for g in gone]))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def by_prefix(path: Column, families: dict[str, str], other: str) -> Column:
    """The family of the first prefix that ``path`` starts with."""
    out = None
    for prefix, family in families.items():
        out = F.when(path.startswith(prefix), family) if out is None else out.when(path.startswith(prefix), family)
    return F.lit(other) if out is None else out.otherwise(other)


def direction(rho: Column, dead_band: float = 0.05) -> Column:
    return F.when(F.abs(rho) < dead_band, "no clear direction").when(rho > 0, "rises with the input").otherwise("falls with the input")


def range_text(low: Column, high: Column, unit: Column) -> Column:
    return F.when(low == high, F.format_string("%.6g %s", low, unit)).otherwise(F.format_string("%.6g to %.6g %s", low, high, unit))
