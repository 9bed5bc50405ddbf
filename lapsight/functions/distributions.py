"""Quantile functions of declared uncertainties."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 2.220446049250313e-16


def open_unit(u: Column) -> Column:
    """Kept off 0 and 1, where unbounded distributions have no value."""
    return F.greatest(F.lit(EPSILON), F.least(u, F.lit(1 - EPSILON)))


def uniform_ppf(u: Column, low: Column, high: Column) -> Column:
    return low + u * (high - low)


def triangular_ppf(u: Column, low: Column, mode: Column, high: Column) -> Column:
    """A point where the range is empty; else the inverse of the two parabolas."""
    width = high - low
    split = (mode - low) / F.nullif(width, F.lit(0.0))
    return (
        F.when(width == 0, low)
        .when(u <= split, low + F.sqrt(u * width * (mode - low)))
        .otherwise(high - F.sqrt((1 - u) * width * (high - mode)))
    )


def empirical_ppf(u: Column, samples: Column) -> Column:
    """A sample, without interpolation; null for an empty array."""
    n = F.size(samples)
    return F.get(F.array_sort(samples), F.least(F.floor(u * n), n - 1).cast("int"))


def choice(u: Column, choices: Column, probabilities: Column) -> Column:
    """The first choice whose cumulative probability is above ``u``."""
    upto = F.aggregate(
        probabilities,
        F.array().cast("array<double>"),
        lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + p)),
    )
    at = F.size(F.filter(upto, lambda c: c <= u))
    return F.get(choices, F.least(at, F.size(choices) - 1))


@F.pandas_udf(T.DoubleType())
def normal_quantile(u: pd.Series) -> pd.Series:
    return u.map(lambda x: None if pd.isna(x) else NormalDist().inv_cdf(x))


@F.pandas_udf(T.DoubleType())
def normal_probability(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else NormalDist().cdf(x))


def normal_ppf(u: Column, mean: Column, deviation: Column) -> Column:
    return mean + deviation * normal_quantile(open_unit(u))


def truncated_normal_ppf(u: Column, mean: Column, deviation: Column, low: Column, high: Column) -> Column:
    below, above = normal_probability((low - mean) / deviation), normal_probability((high - mean) / deviation)
    inner = normal_quantile(open_unit(below + u * (above - below)))
    return F.greatest(low, F.least(high, mean + deviation * inner))


def deviation(nominal: Column, absolute: Column, relative: Column, half_width: Column, level: Column) -> Column:
    """Standard deviation as given, relative to the nominal, or from half the width of an interval of some level."""
    return F.coalesce(absolute, relative * F.abs(nominal), half_width / normal_quantile((1 + level) / 2))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, also far out: below 1e-9 of relative error up to 30 deviations.

    Up to 4 deviations the series of the distribution function, beyond them the
    continued fraction of the ratio of tail and density; both as folds, so the
    expression stays small. Null and NaN stay as they are.
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    term = F.struct(x.alias("t"), x.alias("s"))
    odd = F.sequence(F.lit(1), F.lit(60))
    near = F.aggregate(odd, term, lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s")), lambda a: a["s"])
    ratio = F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda a, k: x + k / a)
    upper = F.when(x < 4, 0.5 - density * near).otherwise(density / ratio)
    return F.when(F.isnan(z), z).when(z.isNotNull(), F.when(z >= 0, upper).otherwise(1 - upper))


def impossible_tail(mean: Column, sd: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """The share of a normal prior below ``lower`` or above ``upper``; without spread 0 or 1, null bounds bound nothing."""
    share = F.lit(0.0)
    for bound, sign in ((lower, 1.0), (upper, -1.0)):
        if bound is not None:
            away = sign * (mean - bound)
            share = share + F.coalesce(F.when(sd > 0, normal_tail(away / sd)).when(sd == 0, (away < 0).cast("double")), F.lit(0.0))
    return share
