"""Statistics by group: convergence, ranks, effects, screens and intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import ordered
from lapsight.operators.staging import drop, stage


def split_half(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Medians of the first and second half against the scale of the whole; adequate from 20 rows and within 5 %.

    All rows are numbered in one order of groups and of ``order``, dealt by its
    ranges, so a large group is spread over tasks.
    """
    columns = list(dict.fromkeys([*keys, *order, value]))
    numbered = ordered.numbered(rows.select(*columns), [F.col(c) for c in (*keys, *order)], "__i")
    group = F.struct(*keys).alias("__k")
    sizes = stage(
        numbered.groupBy(group).agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("n"), F.stddev_pop(value).alias("sp"), F.stddev_samp(value).alias("ss")), "halves"
    )
    halves = numbered.withColumn("__k", F.struct(*keys)).join(sizes, "__k").withColumn("__early", F.col("__i") - F.col("__first") < F.floor(F.col("n") / 2))
    parts = {"m": F.col(value), "a": F.when(F.col("__early"), F.col(value)), "b": F.when(~F.col("__early"), F.col(value))}
    middle = ordered.quantiles(halves.select("__k", *[c.alias(f"__{n}") for n, c in parts.items()]), ["__k"], {n: F.col(f"__{n}") for n in parts}, {n: (n, 0.5) for n in parts})
    out = sizes.join(middle, "__k", "left")
    difference = F.abs(F.coalesce("a", "b") - F.col("b"))
    relative = difference / F.greatest(F.abs("m"), F.col("sp"), F.lit(1e-9))
    return out.select(
        "__k.*",
        "n",
        difference.alias("difference"),
        relative.alias("relative"),
        (F.col("ss") / F.sqrt("n")).alias("mean_se"),
        ((F.col("n") >= 20) & (relative <= 0.05)).alias("adequate"),
    )


def average_rank(keys: Sequence[str], value: str) -> Column:
    """Rank from 1; equal values share the mean of their ranks."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2.0


def rank_share(keys: Sequence[str], value: str) -> Column:
    return average_rank(keys, value) / F.count(value).over(Window.partitionBy(*keys))


def association(rows: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Pearson, Spearman and least-squares slope per group.

    Groups of fewer than ``least`` complete rows, or with one value only in x
    or y, have no row.
    """
    ranked = ordered.with_average_ranks(rows.select(*keys, x, y), keys, {x: "__rx", y: "__ry"})
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop(x, y).alias("__cov"),
        F.var_pop(x).alias("__vx"),
        F.var_pop(y).alias("__vy"),
        F.covar_pop("__rx", "__ry").alias("__rcov"),
        F.var_pop("__rx").alias("__rvx"),
        F.var_pop("__ry").alias("__rvy"),
    )
    varied = sums.where((F.col("n") >= least) & (F.col("__rvx") > 0) & (F.col("__rvy") > 0))
    return varied.select(
        *keys,
        "n",
        (F.col("__cov") / F.sqrt(F.col("__vx") * F.col("__vy"))).alias("pearson"),
        (F.col("__rcov") / F.sqrt(F.col("__rvx") * F.col("__rvy"))).alias("spearman"),
        (F.col("__cov") / F.col("__vx")).alias("slope"),
    )


def category_effect(rows: DataFrame, category: str, value: str) -> DataFrame:
    """One row: share of the variance between categories, span of their means, number of categories."""
    levels = rows.where(F.col(value).isNotNull()).groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("q"), F.sum(value).alias("s")
    )
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("s") * F.sum("s") / F.sum("n")
    return levels.agg(
        F.count(F.lit(1)).alias("levels"), F.try_divide(between, total).alias("eta_squared"), (F.max("m") - F.min("m")).alias("span")
    )


def upper_threshold(rows: DataFrame, value: str, floor: float, k: float) -> DataFrame:
    """One row: the larger of ``floor`` and median + k * 1.4826 * median absolute deviation.

    Rows are read once and counted by value; the deviations are taken of the
    distinct values.
    """
    counts = ordered.counted(rows, [], {"v": F.col(value).cast("double")})
    middle = ordered.quantiles_of(counts, [], {"median": ("v", 0.5)}).first()["median"]  # one number
    away = ordered.counted(counts, [], {"d": F.abs(F.col("__v") - F.lit(middle))}, F.col("n"))
    mad = ordered.quantiles_of(away, [], {"mad": ("d", 0.5)}).first()["mad"]
    drop(counts, away)
    threshold = None if middle is None else max(float(floor), middle + k * 1.4826 * mad)
    return rows.sparkSession.createDataFrame([(middle, mad, threshold)], "median double, mad double, threshold double")


def outliers(rows: DataFrame, key: str, value: str, floor: float, k: float, share: float, keep: int) -> DataFrame:
    """Rows above the robust threshold, the most severe first.

    At most ``share`` of all rows (one at least) go, and at least ``keep`` stay.
    """
    threshold = upper_threshold(rows, value, floor, k).first()["threshold"]
    n = rows.count()
    most = max(0, min(max(1, math.floor(share * n)), n - keep))
    above = rows.where(F.col(value) > F.lit(threshold).cast("double")).withColumn("threshold", F.lit(threshold).cast("double"))
    severe = above.withColumn("severity", F.col(value) / F.col("threshold"))
    return ordered.numbered(severe, [F.desc("severity"), F.desc(key)], "rank").where(F.col("rank") <= most)


def leave_one_out_shift(values: Column) -> Column:
    """Largest change of an array's median when one value is left out; null for fewer than two."""
    n = F.size(values)
    h = F.floor(n / 2)
    sorted_once = F.transform(F.array(F.array_sort(values)), lambda s: _median_shift(*[F.get(s, (h + d).cast("int")) for d in (-1, 0, 1)], n))
    return sorted_once[0]


def _median_shift(before: Column, middle: Column, after: Column, n: Column) -> Column:
    """The same from the values at places n / 2 - 1, n / 2 and n / 2 + 1 of the order.

    Only three ways to leave one out differ: before the middle, the middle, after it.
    """
    of_even = F.greatest(F.abs(middle - (before + middle) / 2), F.abs(before - (before + middle) / 2))
    of_odd = F.greatest(*[F.abs((a + b) / 2 - middle) for a, b in ((middle, after), (before, after), (before, middle))])
    return F.when(n >= 2, F.when(n % 2 == 0, of_even).otherwise(of_odd))


def leave_one_out_shifts(counts: DataFrame, keys: Sequence[str], named: Mapping[str, str]) -> DataFrame:
    """(keys, one column per entry (value, name)): leave_one_out_shift() of groups of any size, from a table of ``ordered.counted``."""
    placed = ordered.running_counts(counts)
    h = F.floor(F.col("total") / 2)
    at = [F.max(F.when((F.col("below") <= h + d) & (h + d < F.col("below") + F.col("n")), F.col("__v"))) for d in (-1, 0, 1)]
    near = placed.where((F.col("below") <= h + 1) & (h - 1 < F.col("below") + F.col("n")))
    each = near.groupBy("__k").agg(_median_shift(*at, F.max("total")).alias("__shift")).select("__k.*", "__shift")
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("__of") == value, F.col("__shift"))).alias(name) for value, name in named.items()])


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a fraction."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def binomial_upper_tail(successes: Column, n: Column) -> Column:
    """P(X >= successes) for X ~ Binomial(n, 1/2), by the logarithms of its terms."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")),
        F.struct((-n * F.ln(F.lit(2.0))).alias("log"), F.when(successes <= 0, F.exp(-n * F.ln(F.lit(2.0)))).otherwise(0.0).alias("p")),
        lambda a, k: F.struct(
            (a["log"] + F.ln((n - k + 1) / k)).alias("log"),
            (a["p"] + F.when(k >= successes, F.exp(a["log"] + F.ln((n - k + 1) / k))).otherwise(0.0)).alias("p"),
        ),
        lambda a: a["p"],
    )
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), terms))


def histogram(rows: DataFrame, value: str, fewest: int = 8, most: int = 24) -> DataFrame:
    """Equal bins between the least and greatest value, the last closed; floor(sqrt(n)) of them within limits."""
    v = F.col(value)
    ends = F.broadcast(rows.agg(F.count(value).alias("__n"), F.min(value).alias("__a"), F.max(value).alias("__b")))  # one row
    bins = F.least(F.lit(most), F.greatest(F.lit(fewest), F.floor(F.sqrt("__n"))))
    width = (F.col("__b") - F.col("__a")) / F.col("bins")
    placed = rows.where(v.isNotNull()).join(ends).withColumn("bins", bins)
    at = F.when(F.col("__b") == F.col("__a"), F.lit(0)).otherwise(F.least(F.floor((v - F.col("__a")) / width), F.col("bins") - 1))
    return placed.groupBy(at.cast("long").alias("bin"), F.col("bins").cast("long").alias("bins")).agg(F.count(F.lit(1)).alias("n"))
