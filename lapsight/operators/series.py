"""Operators on ordered measurements: steps, screens, islands, grids and integrals.

All take column names, so they run on telemetry and on any other ordered rows.
Windows are partitioned by the given keys only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def with_steps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with one column per value: its change since the row before, null in the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({name: value - F.lag(value).over(w) for name, value in values.items()})


def replace_spikes(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, threshold: float, to: str, reach: int = 2, least: int = 3
) -> DataFrame:
    """``to``: the value, or the median of the rows around where it is further than ``threshold`` from it.

    Frames of fewer than ``least`` values replace nothing.
    """
    around = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    middle = F.when(F.count(value).over(around) >= least, F.percentile(value, 0.5).over(around))
    return rows.withColumn("__middle", middle).withColumn(
        to, F.when(F.abs(F.col(value) - F.col("__middle")) > threshold, F.col("__middle")).otherwise(F.col(value))
    ).drop("__middle")


def rolling(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, to: str, median_of: int = 5, mean_of: int = 3) -> DataFrame:
    """Centred rolling median, then mean of that, over the rows that there are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a, b = median_of // 2, mean_of // 2
    return (
        rows.withColumn("__m", F.percentile(value, 0.5).over(w.rowsBetween(-a, a)))
        .withColumn(to, F.avg("__m").over(w.rowsBetween(-b, b)))
        .drop("__m")
    )


def rolling_around(rows: DataFrame, keys: Sequence[str], position: str, value: str, to: str, median_of: int = 5, mean_of: int = 3) -> DataFrame:
    """``rolling`` on a closed course: the ends are each other's neighbours.

    The first and last rows are put once more beyond the other end, as far as
    the frames reach.
    """
    reach = median_of // 2 + mean_of // 2
    w = Window.partitionBy(*keys).orderBy(position)
    numbered = rows.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    shifted = numbered.withColumn(
        "__lap",
        F.explode(
            F.filter(
                F.array(F.lit(0), F.when(F.col("__i") > F.col("__n") - reach, -1), F.when(F.col("__i") <= reach, 1)),
                lambda x: x.isNotNull(),
            )
        ),
    ).withColumn("__order", F.col("__i") + F.col("__lap") * F.col("__n"))
    smooth = rolling(shifted, keys, ["__order"], value, to, median_of, mean_of)
    return smooth.where("__lap = 0").drop("__i", "__n", "__lap", "__order")


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, to: str = "island") -> DataFrame:
    """``to``: number from 0 of the run of rows between breaks; a true ``breaks`` opens a run."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__opens", breaks.cast("int")).withColumn(
        to, F.coalesce(F.sum("__opens").over(w), F.lit(0)).cast("long")
    ).drop("__opens")


def gap_islands(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, gap: float, to: str = "island") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    stepped = rows.withColumn("__gap", seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(w))
    return islands(stepped, keys, [ts, tie], F.coalesce(F.col("__gap") > gap, F.lit(False)), to).drop("__gap")


def true_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """First and last row number, and length, of each maximal run of true rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__f", flag)
    marked = numbered.where("__f").withColumn("__g", F.col("__i") - F.row_number().over(w))
    return marked.groupBy(*keys, "__g").agg(
        F.min("__i").alias("start"), F.max("__i").alias("end"), F.count(F.lit(1)).alias("n")
    ).drop("__g")


def inclusive_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column) -> tuple[DataFrame, DataFrame]:
    """Numbered rows, and the ranges from each marker row to the next, both included.

    The row at a boundary belongs to the range that it ends and to the one
    that it begins.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("row_index", F.row_number().over(w) - 1)
    marks = numbered.where(marker).select(*keys, F.col("row_index").alias("start"), F.lead("row_index").over(Window.partitionBy(*keys).orderBy("row_index")).alias("end"))
    return numbered, marks.where("end is not null")


def rows_in_ranges(numbered: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row once for every range of its keys that holds it.

    Ranges only share boundaries, so a row is in the range of its number and,
    if it ends one, in that before: the running count of starts finds both
    without comparing all rows with all ranges.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    named = ranges.withColumn("range_index", F.row_number().over(w) - 1)
    upto = Window.partitionBy(*keys).orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    starts = named.select(*keys, F.col("start").alias("row_index"), F.lit(1).alias("__open"))
    counted = (
        numbered.join(starts, [*keys, "row_index"], "left")
        .withColumn("__at", F.coalesce(F.sum("__open").over(upto), F.lit(0)) - 1)
        .withColumn("range_index", F.explode(F.array(F.col("__at"), F.when(F.col("__open") == 1, F.col("__at") - 1))))
        .drop("__open", "__at")
    )
    inside = counted.join(named, [*keys, "range_index"])
    return inside.where((F.col("row_index") >= F.col("start")) & (F.col("row_index") <= F.col("end")))


def interpolate(samples: DataFrame, grid: DataFrame, keys: Sequence[str], axis: str, value: str) -> DataFrame:
    """``grid`` rows with ``value`` by linear interpolation between samples; the end values beyond them.

    Samples and grid meet in one ordered union, where each grid row sees the
    sample before and after it; no row is compared with more than two. Both
    look back, in one order and in the other, as Spark reads a frame that
    starts at each row again for each row.
    """
    w = Window.partitionBy(*keys)
    before, after = (o.rowsBetween(Window.unboundedPreceding, 0) for o in (w.orderBy(axis, "__grid"), w.orderBy(F.desc(axis), F.desc("__grid"))))
    point = F.when(F.col("__grid") == 0, F.struct(F.col(axis).alias("x"), F.col(value).alias("y")))
    both = samples.where(F.col(value).isNotNull()).select(*keys, axis, value, F.lit(0).alias("__grid")).unionByName(
        grid.select(*keys, axis, F.lit(None).cast("double").alias(value), F.lit(1).alias("__grid"))
    )
    seen = (
        both.withColumn("__p", point)
        .withColumn("__a", F.last("__p", ignorenulls=True).over(before))
        .withColumn("__b", F.last("__p", ignorenulls=True).over(after))
        .where("__grid = 1")
    )
    share = (F.col(axis) - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))
    between = F.col("__a.y") + share * (F.col("__b.y") - F.col("__a.y"))
    filled = (
        F.when(F.col("__a").isNull(), F.col("__b.y"))
        .when(F.col("__b").isNull() | (F.col("__a.x") == F.col(axis)), F.col("__a.y"))
        .otherwise(between)
    )
    return seen.select(*keys, axis, filled.alias(value))


def gradient(rows: DataFrame, keys: Sequence[str], axis: str, value: str, to: str) -> DataFrame:
    """Slope on an uneven axis: weighted central differences inside, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(axis)
    h0, h1 = F.col(axis) - F.lag(axis).over(w), F.lead(axis).over(w) - F.col(axis)
    d0, d1 = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    inside = (d1 / h1) * (h0 / (h0 + h1)) + (d0 / h0) * (h1 / (h0 + h1))
    return rows.withColumn(to, F.coalesce(inside, d1 / h1, d0 / h0))


def time_integral(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str) -> DataFrame:
    """Trapezoid integral over time and covered time per key."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    dt = F.lead(seconds(F.col(ts))).over(w) - seconds(F.col(ts))
    step = rows.where(F.col(value).isNotNull()).withColumn("__dt", dt).withColumn("__mean", (F.col(value) + F.lead(value).over(w)) / 2)
    return step.groupBy(*keys).agg(
        F.sum(F.col("__mean") * F.col("__dt")).alias("integral"), F.sum("__dt").alias("covered_s"), F.count(F.lit(1)).alias("n")
    )


def running_integral(rows: DataFrame, keys: Sequence[str], axis: str, value: str, to: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(axis)
    area = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(axis) - F.lag(axis).over(w))
    return rows.withColumn("__a", F.coalesce(area, F.lit(0.0))).withColumn(
        to, F.sum("__a").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__a")
