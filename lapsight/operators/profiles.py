"""Profiles over repeated passes of one course, and screens on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import series
from lapsight.operators.staging import drop, stage
from lapsight.operators.uncertainty import crossed


def quantile_columns(value: str, named: dict[str, float]) -> Column:
    """One array of exact quantiles, so that a group's values are sorted once."""
    return F.percentile(value, F.array(*[F.lit(q) for q in named.values()]))


def binned_axis(axis: Column, step: float) -> Column:
    """Multiples of ``step``, halves to even."""
    return F.rint(axis / step) * step


def profile_over_laps(samples: DataFrame, lap: str, axis: str, value: str, step: float) -> DataFrame:
    """Per place: laps with a value and the quantiles over the laps' own medians there."""
    own = samples.groupBy(lap, binned_axis(F.col(axis), step).alias("s")).agg(F.median(value).alias("v"))
    named = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = own.groupBy("s").agg(F.count("v").alias("n"), quantile_columns("v", named).alias("q"))
    return out.select("s", "n", *[F.col("q")[i].alias(n) for i, n in enumerate(named)])


def zero_filled_bins(rows: DataFrame, group: str, bin_of: Column, bins: int) -> DataFrame:
    """Counts per group and bin, 0 for bins without rows; the last bin is open above."""
    counted = rows.withColumn("bin", F.least(bin_of, F.lit(bins - 1))).where("bin is not null").groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = rows.select(group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return every.join(counted, [group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def prefix_quantiles(rows: DataFrame, order: str, value: str, quantiles: Sequence[float], least: int = 3) -> DataFrame:
    """Quantiles of all values up to each step of ``order``; a written table.

    Rows are counted by value and step, dealt by range of values and written.
    Counts of the ranges, added up over steps and then over ranges, tell which
    range holds a step's place; only that range is read for the step. So a
    place costs one range, whatever the steps before it hold.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(order).alias("__step"), F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = stage(counts.repartitionByRange("__v", "__step").withColumn("__part", F.spark_partition_id()), "prefix-counts")
    sums = dealt.groupBy("__step", "__part").agg(F.sum("__n").alias("__m"))
    grid = crossed(rows.select(F.col(order).alias("__step")).distinct(), dealt.select("__part").distinct())  # steps times ranges
    past = Window.partitionBy("__part").orderBy("__step").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(sums, ["__step", "__part"], "left").withColumn("__m", F.sum(F.coalesce("__m", F.lit(0))).over(past))
    step = Window.partitionBy("__step")
    before = step.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = filled.withColumn("__start", F.coalesce(F.sum("__m").over(before), F.lit(0))).withColumn("__total", F.sum("__m").over(step))
    names = {f"p{round(100 * q)}": float(q) for q in quantiles}
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("share")) for n, q in names.items()])
    place = F.col("__p.share") * (F.col("__total") - 1)
    asked = ranges.where(F.col("__total") >= least).withColumn("__p", F.explode(wanted))
    asked = asked.select(F.col("__step").alias("__upto"), "__part", "__start", "__m", "__total", F.col("__p.name").alias("__name"), place.alias("__place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("__at"))
    asked = asked.where((F.col("__start") <= F.col("__at")) & (F.col("__at") < F.col("__start") + F.col("__m")))
    needed = asked.select("__upto", "__part").distinct()
    near = dealt.join(needed, "__part").where("__step <= __upto").groupBy("__upto", "__part", "__v").agg(F.sum("__n").alias("__n"))
    inside = Window.partitionBy("__upto", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    hit = near.withColumn("__less", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(asked, ["__upto", "__part"])
    within = F.col("__at") - F.col("__start")
    hit = hit.where((F.col("__less") <= within) & (within < F.col("__less") + F.col("__n")))
    above = F.col("__place") - F.floor("__place")
    part_of = F.when(F.col("__at") == F.floor("__place"), 1 - above).otherwise(above)
    out = hit.groupBy(F.col("__upto").alias(order)).agg(F.max("__total").alias("n"), *[F.sum(F.when(F.col("__name") == n, F.col("__v") * part_of)).alias(n) for n in names])
    found = stage(out, "prefix-quantiles")
    drop(dealt)
    return found


def grade_materiality(profile: DataFrame, axis: str, height: str, spread: str, window: int) -> DataFrame:
    """One row: whether the slope of a profile is observable and large enough to matter.

    Heights are smoothed by a centred rolling median of ``window`` nodes. At
    least 5 nodes and 80 % of them need a height. The spread between laps must
    not drown the range; the range has to reach 3 and the 95th percentile of
    the absolute slope 2 degrees.
    """
    everything = Window.partitionBy(F.lit(1))  # a profile has few nodes
    coverage = F.avg(F.col(height).isNotNull().cast("double")).over(everything)
    nodes = profile.withColumn("__cover", coverage).where(F.col(height).isNotNull()).withColumn("__k", F.lit(1))
    half = window // 2
    w = Window.partitionBy("__k").orderBy(axis)
    smooth = nodes.withColumn("__z", F.percentile(height, 0.5).over(w.rowsBetween(-half, half)))
    sloped = series.gradient(smooth, ["__k"], axis, "__z", "__slope")
    out = sloped.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__cover").alias("__cover"),
        (F.max("__z") - F.min("__z")).alias("height"),
        F.median(spread).alias("median_spread"),
        F.percentile(F.abs(F.degrees(F.atan("__slope"))), 0.95).alias("p95_grade"),
    )
    status = (
        F.when((F.col("n") < 5) | (F.col("__cover") < 0.8), "insufficient_elevation_evidence")
        .when(F.col("median_spread") > F.greatest(F.lit(1.0), 0.5 * F.col("height")), "elevation_not_repeatable")
        .when((F.col("height") >= 3) & (F.col("p95_grade") >= 2), "paired_grade_sensitivity_recommended")
        .otherwise("grade_proxy_immaterial")
    )
    return out.withColumn("status", status).drop("__cover")
