"""Intervals of a closed course: segments cut at their bounds, rows within them, and profiles around anchors.

Rows, segments and intervals meet by cells of the course: each side is listed
in the cells that it touches and the join is by cell, so no side is compared
with all of the other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import series
from lapsight.operators.uncertainty import crossed


def _unrolled(intervals: DataFrame, start: str, end: str, length: float) -> DataFrame:
    """Parts (__a, __b) of circular intervals within [0, length], and __from, their distance from the interval's start.

    An end below the start lies beyond the finish. An interval longer than the
    course is the whole course once; its second part is then __open at its end,
    which is the interval's start.
    """
    whole = F.least(F.col(end) - F.col(start) + F.when(F.col(end) < F.col(start), F.lit(length)).otherwise(0.0), F.lit(length))
    rows = intervals.withColumn("__s", F.pmod(F.col(start).cast("double"), F.lit(float(length)))).withColumn("__w", whole)
    upto = F.col("__s") + F.col("__w")
    first = F.struct(F.col("__s").alias("__a"), F.least(upto, F.lit(length)).alias("__b"), F.lit(0.0).alias("__from"), F.lit(False).alias("__open"))
    rest = F.struct(F.lit(0.0).alias("__a"), (upto - length).alias("__b"), (F.lit(length) - F.col("__s")).alias("__from"), (F.col("__w") == length).alias("__open"))
    parts = F.filter(F.array(first, F.when(upto >= length, rest)), lambda p: p.isNotNull())
    return rows.where("__s IS NOT NULL AND __w >= 0").select(*intervals.columns, F.inline(parts))


def _cells(a: str, b: str, cell: float) -> Column:
    return F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))


def cut_segments(trace: DataFrame, keys: Sequence[str], place: str, values: Sequence[str], intervals: DataFrame, name: str, start: str, end: str, length: float, cell: float = 25.0) -> DataFrame:
    """Pieces of the trace within each interval: (keys, name, from, a, b, <value>_a, <value>_b).

    ``trace`` has places from 0 to the length along each key; between its rows
    values run straight. Pieces end at the interval's bounds and at cells, with
    values taken there, so what is added up over pieces has nothing twice and
    leaves nothing out. ``from`` is the distance of ``a`` from the interval's start.
    """
    w = Window.partitionBy(*keys).orderBy(place)
    ahead = {f"__1{v}": F.lead(v).over(w) for v in (place, *values)}
    segments = trace.where(F.col(place).isNotNull()).select(*keys, F.col(place).cast("double").alias(place), *values).withColumns(ahead).where(F.col(f"__1{place}") > F.col(place))
    listed = segments.withColumn("__cell", F.explode(_cells(place, f"__1{place}", cell)))
    parts = _unrolled(intervals.select(name, start, end), start, end, length).drop(start, end).withColumn("__cell", F.explode(_cells("__a", "__b", cell)))
    met = listed.join(parts, "__cell")
    low = F.greatest(F.col(place), F.col("__a"), F.col("__cell") * cell)
    high = F.least(F.col(f"__1{place}"), F.col("__b"), (F.col("__cell") + 1) * cell)
    cut = met.withColumn("a", low).withColumn("b", high).where("b > a")
    at = lambda v, x: F.col(v) + (F.col(x) - F.col(place)) / (F.col(f"__1{place}") - F.col(place)) * (F.col(f"__1{v}") - F.col(v))
    ends = [at(v, x).alias(f"{v}_{x}") for v in values for x in ("a", "b")]
    return cut.select(*keys, name, (F.col("__from") + F.col("a") - F.col("__a")).alias("from"), "a", "b", *ends)


def interval_totals(pieces: DataFrame, keys: Sequence[str], integrals: Mapping[str, str], speed: str) -> DataFrame:
    """Per group of pieces: length_m, integrals over the course (name: value), and the speed's entry, exit, least and greatest."""
    step = F.col("b") - F.col("a")
    return pieces.groupBy(*keys).agg(
        F.sum(step).alias("length_m"),
        *[F.sum(step * (F.col(f"{v}_a") + F.col(f"{v}_b")) / 2).alias(n) for n, v in integrals.items()],
        F.min_by(f"{speed}_a", "from").alias("entry"),
        F.max_by(f"{speed}_b", F.col("from") + step).alias("exit"),
        F.min(F.least(f"{speed}_a", f"{speed}_b")).alias("least"),
        F.max(F.greatest(f"{speed}_a", f"{speed}_b")).alias("greatest"),
    )


def rows_in_zones(rows: DataFrame, place: str, zones: DataFrame, start: str, end: str, length: float, cell: float = 25.0) -> DataFrame:
    """Every row with each zone that its place is in, bounds included; places are taken around the course."""
    at = rows.where(F.col(place).isNotNull()).withColumn("__at", F.pmod(F.col(place).cast("double"), F.lit(float(length)))).withColumn("__cell", F.floor(F.col("__at") / cell))
    own = [c for c in zones.columns if c not in rows.columns]
    parts = _unrolled(zones, start, end, length).withColumn("__cell", F.explode(_cells("__a", "__b", cell)))
    met = at.join(parts.select("__a", "__b", "__open", "__cell", *own), "__cell")
    inside = (F.col("__at") >= F.col("__a")) & ((F.col("__at") < F.col("__b")) | ((F.col("__at") == F.col("__b")) & ~F.col("__open")))
    return met.where(inside).drop("__at", "__a", "__b", "__open", "__cell")


def zone_metrics(members: DataFrame, keys: Sequence[str], medians: Mapping[str, str], fractions: Mapping[str, tuple[str, Column]], coverages: Mapping[str, str]) -> DataFrame:
    """Per group: rows, medians of columns, shares of the measured rows for which a condition holds, and shares that are measured."""
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.median(c).alias(n) for n, c in medians.items()],
        *[F.avg(F.when(F.col(c).isNotNull(), test.cast("double"))).alias(n) for n, (c, test) in fractions.items()],
        *[F.avg(F.col(c).isNotNull().cast("double")).alias(n) for n, c in coverages.items()],
    )


def around(profile: DataFrame, keys: Sequence[str], place: str, length: float) -> DataFrame:
    """``profile`` with its last row again before the first and its first again behind the last, so that interpolation goes around."""
    w = Window.partitionBy(*keys).orderBy(place)
    both = Window.partitionBy(*keys)
    rows = profile.where(F.col(place).isNotNull()).withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(both))
    shifts = F.filter(F.array(F.lit(0.0), F.when(F.col("__i") == F.col("__n"), F.lit(-float(length))), F.when(F.col("__i") == 1, F.lit(float(length)))), lambda x: x.isNotNull())
    return rows.withColumn("__shift", F.explode(shifts)).withColumn(place, F.col(place) + F.col("__shift")).drop("__i", "__n", "__shift")


def slowdown_baseline(
    profile: DataFrame, keys: Sequence[str], place: str, speed: str, length: float, step: float, approach_m: float, gap_m: float, half_window_m: float, sample_m: float
) -> DataFrame:
    """(keys, place, approach, local_least, slowdown) at regular anchors around each course.

    Each anchor lists its sample places from ``approach_m`` before to
    ``half_window_m`` behind it; the profile is interpolated at all of them in
    one pass. The approach is the median up to ``gap_m`` before the anchor, the
    local value the least within the half window.
    """
    anchors = int(-(-length // step))
    samples = int((approach_m + half_window_m + sample_m / 2) // sample_m)
    samples += (approach_m + half_window_m + sample_m / 2) % sample_m > 1e-9
    courses = profile.select(*keys).distinct() if keys else profile.limit(1).select()
    grid = courses.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(anchors - 1)))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    grid = grid.select(*keys, (F.col("__i") * float(step)).alias("anchor"), (F.col("__j") * float(sample_m) - float(approach_m)).alias("rel"))
    grid = grid.withColumn(place, F.pmod(F.col("anchor") + F.col("rel"), F.lit(float(length))))
    values = series.interpolate(around(profile, keys, place, length).select(*keys, place, speed), grid.select(*keys, place).distinct(), list(keys), place, speed)
    met = grid.join(values, [*keys, place])
    small = 1e-9
    out = met.groupBy(*keys, F.col("anchor")).agg(
        F.median(F.when(F.col("rel") <= -gap_m + small, F.col(speed))).alias("approach"),
        F.min(F.when(F.abs("rel") <= half_window_m + small, F.col(speed))).alias("local_least"),
    )
    return out.select(*keys, F.col("anchor").alias(place), "approach", "local_least", (F.col("approach") - F.col("local_least")).alias("slowdown"))


def profile_entries(events: DataFrame, start: str, observed: str, profile: DataFrame, scenario: str, place: str, predicted: str) -> DataFrame:
    """Per scenario and event: the predicted speed where the event starts and its error; beyond the profile its end value holds.

    The events, a bounded list, are put beside each scenario.
    """
    asked = crossed(profile.select(scenario).distinct(), events).withColumn(place, F.col(start).cast("double"))
    lines = profile.select(scenario, F.col(place).cast("double").alias(place), F.col(predicted).cast("double").alias(predicted))
    values = series.interpolate(lines, asked.select(scenario, place).distinct(), [scenario], place, predicted)
    return asked.join(values, [scenario, place]).drop(place).withColumn("error", F.col(predicted) - F.col(observed))
