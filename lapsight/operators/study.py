"""Study tables: input ranges, summaries, effects, priorities and samples per gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import series


def running_maximum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, to: str) -> DataFrame:
    """Largest value so far; nulls take the one before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.max(value).over(w))


def mode_counts(rows: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Per key a map from each mode to its count; counted by mode first, so the map is as small as the list of modes."""
    counts = rows.where(F.col(mode).isNotNull()).groupBy(*keys, mode).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(mode).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(pairs).alias("modes"))


def input_ranges(long: DataFrame, path: str, value: str) -> DataFrame:
    """Per input: least and greatest number where all its texts are numbers, else its distinct texts in order."""
    number = F.col(value).try_cast("double")
    out = long.where(F.col(value).isNotNull()).groupBy(path).agg(
        F.bool_and(number.isNotNull()).alias("numeric"), F.min(number).alias("low"), F.max(number).alias("high"), F.array_sort(F.collect_set(value)).alias("texts")
    )
    ours = lambda c: F.when(F.col("numeric"), F.col(c))
    return out.select(path, "numeric", ours("low").alias("low"), ours("high").alias("high"), F.when(~F.col("numeric"), F.array_join("texts", ";")).alias("texts"))


def summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 for one value) and 10, 50 and 90 % quantiles."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"))
    return out.select(*keys, "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")).alias("sd"), *[F.col("q")[i].alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


def pass_summary(passes: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per key and metric: complete passes, five quantiles and the coefficient of variation (null around 0)."""
    long = passes.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    levels = (0.1, 0.25, 0.5, 0.75, 0.9)
    out = long.where("value is not null").groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("value", F.array(*map(F.lit, levels))).alias("q"), F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value"))).alias("cv")
    )
    return out.select(*keys, "metric", "n", *[F.col("q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(levels)], "cv")


def effects(associations: DataFrame, spreads: DataFrame, metric: str, inputs: str) -> DataFrame:
    """Effect of each input on each metric: slope times the input's deviation, elasticity at the means, share of the squared effects.

    ``associations`` has (metric, input, slope), ``spreads`` (metric, input,
    x_mean, x_sd, y_mean). Nothing is shared where all effects are 0.
    """
    both = associations.join(spreads, [metric, inputs])
    effect = F.col("slope") * F.col("x_sd")
    square = F.sum(effect * effect).over(Window.partitionBy(metric))
    return both.select(metric, inputs, effect.alias("effect"), F.try_divide(F.col("slope") * F.col("x_mean"), F.col("y_mean")).alias("elasticity"), F.try_divide(effect * effect, square).alias("importance"))


def in_order(rows: DataFrame, status: str, ordinals: Mapping[str, int], then: Sequence[str], last: int = 9) -> DataFrame:
    """``rows`` with ``priority``, the ordinal of a status (``last`` where it has none), sorted by it and ``then``."""
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ordinals.items() for x in kv]), F.col(status)), F.lit(last))
    return rows.withColumn("priority", place).orderBy("priority", *then)


def top_ranked(rows: DataFrame, keys: Sequence[str], score: str, tie: str, most: int = 12) -> DataFrame:
    """The ``most`` rows with the largest score per key, ranked from 1. Spark keeps so many rows per key in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def samples_per_gate(passes: DataFrame, gate: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per gate, its complete passes in order as one array of structs."""
    complete = passes.dropna(subset=list(values))
    return complete.groupBy(gate).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("samples"))


def flagged(rows: DataFrame, flags: str) -> DataFrame:
    return rows.where(F.size(F.coalesce(F.col(flags), F.array().cast("array<string>"))) > 0)


def line_distance(one: DataFrame, other: DataFrame, grid: DataFrame, keys: Sequence[str], axis: str, x: str, y: str) -> DataFrame:
    """Per key, 95 % quantile and maximum of the distance between two lines at the nodes of ``grid``."""
    at = None
    for name, line in (("a", one), ("b", other)):
        for c in (x, y):
            part = series.interpolate(line, grid, keys, axis, c).select(*keys, axis, F.col(c).alias(f"{name}_{c}"))
            at = part if at is None else at.join(part, [*keys, axis])
    d = F.hypot(F.col(f"a_{x}") - F.col(f"b_{x}"), F.col(f"a_{y}") - F.col(f"b_{y}"))
    return at.groupBy(*keys).agg(F.percentile(d, 0.95).alias("p95"), F.max(d).alias("max"))


def selected_gate(gates: DataFrame, chosen: Column) -> DataFrame:
    """The one gate that is chosen; none or several are an error when it is read."""
    n = gates.where(chosen).agg(F.count(F.lit(1)).alias("n"))
    sure = n.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("exactly one lap gate is needed")).cast("boolean"))).select(F.lit(True).alias("sure"))
    return gates.where(chosen).join(sure).drop("sure")


def reviewed(evidence: DataFrame, context: DataFrame, key: str, status: str, urgency: Sequence[str], actions: Sequence[tuple[str, str]], otherwise: str, last: int = 9) -> DataFrame:
    """Evidence with its context's columns, ``review_priority`` (the status's place in ``urgency``, else ``last``) and ``suggested_action``.

    ``actions`` are pairs of a condition, as an SQL expression over all columns,
    and an action's name; the first condition that is true decides, one that is
    null does not hold. Evidence without context stays, with nulls.
    """
    place = F.array_position(F.array(*[F.lit(r) for r in urgency]), F.col(status))
    priority = F.when(place > 0, place - 1).otherwise(last).cast("long")
    action = F.coalesce(*[F.when(F.expr(condition), F.lit(name)) for condition, name in actions], F.lit(otherwise))
    return evidence.join(context, key, "left").withColumn("review_priority", priority).withColumn("suggested_action", action)


def status_counts(rows: DataFrame, keys: Sequence[str], status: str, subsets: Mapping[str, Column]) -> DataFrame:
    """Per group and status: rows, their share of the group, and how many are in each subset."""
    n = F.count(F.lit(1))
    out = rows.groupBy(*keys, status).agg(n.alias("n"), *[F.count_if(c).alias(name) for name, c in subsets.items()])
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))  # a row per status


def marker_rows(rows: DataFrame, keep: Sequence[str], markers: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(keep, marker, place, value, at): one row per marker that has a place; ``at`` is the marker's position in the list."""
    each = [F.struct(F.lit(i).alias("at"), F.lit(m).alias("marker"), F.col(p).cast("double").alias("place"), F.col(v).cast("double").alias("value")) for i, (m, (p, v)) in enumerate(markers.items())]
    return rows.select(*keep, F.inline(F.array(*each))).where("place IS NOT NULL")
