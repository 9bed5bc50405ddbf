"""Traces against places and profiles, sweeps of a parameter, and summaries of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import ordered
from lapsight.operators.ranking import WIN, with_regret
from lapsight.operators.staging import dealt, drop, stage


def along(samples: DataFrame, grid: DataFrame, keys: Sequence[str], axis: str, values: Sequence[str]) -> DataFrame:
    """Distinct (keys, axis) of ``grid`` with ``values`` between the samples around them; the end values beyond.

    Samples and grid are dealt by range of (keys, axis) and written once, so a
    long course without keys is spread over tasks; what lies before and after a
    range comes from a table of one row per group and range. Samples of one
    place count as their mean; rows without a place, samples without one of the
    values, and grid rows without a key's samples give nothing, nothing, nulls.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("__one"))
    at = F.col(axis).cast("double").alias("__x")
    given = samples.dropna(subset=[axis, *values]).groupBy(key.alias("__k"), at).agg(*[F.avg(v).alias(f"__v{i}") for i, v in enumerate(values)])
    point = F.struct(F.col("__x").alias("x"), *[f"__v{i}" for i in range(len(values))])
    known = given.select("__k", "__x", F.lit(0).alias("__grid"), point.alias("__p"))
    asked = grid.where(F.col(axis).isNotNull()).select(key.alias("__k"), at).distinct()
    both = known.unionByName(asked.select("__k", "__x", F.lit(1).alias("__grid"), F.lit(None).cast(known.schema["__p"].dataType).alias("__p")))
    dealt = stage(both.repartitionByRange("__k", "__x").withColumn("__part", F.spark_partition_id()), "along")
    ranges = dealt.groupBy("__k", "__part").agg(F.min("__p").alias("__first"), F.max("__p").alias("__last"))
    # both sides look back, in one order and in the other: Spark reads a frame that starts at each row again for each row
    group, within = Window.partitionBy("__k"), Window.partitionBy("__k", "__part")
    last = lambda p, w, end: F.last(p, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    ranges = ranges.select(
        "__k", "__part", last("__last", group.orderBy("__part"), -1).alias("__earlier"), last("__first", group.orderBy(F.desc("__part")), -1).alias("__later")
    )  # at most as many rows as ranges
    seen = (
        dealt.withColumn("__a", last("__p", within.orderBy("__x", "__grid"), 0))
        .withColumn("__b", last("__p", within.orderBy(F.desc("__x"), F.desc("__grid")), 0))
        .where("__grid = 1")
        .join(ranges, ["__k", "__part"])
        .select("__k", "__x", F.coalesce("__a", "__earlier").alias("__a"), F.coalesce("__b", "__later").alias("__b"))
    )
    share = (F.col("__x") - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))

    def between(i: int) -> Column:
        a, b = F.col(f"__a.__v{i}"), F.col(f"__b.__v{i}")
        return F.when(F.col("__a").isNull(), b).when(F.col("__b").isNull() | (F.col("__a.x") == F.col("__x")), a).otherwise(a + share * (b - a))

    return seen.select(*[F.col(f"__k.{k}").alias(k) for k in keys], F.col("__x").alias(axis), *[between(i).alias(v) for i, v in enumerate(values)])


def _beside(rows: DataFrame, found: DataFrame, keys: Sequence[str], axis: str) -> DataFrame:
    """``rows`` with the columns of ``found`` for their keys (null ones too) and place."""
    k = F.struct(*keys, F.col(axis).cast("double").alias("__x"))
    own = found.select(k.alias("__k"), *[c for c in found.columns if c not in (*keys, axis)])
    return rows.withColumn("__k", k).join(own, "__k", "left").drop("__k")


def gate_table(gates: DataFrame, traces: DataFrame, keys: Sequence[str], trace: str, names: Sequence[str], place: str, speed: str, target: str, tolerance: float) -> DataFrame:
    """``gates`` and, for each trace of ``names``, its speed there, what it is above the target, and whether it complies.

    ``traces`` holds ``keys``, ``trace``, ``place`` and ``speed``. A gate
    without a place, a target or a trace has nulls.
    """
    asked = gates.select(*keys, place, F.explode(F.array(*[F.lit(n) for n in names])).alias(trace))
    met = along(traces.where(F.col(trace).isin(*names)), asked, [*keys, trace], place, [speed])
    wide = met.groupBy(*keys, place).agg(*[F.max(F.when(F.col(trace) == n, F.col(speed))).alias(f"{n}_speed") for n in names])
    out = _beside(gates, wide, keys, place)
    for n in names:
        above = F.col(f"{n}_speed") - F.col(target)
        out = out.withColumn(f"{n}_excess", F.when(above > 0, above).when(above <= 0, F.lit(0.0))).withColumn(f"{n}_complies", above <= tolerance)
    return out


def profile_points(observed: DataFrame, predictions: DataFrame, axis: str, predicted: str, middle: str, low: str, high: str) -> DataFrame:
    """``predictions`` with the observed profile at their places, the error, and whether they lie from low to high.

    The profile is interpolated once at each different place, whatever number
    of scenarios asks for it. A prediction without place or value is an error.
    """
    whole = F.col(axis).isNotNull() & F.col(predicted).isNotNull() & ~F.isnan(F.col(predicted).cast("double"))
    checked = predictions.withColumn(predicted, F.when(whole, F.col(predicted)).otherwise(F.raise_error(F.lit("a prediction lacks its place or value"))))
    names = {middle: f"observed_{middle}", low: f"observed_{low}", high: f"observed_{high}"}
    out = _beside(checked, along(observed, predictions, [], axis, list(names)).withColumnsRenamed(names), [], axis)
    error = F.col(predicted) - F.col(names[middle])
    return out.withColumn("error", error).withColumn("inside", F.col(predicted).between(F.col(names[low]), F.col(names[high])))


def profile_summary(points: DataFrame, scenario: str) -> DataFrame:
    return points.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("points"),
        F.avg("error").alias("bias"),
        F.avg(F.abs("error")).alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.col("inside").cast("double")).alias("share_inside"),
    )


def sweep_summary(rows: DataFrame, replicate: str, parameter: str, loss: str, metrics: Mapping[str, Column], passed: Column, residual: Column, then: str) -> DataFrame:
    """One row per value of ``parameter``: quantiles of regret and metrics, shares of passes and wins, largest residual, place.

    Regret is the loss above the least of the same replicate. Values are placed
    by the median of the loss, then of ``then``, one of ``metrics`` as ``loss``
    is; equal ones share the smallest place, values without a median have none.
    """
    given = {f"__m{i}": c for i, c in enumerate(metrics.values())} | {"__passed": passed, "__residual": F.abs(residual)}
    needed = dealt(rows.select(replicate, parameter, F.col(loss).alias("__loss"), *[c.alias(n) for n, c in given.items()]), [replicate])
    judged = stage(with_regret(needed, [replicate], "__loss").select(parameter, "regret", *given), "judged")  # read three times
    columns = {"regret": F.col("regret"), **{n: F.col(f"__m{i}") for i, n in enumerate(metrics)}}
    points = {f"{n}_{q}": (n, p) for n in columns for q, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))}
    means = judged.groupBy(F.struct(parameter).alias("__k")).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg(F.col("__passed").cast("double")).alias("pass_share"),
        F.avg((F.col("regret") <= WIN).cast("double")).alias("win_share"),
        F.max("__residual").alias("most_residual"),
    )
    spread = ordered.quantiles(judged, [parameter], columns, points)
    out = stage(means.join(spread.withColumn("__k", F.struct(parameter)).drop(parameter), "__k", "left"), "sweep")
    drop(spread, judged)
    order = F.struct(f"{loss}_median", f"{then}_median")
    counts = ordered.counted(out, [], {"order": F.when(F.col(f"{loss}_median").isNotNull(), order)})
    places = ordered.running_counts(counts).select(F.col("__v").alias("__order"), (F.col("below") + 1).alias("place"))
    return out.withColumn("__order", order).join(places, "__order", "left").select(f"__k.{parameter}", *[c for c in out.columns if c != "__k"], "place")


def distribution(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Per group: rows with a value, distinct values, least, p10, median, p90, most; groups without a value have no row.

    One count by value serves all of them, so the rows are read once.
    """
    counts = ordered.counted(rows, keys, {"value": value.cast("double")})
    plain = counts.groupBy("__k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_values"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    points = {n: ("value", p) for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))}
    spread = ordered.quantiles_of(counts, keys, points).select(F.struct(*keys, F.lit("value").alias("__of")).alias("__k"), *points)
    return plain.join(spread, "__k").select(*[F.col(f"__k.{k}").alias(k) for k in keys], "n", "distinct_values", "least", *points, "most")


def family_screening(associations: DataFrame, metric: str, family: str, path: str, strength: str) -> DataFrame:
    """Per metric and family of inputs: different inputs, the strongest (the first by name of equal ones) and the median strength.

    Inputs without a strength count as inputs only. Families overlap, so these are no shares of variance.
    """
    keys = [metric, family]
    first = F.min(F.when(F.col(strength).isNotNull(), F.struct(-F.col(strength), path))).alias("__best")
    # inputs are counted by group first, as one metric may hold most of them
    each = associations.groupBy(*keys, path).agg(first)
    best = each.groupBy(F.struct(*keys).alias("__k")).agg(F.count(path).alias("inputs"), F.min("__best").alias("__best"))
    middle = ordered.quantiles(associations, keys, {"s": F.col(strength)}, {"median_strength": ("s", 0.5)}).select(F.struct(*keys).alias("__k"), "median_strength")
    strongest = F.col("__best").getField(path)
    return best.join(middle, "__k", "left").select("__k.*", "inputs", strongest.alias("strongest"), (-F.col("__best")["col1"]).alias("strength"), "median_strength")


def case_summary(rows: DataFrame, case: str, category: str, draw: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Per case: its category (the first by name), scenarios, different draws, and p10, median and p90 of each metric."""
    points = {f"{n}_{q}": (n, p) for n in metrics for q, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))}
    # a row per case and draw first, so that a hot case's distinct draws are not one task's
    drawn = rows.groupBy(case, draw).agg(F.count(F.lit(1)).alias("__n"), F.min(category).alias("__c"))
    plain = drawn.groupBy(F.struct(case).alias("__k")).agg(F.min("__c").alias(category), F.sum("__n").alias("scenarios"), F.count(draw).alias("draws"))
    spread = ordered.quantiles(rows, [case], metrics, points).select(F.struct(case).alias("__k"), *points)
    return plain.join(spread, "__k", "left").select("__k.*", category, "scenarios", "draws", *points)
