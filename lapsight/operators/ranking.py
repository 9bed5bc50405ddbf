"""Paired comparisons of designs over common scenarios, effects and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import ordered

TIE = 1e-12
WIN = 1e-9


def complete_scenarios(rows: DataFrame, scenario: str, design: str) -> DataFrame:
    """Rows of the scenarios in which every design has a row."""
    designs = F.broadcast(rows.agg(F.count_distinct(design).alias("__all")))  # one row
    full = rows.groupBy(scenario).agg(F.count_distinct(design).alias("__own")).join(designs).where("__own = __all")
    return rows.join(full.select(scenario), scenario, "left_semi")


def with_regret(rows: DataFrame, scenario: Sequence[str], metric: str, completed: Column | None = None) -> DataFrame:
    """``rows`` with regret, shared_win (ties share one win) and win (each within WIN of the best has one).

    A row that isn't completed counts as infinitely bad: it never wins and its
    regret is null.
    """
    w = Window.partitionBy(*scenario)
    value = F.col(metric) if completed is None else F.when(completed, F.col(metric))
    best = F.min("__v").over(w)
    tied = F.coalesce((F.col("__v") - F.col("__best") <= TIE).cast("double"), F.lit(0.0))
    return (
        rows.withColumn("__v", value)
        .withColumn("__best", best)
        .withColumn("regret", F.col("__v") - F.col("__best"))
        .withColumn("__tied", tied)
        .withColumn("shared_win", F.try_divide(F.col("__tied"), F.sum("__tied").over(w)))
        .withColumn("win", F.coalesce(F.col("regret") <= WIN, F.lit(False)).cast("double"))
        .drop("__v", "__best", "__tied")
    )


def design_ranking(rows: DataFrame, scenario: str, design: str, metric: str, completed: Column | None = None) -> DataFrame:
    """One row per design: scenarios, completed share, wins, regret and quantiles of the metric."""
    done = F.lit(True) if completed is None else completed
    judged = with_regret(rows, [scenario], metric, completed)
    means = judged.groupBy(design).agg(
        F.count_distinct(scenario).alias("scenario_count"),
        F.avg(done.cast("double")).alias("completion_fraction"),
        F.avg("shared_win").alias("paired_win_fraction"),
        F.avg("win").alias("full_win_fraction"),
        F.avg("regret").alias("mean_regret"),
    )
    points = {"regret_median": ("regret", 0.5), "regret_p90": ("regret", 0.9)}
    points |= {f"metric_{n}": ("metric", p) for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))}
    spread = ordered.quantiles(judged, [design], {"regret": F.col("regret"), "metric": F.col(metric)}, points)
    return _joined(means, spread, [design])


def _joined(means: DataFrame, spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables of the same groups side by side, null keys included."""
    a, b = (t.select(F.struct(*keys).alias("__k"), *[c for c in t.columns if c not in keys]) for t in (means, spread))
    return a.join(b, "__k", "left").select("__k.*", *[c for c in (*means.columns, *spread.columns) if c not in keys])


def case_effects(rows: DataFrame, draw: str, case: str, nominal: str, metric: str) -> DataFrame:
    """Per case, quantiles of the difference to the nominal case of the same draw."""
    base = rows.where(F.col(case) == nominal).select(draw, F.col(metric).alias("__base"))
    delta = rows.where(F.col(case) != nominal).join(base, draw).withColumn("__d", F.col(metric) - F.col("__base"))
    points = {f"delta_{n}": ("d", p) for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))}
    return _joined(delta.groupBy(case).agg(F.count("__d").alias("n")), ordered.quantiles(delta, [case], {"d": F.col("__d")}, points), [case])


def threshold_counts(rows: DataFrame, metric: str, limits: Sequence[float]) -> DataFrame:
    """Rows above each of a few limits, in one pass."""
    counts = F.array(*[F.struct(F.lit(float(x)).alias("limit"), F.count_if(F.col(metric) > x).alias("above")) for x in limits])
    out = rows.where(F.col(metric).isNotNull()).agg(F.count(F.lit(1)).alias("n"), counts.alias("__c"))
    return out.select("n", F.inline("__c")).withColumn("fraction", F.col("above") / F.col("n"))


def loss_shares(rows: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """Per part, quantiles over rows and its median's share of all parts' medians."""
    points = {f"__{i}{q}": (n, p) for i, n in enumerate(parts) for q, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))}
    wide = ordered.quantiles(rows, [], parts, points)
    each = [F.struct(F.lit(n).alias("part"), *[F.col(f"__{i}{q}").alias(q) for q in ("p10", "median", "p90")]) for i, n in enumerate(parts)]
    named = wide.select(F.inline(F.array(*each))).where("median is not null")
    return named.withColumn("share", F.try_divide(F.col("median"), F.sum("median").over(Window.partitionBy(F.lit(1)))))  # few parts


def structural_ranges(levels: DataFrame, parameter: str, level: str, value: str) -> DataFrame:
    """Per parameter: value at the nominal (smallest) level, span, levels of the extremes, largest change, rank and importance."""
    change = F.greatest(F.abs(F.col("high") - F.col("nominal")), F.abs(F.col("low") - F.col("nominal")))
    out = levels.groupBy(parameter).agg(
        F.count(F.lit(1)).alias("levels"),
        F.min_by(value, level).alias("nominal"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min_by(level, F.struct(F.col(value), F.col(level))).alias("low_level"),
        F.min_by(level, F.struct(-F.col(value), F.col(level))).alias("high_level"),
    )
    everything = Window.partitionBy(F.lit(1))  # one row per parameter
    return (
        out.withColumn("span", F.col("high") - F.col("low"))
        .withColumn("change", change)
        .withColumn("change_percent", F.when(F.abs("nominal") > 1e-12, 100 * F.col("change") / F.abs("nominal")))
        .withColumn("importance", F.try_divide(F.col("span"), F.max("span").over(everything)))
        .withColumn("rank", F.row_number().over(everything.orderBy(F.desc("span"), parameter)))
    )


def prediction_errors(rows: DataFrame, metric: str, group: str, predicted: str, observed: str) -> DataFrame:
    """Bias, absolute and squared errors of predictions, for all rows of a metric and for each of its groups.

    Sums are taken by group first and then added for all groups together.
    """
    e = F.col(predicted) - F.col(observed)
    both = F.explode(F.array(F.lit("ALL"), F.col("__own"))).alias("group")
    named = rows.select(F.col(metric).alias("metric"), F.col(group).cast("string").alias("__own"), e.alias("__e"), F.col(observed).cast("double").alias("__o"))
    sums = named.groupBy("metric", "__own").agg(
        F.count("__e").alias("n"), F.sum("__e").alias("s"), F.sum(F.abs("__e")).alias("a"), F.sum(F.col("__e") * F.col("__e")).alias("q")
    )
    whole = sums.select("metric", both, "n", "s", "a", "q").groupBy("metric", "group").agg(*[F.sum(c).alias(c) for c in ("n", "s", "a", "q")])
    points = {"median_ae": ("error", 0.5), "__low": ("observed", 0.25), "__high": ("observed", 0.75)}
    spread = ordered.quantiles(named.select("metric", both, "__e", "__o"), ["metric", "group"], {"error": F.abs("__e"), "observed": F.col("__o")}, points)
    mean = F.try_divide("a", "n")
    return _joined(whole, spread, ["metric", "group"]).select(
        "metric",
        "group",
        "n",
        F.try_divide("s", "n").alias("bias"),
        mean.alias("mae"),
        F.sqrt(F.try_divide("q", "n")).alias("rmse"),
        "median_ae",
        F.try_divide(mean, F.col("__high") - F.col("__low")).alias("mae_over_iqr"),
    )
