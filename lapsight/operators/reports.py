"""Tables of a study: draws, inputs, energy, convergence, quality, decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import ordered
from lapsight.operators.staging import dealt, drop, stage


def long_draws(draws: DataFrame, key: str, maps: Mapping[str, str]) -> DataFrame:
    """(key, family, path, value as text) for every entry of the map columns, one family per column."""
    parts = [draws.select(key, F.lit(family).alias("family"), F.explode(c).alias("path", "v")) for c, family in maps.items()]
    out = None
    for p in parts:
        p = p.select(key, "family", "path", F.col("v").cast("string").alias("value"))
        out = p if out is None else out.unionByName(p)
    return out


def wide_draws(long: DataFrame, key: str, paths: Sequence[str]) -> DataFrame:
    """One column per named path, numbers where the text is one."""
    return long.groupBy(key).pivot("path", list(paths)).agg(F.first(F.col("value").try_cast("double")))


def complete_predictors(long: DataFrame, key: str) -> DataFrame:
    """Paths that every draw has."""
    n = F.broadcast(long.agg(F.count_distinct(key).alias("__n")))  # one row
    return long.groupBy("path").agg(F.count_distinct(key).alias("__own")).join(n).where("__own = __n").select("path")


def share_of_row(rows: DataFrame, key: Sequence[str], parts: Mapping[str, str]) -> DataFrame:
    """(key, component, value, share of the row's sum) of several columns; shares of an empty sum are null."""
    long = rows.select(*key, F.inline(F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).alias("value")) for n, c in parts.items()])))
    return long.withColumn("share", F.try_divide("value", F.sum("value").over(Window.partitionBy(*key))))


def energy_accounting(rows: DataFrame, key: Sequence[str], design: str, parts: Mapping[str, str]) -> DataFrame:
    """Per design and component: rows, quantiles of the value and median share of its row's sum, as in ``share_of_row``.

    The components stay columns until there is a row per design; only the
    shares need the rows of a key together, and they are written once.
    """
    given = {n: F.col(c).cast("double") for n, c in parts.items()}
    own = F.when(F.coalesce(*given.values()).isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in given.values()), F.lit(0.0)))
    by_row = dealt(rows.select(*key, design, *[c.alias(f"__c{i}") for i, c in enumerate(given.values())], own.alias("__t")), key)
    whole = by_row.withColumn("__t", F.sum("__t").over(Window.partitionBy(*key, design)))
    shares = stage(whole.select(design, *[F.try_divide(f"__c{i}", "__t").alias(f"__s{i}") for i in range(len(parts))]), "shares")
    points = {f"__{i}{n}": (of, p) for i, of in enumerate(parts) for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))}
    values = ordered.quantiles(rows, [design], given, points)
    middle = ordered.quantiles(shares, [design], {n: F.col(f"__s{i}") for i, n in enumerate(parts)}, {f"__{i}share": (n, 0.5) for i, n in enumerate(parts)})
    drop(shares)
    out = rows.groupBy(F.struct(design).alias("__k")).agg(*[F.count(c).alias(f"__n{i}") for i, c in enumerate(given.values())])
    for part in (values, middle):
        out = out.join(part.withColumn("__k", F.struct(design)).drop(design), "__k", "left")
    long = [
        F.struct(F.lit(n).alias("component"), F.col(f"__n{i}").alias("n"), *[F.col(f"__{i}{q}").alias(q) for q in ("p10", "median", "p90")], F.col(f"__{i}share").alias("share_median"))
        for i, n in enumerate(parts)
    ]
    return out.select("__k.*", F.inline(F.array(*long)))


def convergence_by_metric(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limits: tuple[float, float], least: int = 4) -> DataFrame:
    """Medians and outer quantiles of both halves, their change relative to the overall median, and a verdict.

    ``limits``: largest relative change of the median, and of the 10 % and 90 %
    quantiles. Fewer than ``least`` rows are not judged.
    """
    w = Window.partitionBy(*keys)
    half = rows.withColumn("__i", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    late = F.col("__i") > F.floor(F.col("__n") / 2)
    qs = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    out = half.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        F.median(value).alias("median"),
        F.percentile(F.when(~late, F.col(value)), qs).alias("a"),
        F.percentile(F.when(late, F.col(value)), qs).alias("b"),
    )
    change = lambda i: F.try_divide(F.abs(F.col("a")[i] - F.col("b")[i]), F.abs("median"))
    out = out.select(*keys, "n", "median", change(1).alias("median_change"), F.greatest(change(0), change(2)).alias("tail_change"))
    stable = (F.col("median_change") <= limits[0]) & (F.col("tail_change") <= limits[1])
    return out.withColumn("status", F.when(F.col("n") < least, "too_few").when(stable, "stable").otherwise("unsettled"))


def quality_summary(rows: DataFrame, checks: Mapping[str, Column], residuals: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row: whether each check holds for all rows, its share, and the largest absolute residual over several columns."""
    held = [a for n, c in checks.items() for a in (F.bool_and(c).alias(f"{n}_all"), F.avg(c.cast("double")).alias(f"{n}_share"))]
    worst = [F.max(F.greatest(*[F.abs(F.col(c)) for c in cs]) if len(cs) > 1 else F.abs(F.col(cs[0]))).alias(f"{n}_max") for n, cs in residuals.items()]
    return rows.agg(F.count(F.lit(1)).alias("n"), *held, *worst)


def decision(ranked: DataFrame, intervals: DataFrame, design: str, median: str, low: str, value: str) -> DataFrame:
    """The design of the smallest median, whether its win share is surely above one half, and whether it lies at the edge of the values tried."""
    best = ranked.agg(
        F.min_by(design, F.struct(median, design)).alias("design"),
        F.min_by(value, F.struct(median, design)).alias("value"),
        F.min(median).alias("median"),
        F.min(value).alias("__a"),
        F.max(value).alias("__b"),
        F.count(F.lit(1)).alias("designs"),
    )
    sure = intervals.select(F.col(design).alias("design"), F.col(low).alias("win_low"))
    out = best.join(sure, "design", "left")
    clear = F.coalesce(F.col("win_low") > 0.5, F.lit(False))
    edge = (F.col("designs") > 1) & ((F.col("value") == F.col("__a")) | (F.col("value") == F.col("__b")))
    status = F.when(~clear, "no_clear_winner").when(edge, "winner_at_boundary").otherwise("clear_winner")
    return out.select("design", "value", "median", "designs", clear.alias("clear"), edge.alias("at_boundary"), status.alias("status"))


def importance_matrix(ranked: DataFrame, parameter: str, metric: str, score: str, metrics: Sequence[str], most: int) -> DataFrame:
    """The ``most`` parameters with the largest score in any metric, a column per metric, 0 where there is none."""
    top = ranked.groupBy(parameter).agg(F.max(score).alias("__s")).orderBy(F.desc("__s"), parameter).limit(most)
    wide = ranked.join(top.select(parameter), parameter, "left_semi").groupBy(parameter).pivot(metric, list(metrics)).agg(F.max(score))
    return wide.fillna(0.0, list(metrics))


def ordered_union(first: DataFrame, second: DataFrame, item: str, order: str, most: int) -> DataFrame:
    """Items of two rankings, each once, those of the first before the others, up to ``most``."""
    both = first.select(item, F.lit(0).alias("__l"), F.col(order).alias("__o")).unionByName(second.select(item, F.lit(1).alias("__l"), F.col(order).alias("__o")))
    place = both.groupBy(item).agg(F.min(F.struct("__l", "__o")).alias("__p"))
    w = Window.partitionBy(F.lit(1)).orderBy("__p", item)
    return place.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(item, "rank")


def eligible_cases(cases: DataFrame, case: str, checks: Mapping[str, Column]) -> DataFrame:
    """Cases that pass every check, and the reasons of those that don't."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return cases.select(case, (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, ";").alias("reasons"))


def stability_corridor(offsets: DataFrame, node: str, offset: str, stable: str) -> DataFrame:
    """Per node, 10 % and 90 % quantiles of the offsets of stable cases (of all where none is stable), and of all cases."""
    qs = F.array(F.lit(0.1), F.lit(0.9))
    out = offsets.groupBy(node).agg(F.percentile(F.when(F.col(stable), F.col(offset)), qs).alias("s"), F.percentile(offset, qs).alias("a"))
    own = F.coalesce("s", "a")
    return out.select(node, own[0].alias("low"), own[1].alias("high"), F.col("a")[0].alias("all_low"), F.col("a")[1].alias("all_high"))
