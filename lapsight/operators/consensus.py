"""A centreline that all agreeing laps support, and the laps that don't.

Laps are put on common nodes and the line is the median of each node. Whether a
lap belongs is judged against the line of the others: as a lap's rank among the
values of a node tells which of the node's three middle values the others'
median comes from, those lines need no lap-by-lap join. Each round is written,
so plans stay as they are however many rounds there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import series
from lapsight.operators.staging import drop, stage
from lapsight.operators.telemetry import MOST_NODES, match_line

#: Places along the course where two lines are compared.
SAMPLES = 400
#: A step back along the course of more than so many metres is a wrong match.
BACK_M = 20.0


@dataclass(frozen=True)
class Rules:
    """When a lap leaves, and when the rounds end."""

    p95_limit_m: float = 15.0
    sustained_error_m: float = 15.0
    minimum_sustained: float = 0.05
    strong_sustained: float = 0.20
    shift_limit_m: float = 5.0
    deviations: float = 3.5
    most_share: float = 0.2
    minimum_laps: int = 3
    rounds: int = 6
    tolerance_m: float = 0.1
    spacing_m: float = 3.0
    smooth: tuple[int, int] = (5, 5)


@dataclass(frozen=True)
class Consensus:
    """``line`` (node, x_m, y_m, s_m, laps); ``laps``: every lap with its measures, verdict and the reference lap."""

    line: DataFrame
    laps: DataFrame
    rounds: int
    converged: bool


def left_out(nodes: DataFrame, lap: str, values: tuple[str, ...] = ("x_m", "y_m")) -> DataFrame:
    """``nodes`` with line_<value>, the median of the node's laps, and others_<value>, that of the other laps; null for a lap alone."""
    out = nodes.where(" AND ".join(f"`{v}` IS NOT NULL" for v in values))
    whole = Window.partitionBy("node")
    n = F.count(F.lit(1)).over(whole)
    for v in values:
        out = out.withColumn("__n", n).withColumn("__i", F.row_number().over(whole.orderBy(v, lap)) - 1)
        low = F.floor((F.col("__n") - 2) / 2)
        middle = [F.max(F.when(F.col("__i") == low + k, F.col(v))).over(whole) for k in range(3)]
        out = out.withColumns({f"__m{k}": m for k, m in enumerate(middle)}).withColumn("__low", low)
        at = lambda j: F.coalesce(*[F.when(j - F.col("__low") == k, F.col(f"__m{k}")) for k in range(3)])
        high = F.floor((F.col("__n") - 1) / 2)
        behind = lambda j: j + (F.col("__i") <= j).cast("long")  # noqa: E731  where place j of the others stands among all
        out = out.withColumn(f"line_{v}", (at(high) + at(F.floor(F.col("__n") / 2))) / 2)
        out = out.withColumn(f"others_{v}", F.when(F.col("__n") > 1, (at(behind(F.col("__low"))) + at(behind(high))) / 2))
        out = out.drop("__n", "__i", "__low", *[f"__m{k}" for k in range(3)])
    return out


def node_measures(lines: DataFrame, lap: str, rules: Rules = Rules()) -> DataFrame:
    """Per lap, from left_out(): p95_m and maximum_m of its distance to the others' line, sustained (share of nodes far off) and shift_m."""
    away = F.hypot(F.col("x_m") - F.col("others_x_m"), F.col("y_m") - F.col("others_y_m"))
    moved = F.hypot(F.col("line_x_m") - F.col("others_x_m"), F.col("line_y_m") - F.col("others_y_m"))
    return lines.groupBy(lap).agg(
        F.percentile(away, 0.95).alias("p95_m"),
        F.max(away).alias("maximum_m"),
        F.avg((away > rules.sustained_error_m).cast("double")).alias("sustained"),
        F.max(moved).alias("shift_m"),
        F.lit(0).cast("long").alias("backward"),
    )


def outlying_laps(measures: DataFrame, lap: str, rules: Rules = Rules()) -> DataFrame:
    """(lap, severity) of the laps that leave in this round, the most severe first.

    A lap is a candidate if a strong share of it is off, if a lesser share is
    and its 95th percentile or the shift it causes is above a robust limit, or
    if its match goes back and its percentile is above the plain limit. At most
    ``most_share`` of the laps leave (one at least), and ``minimum_laps`` stay.
    """
    known = measures.where("p95_m IS NOT NULL AND shift_m IS NOT NULL")
    first = known.agg(F.count(F.lit(1)).alias("n"), F.percentile("p95_m", 0.5).alias("p"), F.percentile("shift_m", 0.5).alias("s")).first()  # a row per lap
    n = measures.count()
    most = min(max(1, math.floor(n * rules.most_share)), max(0, n - rules.minimum_laps))
    if not first["n"] or not most:
        return known.select(lap, F.lit(0.0).alias("severity")).limit(0)
    spread = known.agg(F.percentile(F.abs(F.col("p95_m") - first["p"]), 0.5).alias("p"), F.percentile(F.abs(F.col("shift_m") - first["s"]), 0.5).alias("s")).first()
    p95_limit, shift_limit = (max(floor, first[c] + rules.deviations * 1.4826 * spread[c]) for floor, c in ((rules.p95_limit_m, "p"), (rules.shift_limit_m, "s")))
    p95, shift, sustained, back = F.col("p95_m"), F.col("shift_m"), F.coalesce("sustained", F.lit(0.0)), F.col("backward") > 0
    lesser = (sustained >= rules.minimum_sustained) & ((p95 > p95_limit) | (shift > shift_limit))
    candidate = (sustained >= rules.strong_sustained) | lesser | (back & (p95 > rules.p95_limit_m))
    severity = p95 / max(p95_limit, 1e-9) + shift / max(shift_limit, 1e-9) + sustained / max(rules.minimum_sustained, 1e-9) + back.cast("double")
    return known.where(candidate).select(lap, severity.alias("severity")).orderBy(F.desc("severity"), F.desc(lap)).limit(most)


def _along(xy: np.ndarray, closed: bool) -> np.ndarray:
    way = np.concatenate([xy, xy[:1]]) if closed else xy
    return np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(way, axis=0).T))])


def places(xy: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Points of a closed line at shares of its length."""
    s, way = _along(xy, True), np.concatenate([xy, xy[:1]])
    return np.stack([np.interp(share * s[-1], s, way[:, k]) for k in (0, 1)], axis=1)


def distance_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """95th percentile and maximum of the distance of two closed lines at equal shares."""
    share = np.linspace(0, 1, SAMPLES)
    d = np.hypot(*(places(a, share) - places(b, share)).T)
    return float(np.quantile(d, 0.95)), float(d.max())


def _on_nodes(points: DataFrame, lap: str, order: str, count: int, prior: np.ndarray | None) -> DataFrame:
    """(lap, node, x_m, y_m): each lap at equal shares of its own length or, with a prior line, of its progress along that."""
    kind = points.schema[lap].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        xy = rows.sort_values(order)[["x_m", "y_m"]].to_numpy(float)
        s = _along(xy, False)
        if len(xy) < 3 or s[-1] <= 0:
            return pd.DataFrame({lap: [], "node": [], "x_m": [], "y_m": []})
        share = s / s[-1]
        if prior is not None:
            whole = _along(prior, True)[-1]
            share = np.maximum.accumulate(np.clip(match_line(xy, prior, share * whole)[:, 0], 0, whole)) / whole
        share, first = np.unique(share, return_index=True)
        at = np.arange(count) / count
        return pd.DataFrame({lap: rows[lap].iloc[0], "node": np.arange(count), "x_m": np.interp(at, share, xy[first, 0]), "y_m": np.interp(at, share, xy[first, 1])})

    return points.groupBy(lap).applyInPandas(run, f"`{lap}` {kind}, node int, x_m double, y_m double")


def _smoothed(lines: DataFrame, keys: list[str], names: list[str], smooth: tuple[int, int]) -> DataFrame:
    """Rolling median and mean around the course; the first node, where laps begin and end, stays."""
    for n in names:
        lines = series.rolling_around(lines, keys, "node", n, f"__{n}", *smooth).withColumn(n, F.when(F.col("node") == 0, F.col(n)).otherwise(F.col(f"__{n}"))).drop(f"__{n}")
    return lines


def _measures(points: DataFrame, lines: DataFrame, lap: str, order: str, line: np.ndarray, rules: Rules) -> DataFrame:
    """Per lap: its points against the line of the others; one lap and one line to a task at a time."""
    kind = points.schema[lap].dataType.simpleString()
    names = ["median_m", "p95_m", "maximum_m", "sustained", "p95_shift_m", "shift_m", "backward"]

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        around = others.sort_values("node")[["others_x_m", "others_y_m"]].to_numpy(float)
        xy = own.sort_values(order)[["x_m", "y_m"]].to_numpy(float)
        if len(around) < 3 or np.isnan(around).any() or len(xy) < 3:
            return pd.DataFrame({lap: [], **{n: [] for n in names}})
        own_s, whole = _along(xy, False), _along(around, True)[-1]
        found = match_line(xy, around, own_s / max(own_s[-1], 1e-12) * whole)
        s, error = found[:, 0], found[:, 1]
        profile = pd.DataFrame({"bin": np.round(s, 1), "s": s, "e": error}).groupby("bin").median().sort_values("s")
        grid = np.arange(0.0, whole, max(1.0, rules.spacing_m))
        far = np.interp(grid, profile["s"], profile["e"]) > rules.sustained_error_m
        p95_shift, shift = distance_between(line, around)
        values = [np.median(error), np.quantile(error, 0.95), error.max(), far.mean(), p95_shift, shift, int((np.diff(s) < -BACK_M).sum())]
        return pd.DataFrame({lap: [own[lap].iloc[0]], **{n: [v] for n, v in zip(names, values, strict=True)}})

    columns = ", ".join(f"{n} {'long' if n == 'backward' else 'double'}" for n in names)
    return points.groupBy(lap).cogroup(lines.groupBy(lap)).applyInPandas(run, f"`{lap}` {kind}, {columns}")


def consensus(points: DataFrame, lap: str, order: str, rules: Rules = Rules()) -> Consensus:
    """The line of the laps that agree, from points (lap, order, x_m, y_m).

    A round puts the laps on nodes along the line of the round before, takes
    the line and each lap's measures against the others, and excludes outlying
    laps. When none is, and no place of the line has moved by more than the
    tolerance, the rounds end. Points without a lap or position do not count;
    a lap of fewer than three points, or one that does not move, is in no line.
    """
    spark = points.sparkSession
    given = stage(points.select(lap, order, "x_m", "y_m").dropna(subset=[lap, "x_m", "y_m"]), "consensus-points")
    w = Window.partitionBy(lap).orderBy(order)
    step = F.hypot(F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w))
    length = given.select(lap, step.alias("d")).groupBy(lap).agg(F.sum("d").alias("d")).agg(F.percentile("d", 0.5)).first()[0]
    if not length:
        raise ValueError("no lap has a usable length")
    kind = given.schema[lap].dataType.simpleString()
    gone = stage(spark.createDataFrame([], f"`{lap}` {kind}, excluded_in int, severity double"), "consensus-gone")

    def built(prior: np.ndarray | None) -> tuple[np.ndarray, DataFrame, DataFrame]:
        count = max(4, math.ceil((length if prior is None else _along(prior, True)[-1]) / rules.spacing_m))
        if count > MOST_NODES:
            raise ValueError(f"{count} nodes; {MOST_NODES} at most")
        active = given.join(gone, lap, "left_anti")
        lines = left_out(_on_nodes(active, lap, order, count, prior), lap)
        lines = stage(_smoothed(lines.drop("x_m", "y_m"), [lap], ["others_x_m", "others_y_m"], rules.smooth), "consensus-lines")
        line = lines.groupBy("node").agg(F.first("line_x_m").alias("x_m"), F.first("line_y_m").alias("y_m"), F.count(F.lit(1)).alias("laps"))
        line = stage(_smoothed(line.withColumn("__all", F.lit(0)), ["__all"], ["x_m", "y_m"], rules.smooth).drop("__all"), "consensus-line")
        xy = line.orderBy("node").select("x_m", "y_m").toPandas().to_numpy(float)  # MOST_NODES at most
        if not len(xy):
            raise ValueError("no lap has enough points")
        measures = stage(_measures(active, lines, lap, order, xy, rules), "consensus-measures")
        drop(lines)
        return xy, line, measures

    prior, converged, at = None, False, 0
    for at in range(1, rules.rounds + 1):
        xy, line, measures = built(prior)
        new = outlying_laps(measures, lap, rules).withColumn("excluded_in", F.lit(at)).select(lap, "excluded_in", "severity")
        both = stage(gone.union(new), "consensus-gone")
        found = both.count() - gone.count()
        drop(line, measures, gone)
        gone = both
        if not found and prior is not None and distance_between(prior, xy)[1] <= rules.tolerance_m:
            converged = True
            break
        prior = xy
    xy, line, measures = built(prior if not converged else xy)
    s = _along(xy, True)
    along = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s[:-1])], "node int, s_m double")
    all_laps = given.select(lap).distinct()
    named = all_laps.join(measures, lap, "left").join(gone, lap, "left").withColumn("included", F.col("p95_m").isNotNull() & F.col("excluded_in").isNull())
    best = measures.join(gone, lap, "left_anti").orderBy("p95_m", lap).limit(1).select(lap, F.lit(True).alias("reference"))
    laps = stage(named.join(F.broadcast(best), lap, "left").withColumn("reference", F.coalesce("reference", F.lit(False))), "consensus-laps")  # one row
    final = stage(line.join(F.broadcast(along), "node"), "consensus-result")  # MOST_NODES at most
    drop(line, measures, gone, given)
    return Consensus(final, laps, at, converged)
