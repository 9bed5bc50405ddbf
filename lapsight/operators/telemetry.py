"""Recorded points to kinematics, cleaned points, laps and a shared centreline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.functions.geo import haversine_m
from lapsight.operators import series

SEGMENT = ["run_id", "track_index", "segment_index"]
#: Nodes of a line that is sent to the tasks.
MOST_NODES = 100_000


def kinematics(points: DataFrame) -> DataFrame:
    """Step distance, time step and speed per point.

    The device's distance is taken where it doesn't go back, else the distance
    between positions; the speed is the device's, else the reported one, else
    distance over time, each only if not negative.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("point_index")
    lat, lon = F.col("latitude_deg"), F.col("longitude_deg")
    by_position = haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)
    by_device = F.col("device_distance_m") - F.lag("device_distance_m").over(w)
    now = series.seconds(F.col("timestamp_utc"))
    native, reported, derived = (F.when(F.col(c) >= 0, F.col(c)) for c in ("device_speed_mps", "reported_speed_mps", "derived_speed_mps"))
    named = lambda a, b, c: F.when(native.isNotNull(), a).when(reported.isNotNull(), b).when(derived.isNotNull(), c).otherwise("unavailable")
    return (
        points.withColumn("step_distance_m", F.coalesce(F.when(by_device >= 0, by_device), by_position))
        .withColumn("time_step_s", now - F.lag(now).over(w))
        .withColumn("derived_speed_mps", F.when(F.col("time_step_s") > 0, F.col("step_distance_m") / F.col("time_step_s")))
        .withColumn("analysis_speed_mps", F.coalesce(native, reported, F.col("derived_speed_mps")))
        .withColumn("analysis_speed_source", named("device", "reported", "position_derived"))
        .withColumn("speed_certainty", named("native_high", "reported_medium", "derived_lower"))
    )


def segment_summary(points: DataFrame) -> DataFrame:
    """Per segment: points, time span (only where all times are there and none goes back), path, gaps and typical step."""
    dt = F.col("time_step_s")
    return points.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("timestamp_utc").isNull()).alias("missing_times"),
        F.count_if(dt == 0).alias("same_times"),
        F.count_if(dt < 0).alias("regressions"),
        F.count_if(dt > 5).alias("gaps"),
        F.min_by("timestamp_utc", "point_index").alias("first_time"),
        F.max_by("timestamp_utc", "point_index").alias("last_time"),
        F.sum(F.coalesce("step_distance_m", F.lit(0.0))).alias("path_m"),
        F.median(F.when(dt > 0, dt)).alias("median_step_s"),
    ).withColumn("monotonic", (F.col("missing_times") == 0) & (F.col("regressions") == 0)).withColumn(
        "duration_s", F.when(F.col("monotonic"), series.seconds(F.col("last_time")) - series.seconds(F.col("first_time")))
    )


def excursions(points: DataFrame, most_points: int = 3, leg_m: float = 35.0, top_speed: float = 30.0, speed_factor: float = 1.5, bridge_s: float = 8.0) -> DataFrame:
    """(segment, start, size) of short bursts away from the course, none overlapping.

    Of every point and every size up to ``most_points``, the legs to and from
    the burst and the bridge across it come from neighbours at fixed distances;
    the smallest size that qualifies is kept, and a fold over a segment's few
    candidates takes the earliest that don't overlap.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("point_index")
    here = F.struct(F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"), series.seconds(F.col("timestamp_utc")).alias("t"))
    rows = points.select(*SEGMENT, "point_index", here.alias("p")).withColumn("i", F.row_number().over(w) - 1).withColumn("before", F.lag("p").over(w))
    for k in range(most_points + 1):
        rows = rows.withColumn(f"n{k}", F.lead("p", k).over(w))

    def leg(a: str, b: str) -> Column:
        return haversine_m(F.col(a)["lat"], F.col(a)["lon"], F.col(b)["lat"], F.col(b)["lon"])

    # each leg is a column of its own, so that its distance is computed once
    legs = {"out": leg("before", "n0")} | {f"back{k}": leg(f"n{k - 1}", f"n{k}") for k in range(1, most_points + 1)} | {f"bridge{k}": leg("before", f"n{k}") for k in range(1, most_points + 1)}
    rows = rows.withColumns(legs)

    def speed(way: str, a: str, b: str) -> Column:
        return F.when(F.col(b)["t"] > F.col(a)["t"], F.col(way) / (F.col(b)["t"] - F.col(a)["t"]))

    rows = rows.withColumns(
        {"v_out": speed("out", "before", "n0")}
        | {f"v_back{k}": speed(f"back{k}", f"n{k - 1}", f"n{k}") for k in range(1, most_points + 1)}
        | {f"v_bridge{k}": speed(f"bridge{k}", "before", f"n{k}") for k in range(1, most_points + 1)}
    )

    def burst(k: int) -> Column:
        out, back, bridge = F.col("out"), F.col(f"back{k}"), F.col(f"bridge{k}")
        speeds = [F.col("v_out"), F.col(f"v_back{k}"), F.col(f"v_bridge{k}")]
        timed = speeds[0].isNotNull() & speeds[1].isNotNull() & speeds[2].isNotNull()
        fast = (out >= leg_m) & (back >= leg_m) & (speeds[0] > speed_factor * top_speed) & (speeds[1] > speed_factor * top_speed)
        plain = (speeds[2] <= top_speed) & (F.col(f"n{k}")["t"] - F.col("before")["t"] <= bridge_s)
        untimed = max(100.0, 3 * leg_m)
        return F.when(timed, fast & plain).otherwise((out >= untimed) & (back >= untimed) & (bridge <= leg_m))

    size = F.coalesce(*[F.when(burst(k), F.lit(k)) for k in range(1, most_points + 1)])
    found = rows.withColumn("size", size).where("size is not null").groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(F.struct("i", "size"))).alias("all"))
    taken = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<i:int,size:int>>").alias("out")),
        lambda a, c: F.when(c["i"] < a["free"], a).otherwise(
            F.struct((c["i"] + c["size"]).alias("free"), F.concat(a["out"], F.array(F.struct(c["i"].alias("i"), c["size"].alias("size")))).alias("out"))
        ),
        lambda a: a["out"],
    )
    return found.select(*SEGMENT, F.explode(taken).alias("x")).select(*SEGMENT, F.col("x.i").alias("start"), F.col("x.size").alias("size"))


def clean(points: DataFrame, most_share: float = 0.005, most: int = 25, **limits: float) -> tuple[DataFrame, DataFrame]:
    """Points without excursions, kinematics taken anew, and the rejected points.

    Per run all or none: more candidates than a share of its points (one at
    least, ``most`` at most) are left for a reviewer.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("point_index")
    numbered = points.withColumn("__i", F.row_number().over(w) - 1)
    bad = excursions(points, **limits).select(*SEGMENT, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("__i"))
    counts = points.groupBy("run_id").agg(F.count(F.lit(1)).alias("__n"))
    allowed = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(most_share * F.col("__n"))))
    within = bad.groupBy("run_id").agg(F.count(F.lit(1)).alias("__bad")).join(counts, "run_id").where(F.col("__bad") <= allowed)
    bad = bad.join(within.select("run_id"), "run_id", "left_semi")
    kept = kinematics(numbered.join(bad, [*SEGMENT, "__i"], "left_anti").drop("__i"))
    rejected = numbered.join(bad, [*SEGMENT, "__i"], "left_semi").drop("__i").withColumn("reason", F.lit("isolated_excursion"))
    return kept, rejected


def gate_crossings(points: DataFrame, gate_x: float, gate_y: float, radius_m: float, minimum_lap_s: float, gap_s: float = 3.0) -> DataFrame:
    """(segment, point_index) where the gate is passed.

    Points within the radius form passes, split where they are more than
    ``gap_s`` apart; each pass counts at its nearest point. Of passes closer in
    time than a lap can be, the nearer one counts.
    """
    away = F.hypot(F.col("x_m") - gate_x, F.col("y_m") - gate_y)
    near = points.withColumn("away", away).where(F.col("away") <= radius_m)
    passes = series.gap_islands(near, SEGMENT, "timestamp_utc", "point_index", gap_s, "pass")
    best = passes.groupBy(*SEGMENT, "pass").agg(F.min(F.struct("away", "point_index", series.seconds(F.col("timestamp_utc")).alias("t"))).alias("b"))
    ordered = best.groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(F.struct("b.point_index", "b.t", "b.away"))).alias("all"))
    kind = "array<struct<point_index:int,t:double,away:double>>"

    def step(done: Column, c: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return (
            F.when((F.size(done) == 0) | last["t"].isNull() | c["t"].isNull() | (c["t"] - last["t"] >= minimum_lap_s), F.concat(done, F.array(c)))
            .when(c["away"] < last["away"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(c)))
            .otherwise(done)
        )

    merged = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), step)
    return ordered.select(*SEGMENT, F.explode(merged).alias("c")).select(*SEGMENT, "c.point_index")


def laps(points: DataFrame, crossings: DataFrame, shortest_s: float = 10.0, longest_s: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """Lap table with validity, and the points of each lap; a crossing's point ends one lap and begins the next."""
    marked = points.join(crossings.withColumn("__gate", F.lit(True)), [*SEGMENT, "point_index"], "left")
    numbered, ranges = series.inclusive_ranges(marked, SEGMENT, ["point_index"], F.col("__gate").isNotNull())
    members = series.rows_in_ranges(numbered, ranges, SEGMENT).withColumnRenamed("range_index", "lap_id").drop("__gate")
    inner = F.col("row_index") > F.col("start")
    table = members.groupBy(*SEGMENT, "lap_id").agg(
        (series.seconds(F.max("timestamp_utc")) - series.seconds(F.min("timestamp_utc"))).alias("duration_s"),
        F.sum(F.when(inner, F.col("step_distance_m"))).alias("distance_m"),
        F.avg(F.col("timestamp_utc").isNotNull().cast("double")).alias("time_share"),
        F.coalesce(F.avg((F.col("analysis_speed_mps") < 0.8).cast("double")), F.lit(1.0)).alias("stationary_share"),
        F.count_if(inner & (F.col("time_step_s") > 5)).alias("gaps"),
        F.count_if(inner & (F.col("time_step_s") < 0)).alias("regressions"),
        F.median("analysis_speed_mps").alias("median_speed_mps"),
    )
    typical = F.broadcast(table.agg(F.median("distance_m").alias("__typical")))  # one row
    checks = {
        "duration": F.col("duration_s").between(shortest_s, longest_s),
        "distance": F.try_divide("distance_m", "__typical").between(0.85, 1.15),
        "stationary": F.col("stationary_share") <= 0.15,
        "coverage": F.col("time_share") >= 0.98,
        "gaps": (F.col("gaps") == 0) & (F.col("regressions") == 0),
    }
    flags = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return table.join(typical).withColumn("flags", flags).withColumn("valid", F.size("flags") == 0).drop("__typical"), members


def resample(members: DataFrame, nodes: int, keys: list[str]) -> DataFrame:
    """x and y of each lap at equal shares of its own length: (keys, node, x_m, y_m)."""
    w = Window.partitionBy(*keys).orderBy("row_index")
    step = F.hypot(F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w))
    along = members.withColumn("__d", F.coalesce(step, F.lit(0.0))).withColumn("__s", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    share = along.withColumn("node", nodes * F.try_divide(F.col("__s"), F.max("__s").over(Window.partitionBy(*keys))))
    axis = share.groupBy(*keys, "node").agg(F.median("x_m").alias("x_m"), F.median("y_m").alias("y_m"))
    grid = axis.select(*keys).distinct().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)).cast("array<double>")))
    x = series.interpolate(axis.select(*keys, "node", "x_m"), grid, keys, "node", "x_m")
    y = series.interpolate(axis.select(*keys, "node", "y_m"), grid, keys, "node", "y_m")
    return x.join(y, [*keys, "node"])


def match_line(places: np.ndarray, line: np.ndarray, guess: np.ndarray | None = None, weight: float = 0.08, chunk: int = 512) -> np.ndarray:
    """(s, error, x, y) of each place on a closed line of nodes; a block of places against all segments at once."""
    a, b = line, np.roll(line, -1, axis=0)
    length = np.hypot(*(b - a).T)
    start, whole = np.cumsum(length) - length, float(length.sum())
    squared = np.maximum(length**2, 1e-12)
    parts = [np.zeros((0, 4))]
    for i in range(0, len(places), chunk):
        p = places[i : i + chunk, None, :]
        t = np.clip(((p - a) * (b - a)).sum(axis=2) / squared, 0, 1)
        q = a + t[..., None] * (b - a)
        d = np.hypot(*(p - q).transpose(2, 0, 1))
        s, cost = start + t * length, d**2
        if guess is not None:
            g = guess[i : i + chunk, None]
            s = s + np.round((g - s) / whole) * whole
            cost = cost + (weight * (s - g)) ** 2
        best = cost.argmin(axis=1)
        at = np.arange(len(best))
        parts.append(np.stack([s[at, best], d[at, best], q[at, best, 0], q[at, best, 1]], axis=1))
    return np.concatenate(parts)


def project(points: DataFrame, line: DataFrame, guess: str | None = None, weight: float = 0.08, chunk: int = 512) -> DataFrame:
    """``points`` with s_m, map_error_m, matched_x_m and matched_y_m on the closed centreline.

    The nearest place of all segments wins; with a column ``guess`` of expected
    progress, squared distance plus the weighted squared progress error, and
    s_m is unwrapped to the guess. The line's nodes, a few thousand at most,
    are sent to the tasks, which compare a block of points with all segments.
    """
    rows = line.orderBy("node").select("x_m", "y_m").limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"a line has {MOST_NODES} nodes at most")
    nodes = np.array([[r[0], r[1]] for r in rows], float).reshape(-1, 2)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = match_line(batch[["x_m", "y_m"]].to_numpy(float), nodes, batch[guess].to_numpy(float) if guess else None, weight, chunk)
            yield batch.assign(s_m=found[:, 0], map_error_m=found[:, 1], matched_x_m=found[:, 2], matched_y_m=found[:, 3])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(match, f"{kept}, s_m double, map_error_m double, matched_x_m double, matched_y_m double")


def bracketed_outliers(
    matched: DataFrame, keys: list[str], order: str, error: str, far: float = 40.0, near: float = 20.0, most: int = 3, time: str | None = None, bridge_s: float = 8.0
) -> DataFrame:
    """Rows of short runs of large errors whose neighbours on both sides are near the course and, with ``time``, at most ``bridge_s`` apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    far_off = F.coalesce(F.col(error) >= far, F.lit(False))
    here = F.struct(F.col(error).alias("error"), (series.seconds(F.col(time)) if time else F.lit(0.0)).alias("t"), F.row_number().over(w).alias("i"))
    numbered = matched.withColumn("__here", here).withColumn("__sound", F.when(~far_off, F.col("__here")))
    # a run is maximal, so the nearest rows that are not far off stand right before and behind it
    before = F.last("__sound", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = Window.partitionBy(*keys).orderBy(F.desc("__here.i")).rowsBetween(Window.unboundedPreceding, -1)  # a frame to the end is read again for each row
    after = F.last("__sound", ignorenulls=True).over(behind)
    seen = numbered.withColumn("__a", before).withColumn("__b", after)
    size = F.col("__b.i") - F.col("__a.i") - 1
    close = (F.col("__a.error") <= near) & (F.col("__b.error") <= near) & (F.col("__b.t") - F.col("__a.t") <= bridge_s)
    return seen.where(far_off & (size <= most) & close).drop("__here", "__sound", "__a", "__b")
