"""From canonical points of recorded runs to laps, a shared line and a speed profile, and their publication as one version."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.functions import geo
from lapsight.operators import consensus, profiles, telemetry
from lapsight.operators.staging import stage
from lapsight.sources import publish

#: Of the published bundle; a reader refuses others.
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Gate:
    latitude_deg: float
    longitude_deg: float
    radius_m: float = 12.0
    minimum_lap_s: float = 20.0


@dataclass(frozen=True)
class Track:
    """Written tables: ``points`` (cleaned), ``rejected``, ``laps`` (with the consensus' measures), ``line``, ``matched``, ``profile``; and the line's length."""

    points: DataFrame
    rejected: DataFrame
    laps: DataFrame
    line: DataFrame
    matched: DataFrame
    profile: DataFrame
    length_m: float
    gate: Gate
    rounds: int
    converged: bool


def reconstruct(points: DataFrame, gate: Gate, rules: consensus.Rules = consensus.Rules(), step_m: float = 5.0) -> Track:
    """The whole way from points to a track; each table is written once and the next are computed from it.

    Excursions are removed, laps found at the gate and checked, the line built
    from the valid laps, and all valid laps' points matched to it with their
    progress as guess. The profile holds quantiles over laps of the analysis
    speed every ``step_m`` along the line. Points whose run has no valid lap are
    kept in ``points`` only; no valid lap at all is an error.
    """
    kept, rejected = telemetry.clean(telemetry.kinematics(points))
    rejected = stage(rejected, "track-rejected")
    # the gate is projected with the points, so that both have the same origin
    placed = geo.with_local_xy(kept.withColumn("__gate_lat", F.lit(gate.latitude_deg)).withColumn("__gate_lon", F.lit(gate.longitude_deg)))
    placed = stage(placed.drop("__gate_lat", "__gate_lon"), "track-points")
    one = placed.where("latitude_deg IS NOT NULL").select("latitude_deg", "longitude_deg", "x_m", "y_m").first()
    if one is None:
        raise ValueError("no point has a position")
    per_degree = geo.EARTH_RADIUS_M * 3.141592653589793 / 180
    # x and y are linear in the degrees, so two numbers of one point place the gate
    lat0 = one["latitude_deg"] - one["y_m"] / per_degree
    gate_y = (gate.latitude_deg - lat0) * per_degree
    scale = placed.select(F.cos(F.radians(F.lit(lat0))).alias("c")).first()["c"] * per_degree
    gate_x = one["x_m"] + (gate.longitude_deg - one["longitude_deg"]) * scale
    crossings = telemetry.gate_crossings(placed, gate_x, gate_y, gate.radius_m, gate.minimum_lap_s)
    table, members = telemetry.laps(placed, crossings)
    key = F.concat_ws("/", *telemetry.SEGMENT, "lap_id").alias("lap")
    table = stage(table.select(key, "*"), "track-lap-table")
    members = stage(members.select(key, "*").join(table.where("valid").select("lap"), "lap", "left_semi"), "track-members")
    found = consensus.consensus(members, "lap", "row_index", rules)
    xy = found.line.orderBy("node").select("x_m", "y_m").toPandas().to_numpy(float)  # MOST_NODES at most
    length = float(consensus._along(xy, True)[-1])
    share = (F.col("row_index") - F.col("start")) / F.greatest(F.lit(1), F.col("end") - F.col("start"))
    matched = telemetry.project(members.withColumn("guess_m", share * length), found.line, "guess_m").withColumn("s_m", F.pmod("s_m", F.lit(length)))
    matched = stage(matched.drop("guess_m"), "track-matched")
    errors = matched.groupBy("lap").agg(F.median("map_error_m").alias("median_map_error_m"), F.percentile("map_error_m", 0.95).alias("p95_map_error_m"), F.max("map_error_m").alias("maximum_map_error_m"))
    laps = stage(table.join(found.laps, "lap", "left").join(errors, "lap", "left"), "track-laps")
    inside = matched.join(laps.where("included").select("lap"), "lap", "left_semi")
    profile = stage(profiles.profile_over_laps(inside, "lap", "s_m", "analysis_speed_mps", step_m), "track-profile")
    return Track(placed, rejected, laps, found.line, matched, profile, length, gate, found.rounds, found.converged)


def publish_track(spark: SparkSession, root: str, track: Track, about: Mapping[str, Any] | None = None) -> int:
    """All tables of a track and its bundle, seen together or not at all."""
    counts = track.laps.agg(F.count(F.lit(1)).alias("laps"), F.count_if("valid").alias("valid"), F.count_if(F.coalesce("included", F.lit(False))).alias("included")).first()
    bundle = {
        "schema_version": SCHEMA_VERSION, "length_m": track.length_m, "nodes": track.line.count(), "laps": counts["laps"], "valid_laps": counts["valid"], "included_laps": counts["included"],
        "gate": {"latitude_deg": track.gate.latitude_deg, "longitude_deg": track.gate.longitude_deg, "radius_m": track.gate.radius_m}, "rounds": track.rounds, "converged": track.converged, "about": dict(about or {}),
    }
    tables = {n: getattr(track, n) for n in ("points", "rejected", "laps", "line", "matched", "profile")}
    return publish.publish(spark, root, tables, {"bundle": bundle})


def read_bundle(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Any]:
    """The bundle of a published track, checked: its checksum, its schema's version, and that its line has the nodes it names."""
    bundle = publish.read_document(spark, root, "bundle", version)
    if bundle.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"{root}: a bundle of schema {bundle.get('schema_version')}, {SCHEMA_VERSION} is read")
    nodes = publish.read_table(spark, root, "line", version).count()
    if nodes != bundle["nodes"]:
        raise ValueError(f"{root}: the line has {nodes} nodes, the bundle names {bundle['nodes']}")
    return bundle
