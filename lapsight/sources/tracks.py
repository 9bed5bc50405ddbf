"""Recorded tracks: GPX documents to canonical points, with counts of what was left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Explicit, so that a document with entities fails instead of being inferred.
GPX_TRACK = (
    "name string, trkseg array<struct<trkpt: array<struct<_lat: string, _lon: string, ele: string, time: string, speed: string, course: string, "
    "sat: string, hdop: string, vdop: string, pdop: string, fix: string, extensions: string>>>>"
)


@dataclass
class Ingested:
    points: DataFrame
    rejected: DataFrame
    summary: DataFrame


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """One row per track point, as text, with file, track, segment and point numbers.

    Routes and waypoints are not tracks and are not read. FAILFAST: documents
    that cannot be parsed, or that use entities, are an error.
    """
    tracks = (
        spark.read.format("xml").option("rowTag", "trk").option("mode", "FAILFAST").option("ignoreNamespace", "true").schema(GPX_TRACK).load(path)
    )
    order = Window.partitionBy("source_file").orderBy("__t")
    placed = tracks.select(F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("__t"), "trkseg")
    numbered = placed.withColumn("track_index", F.row_number().over(order) - 1)
    segments = numbered.select("source_file", "track_index", F.posexplode("trkseg").alias("segment_index", "seg"))
    points = segments.select("source_file", "track_index", "segment_index", F.posexplode("seg.trkpt").alias("point_index", "p"))
    return points.select("source_file", "track_index", "segment_index", "point_index", "p.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("source_sha256"), "length")


def canonical_points(raw: DataFrame, run_id: str, vehicle_id: str = "", driver_id: str = "") -> Ingested:
    """Typed points; points without a usable position are rejected, not dropped unseen.

    Naive times count as UTC. ``summary`` counts positions rejected, times
    missing, times that cannot be read, and naive times.
    """
    number = lambda c: F.col(c).try_cast("double")
    time = F.trim("time")
    typed = raw.select(
        F.lit(run_id).alias("run_id"),
        F.lit(vehicle_id).alias("vehicle_id"),
        F.lit(driver_id).alias("driver_id"),
        "source_file",
        F.lit("gpx").alias("source_format"),
        "track_index",
        "segment_index",
        "point_index",
        F.try_to_timestamp(time).alias("timestamp_utc"),
        number("_lat").alias("latitude_deg"),
        number("_lon").alias("longitude_deg"),
        number("ele").alias("elevation_m"),
        F.lit(None).cast("double").alias("device_distance_m"),
        F.lit(None).cast("double").alias("device_speed_mps"),
        F.coalesce(number("speed"), F.regexp_extract("extensions", r"speed>\s*([-+0-9.eE]+)\s*<", 1).try_cast("double")).alias("reported_speed_mps"),
        number("course").alias("course_deg"),
        F.col("fix").alias("fix_type"),
        F.col("sat").try_cast("int").alias("satellites"),
        number("hdop").alias("hdop"),
        number("vdop").alias("vdop"),
        number("pdop").alias("pdop"),
        (F.coalesce(time, F.lit("")) == "").alias("__missing"),
        (~time.rlike(r"(Z|[+-]\d\d:?\d\d)$")).alias("__naive"),
    )
    usable = F.col("latitude_deg").between(-90, 90) & F.col("longitude_deg").between(-180, 180)
    ok = F.coalesce(usable, F.lit(False))
    summary = typed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(~ok).alias("invalid_positions"),
        F.count_if(F.col("__missing")).alias("missing_times"),
        F.count_if(~F.col("__missing") & F.col("timestamp_utc").isNull()).alias("invalid_times"),
        F.count_if(F.col("__naive") & F.col("timestamp_utc").isNotNull()).alias("naive_times"),
    )
    kept = typed.drop("__missing", "__naive")
    return Ingested(kept.where(ok), kept.where(~ok).withColumn("reason", F.lit("invalid_position")), summary)


def optional_channels(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names; the first alias that is there is taken, text booleans become 0 and 1."""
    yes, no = ("true", "yes", "on"), ("false", "no", "off")
    out = rows
    for name, others in aliases.items():
        there = [c for c in [name, *others] if c in rows.columns]
        if there:
            text = F.lower(F.trim(F.col(there[0]).cast("string")))
            out = out.withColumn(name, F.when(text.isin(*yes), 1.0).when(text.isin(*no), 0.0).otherwise(text.try_cast("double")))
    return out


def clean_fixes(points: DataFrame, keys: list[str], ts: str, values: list[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows with one row per time of a key, the medians of its values; and per key the counts of what was left out.

    A row that is not valid, or has no time, is left out; ``repeated`` counts the
    rows that were joined to another of the same time.
    """
    marked = points.withColumn("__ok", F.coalesce(valid, F.lit(False)) & F.col(ts).isNotNull())
    kept = marked.where("__ok").groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("fixes"), *[F.median(v).alias(v) for v in values])
    all_rows = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("__ok")).alias("invalid"))
    joined = kept.groupBy(F.struct(*keys).alias("__k")).agg(F.sum(F.col("fixes") - 1).alias("repeated"))
    counts = all_rows.withColumn("__k", F.struct(*keys)).join(joined, "__k", "left").drop("__k").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    return kept, counts


def migrated_anchors(rows: DataFrame, aliases: dict[str, list[str]], needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Anchors from a table with other headers, and the rows that cannot be taken, with the reason.

    A header counts whatever its case and with spaces or dashes for underscores;
    the first alias that is there is taken. Rows that lack a needed value, or
    whose position is no position, are rejected with the missing column's name
    or ``invalid_position``. A needed column without any alias is an error.
    """
    plain = {c.strip().lower().replace(" ", "_").replace("-", "_"): c for c in reversed(rows.columns)}
    out = {}
    for name, others in aliases.items():
        there = [plain[a] for a in [name, *others] if a in plain]
        if there:
            text = F.trim(F.col(f"`{there[0]}`").cast("string"))
            out[name] = F.when(text != "", text)
        elif name in needed:
            raise ValueError(f"no column for {name}; there are {', '.join(rows.columns)}")
    named = rows.select(*[c.alias(n) for n, c in out.items()])
    lat, lon = (F.col(c).try_cast("double") if c in out else F.lit(None).cast("double") for c in ("latitude_deg", "longitude_deg"))
    sound = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    reason = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(f"no {n}")) for n in needed], F.when(~sound, F.lit("invalid_position")))
    judged = named.withColumn("reason", reason)
    typed = judged.where("reason IS NULL").drop("reason").withColumn("latitude_deg", lat).withColumn("longitude_deg", lon)
    return typed, judged.where("reason IS NOT NULL")


def extension_values(xml: Column) -> Column:
    """The leaf elements of an extensions text as a map from prefixed names to their texts, in order; of a repeated name the first counts.

    Attributes and elements that hold others are not leaves, and a name keeps
    its prefix, so equal names of two makers stay apart.
    """
    pattern = r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>\s*([^<>]+?)\s*</\1\s*>"
    names, texts = F.regexp_extract_all(xml, F.lit(pattern), 1), F.regexp_extract_all(xml, F.lit(pattern), 2)
    pairs = F.zip_with(names, texts, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.aggregate(
        pairs,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))),
    )
