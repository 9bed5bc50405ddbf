"""Places along a closed course: unwrapped progress, curvature, map errors, endpoints, design points and bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.functions import circular, text
from lapsight.operators import series


def unwrapped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], place: str, length: float, to: str, slack: float = 3.0) -> DataFrame:
    """``place`` in [0, length) plus the fewest whole lengths, none negative, that keep it from falling more than ``slack``.

    A row takes one length more or less than the row before, or as many; the
    running sum of these steps, raised by its lowest value below 0, is the
    number of lengths.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    at, before = F.col(place), F.lag(place).over(w)
    step = F.when(at < before - slack, 1).when(at - length >= before - slack, -1).otherwise(0)
    walked = rows.withColumn("__step", step).withColumn("__sum", F.sum("__step").over(upto))
    laps = F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(upto))
    return walked.withColumn(to, at + length * laps).drop("__step", "__sum")


def slope(rows: DataFrame, keys: Sequence[str], axis: str, value: str, to: str) -> DataFrame:
    """Slope on an uneven axis, second order everywhere: at the ends from three rows. Null for fewer than three rows."""
    w = Window.partitionBy(*keys).orderBy(axis)
    x, y = (lambda k: F.lead(axis, k).over(w)), (lambda k: F.lead(value, k).over(w))

    def through(i: int, at: int) -> Column:
        """Slope in row ``at`` of the parabola through rows i, i + 1 and i + 2."""
        a, b, c = x(i), x(i + 1), x(i + 2)
        here = x(at)
        return (
            y(i) * ((here - b) + (here - c)) / ((a - b) * (a - c))
            + y(i + 1) * ((here - a) + (here - c)) / ((b - a) * (b - c))
            + y(i + 2) * ((here - a) + (here - b)) / ((c - a) * (c - b))
        )

    return rows.withColumn(to, F.coalesce(through(-1, 0), through(0, 0), through(-2, 0)))


def curvature(rows: DataFrame, keys: Sequence[str], axis: str, x: str, y: str, to: str = "curvature") -> DataFrame:
    """Signed curvature of a line given by x and y along an axis; null where the line stands still."""
    first = slope(slope(rows, keys, axis, x, "__dx"), keys, axis, y, "__dy")
    second = slope(slope(first, keys, axis, "__dx", "__ddx"), keys, axis, "__dy", "__ddy")
    speed = F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")
    turn = F.col("__dx") * F.col("__ddy") - F.col("__dy") * F.col("__ddx")
    return second.withColumn(to, F.try_divide(turn, F.pow(speed, F.lit(1.5)))).drop("__dx", "__dy", "__ddx", "__ddy")


def map_errors(matched: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, place: str, back: float = 20.0) -> DataFrame:
    """Per key: median, 95 % quantile and maximum of the error, and steps back of more than ``back``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    q = F.percentile(error, F.array(F.lit(0.5), F.lit(0.95)))
    step = matched.withColumn("__step", F.col(place) - F.lag(place).over(w))
    out = step.groupBy(*keys).agg(q.alias("q"), F.max(error).alias("worst"), F.count_if(F.col("__step") < -back).alias("steps_back"))
    return out.select(*keys, F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "worst", "steps_back")


def share_above(samples: DataFrame, grid: DataFrame, keys: Sequence[str], axis: str, value: str, limit: float) -> DataFrame:
    """Per key, the share of grid nodes whose interpolated value is above ``limit``."""
    at = series.interpolate(samples, grid, keys, axis, value)
    return at.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.avg((F.col(value) > limit).cast("double")).alias("share"))


def uniform_share_above(samples: DataFrame, keys: Sequence[str], axis: str, value: str, step: float, limit: float) -> DataFrame:
    """Per key, ``share_above`` of the nodes that lie ``step`` apart from the first to the last place.

    Nodes before the first sample with a value do not count, those after the
    last one have its value. No node is written out: between two samples the
    interpolated value moves one way only, rounding included, so the first and
    the last node tell which side of the limit they are on, and bisection finds
    where the side changes. The work grows with the samples, however long the
    course is.
    """
    group = Window.partitionBy(*keys)
    placed = samples.select(*keys, F.col(axis).cast("double").alias("__x"), F.col(value).alias("__y"))
    placed = placed.withColumns({"__lo": F.min("__x").over(group), "__hi": F.max("__x").over(group)}).where("__x is not null and __y is not null")
    after = F.lead(F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"))).over(group.orderBy("__x"))
    node = lambda k: F.col("__lo") + step * k

    def first_from(x: Column) -> Column:
        """Number of the first node that does not lie before x."""
        k = F.ceil((x - F.col("__lo")) / step)
        return F.when(node(k) < x, k + 1).when(node(k - 1) >= x, k - 1).otherwise(k)

    def above(k: Column) -> Column:
        share = (node(k) - F.col("__x")) / (F.col("__b.x") - F.col("__x"))
        between = F.col("__y") + share * (F.col("__b.y") - F.col("__y"))
        return F.when(F.col("__b").isNull() | (node(k) == F.col("__x")), F.col("__y")).otherwise(between) > limit

    last = F.floor((F.col("__hi") - F.col("__lo")) / step) + 1
    parts = placed.withColumn("__b", after).withColumn("__from", first_from(F.col("__x")))
    parts = parts.withColumn("__to", F.when(F.col("__b").isNull(), last).otherwise(first_from(F.col("__b.x")))).where("__to > __from")
    parts = parts.withColumns({"__n": F.col("__to") - F.col("__from"), "__a": above(F.col("__from")), "__z": above(F.col("__to") - 1)})

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2)
        same = above(middle) == F.col("__a")
        return F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle).alias("high"))

    ends = F.struct(F.col("__from").alias("low"), (F.col("__to") - 1).alias("high"))
    alike = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2("__n")).cast("int")), ends, halved, lambda s: s["low"] - F.col("__from") + 1)
    counted = F.when(F.col("__a") == F.col("__z"), F.when(F.col("__a"), F.col("__n")).otherwise(0)).when(F.col("__a"), alike).otherwise(F.col("__n") - alike)
    return parts.withColumn("__above", counted).groupBy(*keys).agg(F.sum("__n").alias("nodes"), (F.sum("__above") / F.sum("__n")).alias("share"))


def close_candidates(candidates: DataFrame, keys: Sequence[str], error: str, uncertainty: str, least: float = 3.0) -> DataFrame:
    """Candidates whose error is at most the smallest of their keys plus the larger of ``least`` and their uncertainty."""
    smallest = F.min(error).over(Window.partitionBy(*keys))
    return candidates.withColumn("__least", smallest).where(F.col(error) <= F.col("__least") + F.greatest(F.lit(least), F.col(uncertainty))).drop("__least")


def nearest_endpoint(candidates: DataFrame, event: str, place: str, error: str, anchor: str, length: float) -> DataFrame:
    """Per event the one candidate of least error, then least way to the anchor, then least place."""
    away = circular.shortest(F.col(place), F.col(anchor), length)
    best = F.min(F.struct(F.col(error).alias("e"), away.alias("away"), F.col(place).alias("s")))
    return candidates.groupBy(event).agg(best.alias("b")).select(event, F.col("b.s").alias(place), F.col("b.e").alias(error), "b.away")


def design_points(inputs: DataFrame, path: str, nominal: str, levels: str, apart: float = 1e-14) -> DataFrame:
    """(path, level, value): the nominal as level 0 and every other value of the array ``levels`` that is not within ``apart`` of one before."""
    all_ = F.concat(F.array(F.col(nominal)), F.filter(F.coalesce(levels, F.array().cast("array<double>")), lambda v: v.isNotNull()))
    kept = F.aggregate(
        all_, F.array().cast("array<double>"), lambda done, v: F.when(F.exists(done, lambda d: F.abs(d - v) <= apart), done).otherwise(F.concat(done, F.array(v)))
    )
    return inputs.select(path, F.posexplode(kept).alias("level", "value"))


def sweep(low: Column, high: Column, steps: Column) -> Column:
    """``steps`` equally spaced values from low to high; the low one only for one step."""
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda i: low + (high - low) * F.coalesce(F.try_divide(i, steps - 1), F.lit(0.0)))


def normalised_events(records: DataFrame, key: str, nested: str) -> DataFrame:
    """One row per record of the array ``nested`` of structs (name, kind, place, flags), in order.

    The id is the name as a slug, or "event" and its number where that leaves
    nothing; ids that come again in a course get the number of their repeat.
    Flags are split, and a missing place is one of them.
    """
    rows = records.select(key, F.posexplode(nested).alias("__i", "r")).withColumn("sequence", F.col("__i") + 1)
    named = F.nullif(text.slug(F.coalesce("r.name", F.lit(""))), F.lit(""))
    rows = rows.withColumn("__id", F.coalesce(named, F.concat(F.lit("event_"), F.col("sequence").cast("string"))))
    again = F.row_number().over(Window.partitionBy(key, "__id").orderBy("sequence"))
    flags = text.merged_flags(text.tokens(F.coalesce("r.flags", F.lit(""))), F.when(F.col("r.place").isNull(), F.array(F.lit("no_place"))))
    return rows.withColumn("__again", again).select(
        key,
        "sequence",
        F.when(F.col("__again") == 1, F.col("__id")).otherwise(F.concat_ws("_", "__id", F.col("__again").cast("string"))).alias("event_id"),
        F.coalesce("r.name", "__id").alias("name"),
        F.lower(F.trim(F.coalesce("r.kind", F.lit("unknown")))).alias("kind"),
        F.col("r.place").alias("place"),
        flags.alias("flags"),
    )


def bundle(courses: DataFrame, key: str, parts: Mapping[str, tuple[DataFrame, Sequence[str]]], version: int = 1) -> DataFrame:
    """(key, bundle, sha256): one JSON document per course, each part an array of its rows in the order of the named columns.

    A course holds its line, features and gates, a few thousand rows; parts
    without rows are empty arrays. The checksum is that of the document's bytes.
    """
    out = courses.select(key)
    for name, (rows, order) in parts.items():
        others = [c for c in rows.columns if c != key and c not in order]
        held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias(name))
        out = out.join(held, key, "left").withColumn(name, F.coalesce(name, F.array()))
    document = F.to_json(F.struct(F.lit(version).alias("version"), F.col(key), *parts))
    return out.select(key, document.alias("bundle")).withColumn("sha256", F.sha2("bundle", 256))


def opened(bundles: DataFrame, key: str, schema: str, version: int = 1) -> DataFrame:
    """``bundles`` with the parsed ``content`` and ``problem``: a wrong checksum, an unreadable document or another version, else null."""
    content = F.from_json("bundle", schema)
    problem = (
        F.when(~F.sha2("bundle", 256).eqNullSafe(F.col("sha256")), "checksum")
        .when(F.col("content").isNull() | F.col("content.version").isNull(), "unreadable")
        .when(F.col("content.version") != version, "version")
    )
    return bundles.withColumn("content", content).withColumn("problem", problem)


def active_gates(content: DataFrame, key: str, gates: str = "content.gates", active: str = "active_by_default") -> DataFrame:
    """Rows of the gates that are active, of sound bundles only."""
    return content.where("problem is null").select(key, F.inline(F.filter(gates, lambda g: F.coalesce(g[active], F.lit(False)))))
