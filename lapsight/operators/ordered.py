"""Exact ranks, places and quantiles of groups of any size.

A group's rows are counted by value, and the distinct values of all groups are
dealt by range of (group, value), so a large group is spread over tasks and no
task orders it whole. The counts with their ranges are written once: every
later step reads the same ranges, whatever is computed again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators.staging import drop, stage


def counted(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column], weight: Column | None = None) -> DataFrame:
    """A written table (__k, __v, n, __part): rows, or sums of ``weight``, per group and value; __k is keys and the value's name ``__of``.

    Rows without a value do not count. Null keys are groups of their own.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum("__w")
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("__of"), c.alias("__v")) for name, c in values.items()]))
    given = rows.select(*keys, each, (F.lit(1) if weight is None else weight).alias("__w")).where("__v is not null")
    counts = given.groupBy(F.struct(*keys, "__of").alias("__k"), "__v").agg(n.alias("n"))
    return stage(counts.repartitionByRange("__k", "__v").withColumn("__part", F.spark_partition_id()), "ordered")


def _ranges(counts: DataFrame) -> DataFrame:
    """(__k, __part, __m, __start, __total): a row per group and range that it has rows in."""
    group = Window.partitionBy("__k")  # at most as many rows as ranges
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("__k", "__part").agg(F.sum("n").alias("__m"))
    return sums.withColumn("__start", F.coalesce(F.sum("__m").over(earlier), F.lit(0))).withColumn("__total", F.sum("__m").over(group))


def _inside(counts: DataFrame) -> DataFrame:
    """``counts`` with __less, the rows of smaller values in the same group and range."""
    before = Window.partitionBy("__k", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__less", F.coalesce(F.sum("n").over(before), F.lit(0)))


def running_counts(counts: DataFrame) -> DataFrame:
    """(__k, __v, n, below, total, __part) of a table of counted(): the rows of smaller values and of the group."""
    placed = _inside(counts).join(_ranges(counts), ["__k", "__part"])
    return placed.select("__k", "__v", "n", (F.col("__start") + F.col("__less")).alias("below"), F.col("__total").alias("total"), "__part")


def with_average_ranks(rows: DataFrame, keys: Sequence[str], named: Mapping[str, str]) -> DataFrame:
    """Per entry (value, name): rank from 1 among the group's values; equal values share the mean of their ranks.

    Rows without one of the values go. The rows are read twice: once to count
    all values, which are ranked together, and once to join each value's ranks.
    """
    complete = rows.dropna(subset=list(named)).select("*", *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(named)])
    counts = counted(complete, keys, {v: F.col(f"__v{i}") for i, v in enumerate(named)})
    ranks = stage(running_counts(counts).select("__k", "__v", (F.col("below") + (F.col("n") + 1) / 2.0).alias("__rank")), "ranks")
    drop(counts)
    out = complete
    for i, (value, name) in enumerate(named.items()):
        own = ranks.where(F.col("__k.__of") == value).select("__k", F.col("__v").alias(f"__v{i}"), F.col("__rank").alias(name))
        out = out.withColumn("__k", F.struct(*keys, F.lit(value).alias("__of"))).join(own, ["__k", f"__v{i}"]).drop("__k", f"__v{i}")
    return out


def quantiles_of(counts: DataFrame, keys: Sequence[str], points: Mapping[str, tuple[str, float]]) -> DataFrame:
    """quantiles() of a table of counted(); only the ranges that hold a wanted place are put in order."""
    wanted = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(of).alias("of"), F.lit(float(p)).alias("share")) for n, (of, p) in points.items()])
    place = F.col("__p.share") * (F.col("__total") - 1)
    ends = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("__at")
    asked = _ranges(counts).withColumn("__p", F.explode(wanted)).where(F.col("__p.of") == F.col("__k.__of"))
    asked = asked.select("__k", "__part", "__start", "__m", F.col("__p.point").alias("__point"), place.alias("__place"), ends)
    asked = asked.where((F.col("__start") <= F.col("__at")) & (F.col("__at") < F.col("__start") + F.col("__m")))
    needed = asked.groupBy("__k", "__part").agg(F.collect_list(F.struct("__start", "__point", "__place", "__at")).alias("__asked"))  # two places to a point
    met = _inside(counts.join(needed, ["__k", "__part"])).select("__k", "__v", "n", "__less", F.inline("__asked"))
    within = F.col("__at") - F.col("__start")
    hit = met.where((F.col("__less") <= within) & (within < F.col("__less") + F.col("n")))
    above = F.col("__place") - F.floor("__place")
    share = F.when(F.col("__at") == F.floor("__place"), 1 - above).otherwise(above)
    one = hit.groupBy("__k", "__point").agg(F.sum(F.col("__v") * share).alias("__q")).select("__k.*", "__point", "__q")
    return one.groupBy(*keys).agg(*[F.max(F.when(F.col("__point") == n, F.col("__q"))).alias(n) for n in points])


#: A sketch's places are exact to 1 / SKETCH of a group's rows; what lies within this share of a group's rows around a wanted place counts by value.
SKETCH = 1_000
NEAR = 5e-3
#: Groups of up to so many values count by value whole.
SMALL = 5_000


def quantiles(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column], points: Mapping[str, tuple[str, float]]) -> DataFrame:
    """(keys, one column per point): exact quantiles, interpolated between neighbours; a point names one of ``values`` and a share.

    ``rows`` are read again and again: a sketch of each group tells two values between
    which a wanted place lies, then the rows below them are counted and those
    between them counted by value, so that few rows are shuffled. Rows that are
    costly to compute are best written before. Should a
    sketch be too far off, all rows are counted by value. A group without any
    value has no row, a point without values is null. The result is a written
    table.
    """
    named = list(values)
    given = rows.select(F.struct(*keys).alias("__k") if keys else F.struct(F.lit(0).alias("__one")).alias("__k"), *[c.cast("double").alias(f"__v{i}") for i, c in enumerate(values.values())])
    asked = {n: (named.index(of), float(p)) for n, (of, p) in points.items()}
    shares = {i: sorted({p for j, p in asked.values() if j == i}) for i in range(len(named))}
    ends = {i: [min(1.0, max(0.0, p + d)) for p in ps for d in (-NEAR, NEAR)] for i, ps in shares.items() if ps}
    sketches = [F.percentile_approx(f"__v{i}", F.array(*map(F.lit, e)), F.lit(SKETCH)).alias(f"__e{i}") for i, e in ends.items()]
    around = stage(given.groupBy("__k").agg(*[F.count(f"__v{i}").alias(f"__n{i}") for i in range(len(named))], *sketches), "around")

    def bounds(i: int, p: float) -> Column:
        """Values around a place; null on a side that the group's end is near to."""
        at, small = 2 * shares[i].index(p), F.col(f"__n{i}") <= SMALL
        low = F.when(~small & F.lit(p > NEAR), F.col(f"__e{i}")[at])
        high = F.when(~small & F.lit(p < 1 - NEAR), F.col(f"__e{i}")[at + 1])
        return F.struct(low.alias("low"), high.alias("high"))

    wide = given.join(around.select("__k", *[bounds(i, p).alias(f"__b_{n}") for n, (i, p) in asked.items()]), "__k")
    less = wide.groupBy("__k").agg(*[F.count_if(F.col(f"__v{i}") < F.col(f"__b_{n}.low")).alias(f"__l_{n}") for n, (i, _) in asked.items()])
    inside = {n: F.coalesce(F.col(f"__v{i}") >= F.col(f"__b_{n}.low"), F.lit(True)) & F.coalesce(F.col(f"__v{i}") <= F.col(f"__b_{n}.high"), F.lit(True)) for n, (i, _) in asked.items()}
    entries = [F.struct(F.lit(n).alias("__point"), F.when(inside[n], F.col(f"__v{i}")).alias("__v")) for n, (i, _) in asked.items()]
    met = wide.where(reduce(or_, inside.values())).select("__k", F.inline(F.array(*entries))).where("__v is not null")
    near = met.groupBy("__k", "__point", "__v").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__k", "__point").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)  # few values, in order
    counted_near = near.withColumn("__less", F.coalesce(F.sum("n").over(before), F.lit(0)))
    below = less.select("__k", F.inline(F.array(*[F.struct(F.lit(n).alias("__point"), F.col(f"__l_{n}").alias("__below")) for n in asked])))
    sizes = F.inline(F.array(*[F.struct(F.lit(n).alias("__point"), F.col(f"__n{i}").alias("__n"), F.lit(p).alias("__share")) for n, (i, p) in asked.items()]))
    joined = counted_near.join(around.select("__k", sizes), ["__k", "__point"]).join(below, ["__k", "__point"]).withColumn("__less", F.col("__below") + F.col("__less"))
    at = F.col("__share") * (F.col("__n") - 1)
    first, above = F.floor(at), at - F.floor(at)
    holds = lambda k: ((F.col("__less") <= k) & (k < F.col("__less") + F.col("n"))).cast("int")
    weight = F.when(holds(first) == 1, 1 - above).otherwise(0.0) + F.when((holds(F.ceil(at)) == 1) & (above > 0), above).otherwise(0.0)
    hits = joined.where((holds(first) == 1) | (holds(F.ceil(at)) == 1))
    each = hits.groupBy("__k", "__point").agg(F.sum(F.col("__v") * weight).alias("__q"), F.sum(holds(first) + holds(F.ceil(at))).alias("__hits"))
    wanted = around.select("__k", sizes).where("__n > 0").select("__k", "__point")
    flat = stage(wanted.join(each, ["__k", "__point"], "left"), "points")
    if flat.where("__hits is null or __hits < 2").limit(1).count():
        drop(around, flat)
        counts = counted(rows, keys, {n: c.cast("double") for n, c in values.items()})
        found = stage(quantiles_of(counts, keys, points), "quantiles")
        drop(counts)
        return found
    out = flat.groupBy("__k").agg(*[F.max(F.when(F.col("__point") == n, F.col("__q"))).alias(n) for n in points])
    found = stage(out.select(*[F.col(f"__k.{k}").alias(k) for k in keys], *points), "quantiles")
    drop(around, flat)
    return found


def values_at(counts: DataFrame, asked: DataFrame, place: str) -> DataFrame:
    """``asked`` rows (with their group ``__k``) and the value ``__v`` that stands at row number ``place`` (from 0) of the group's order.

    Values and asked places of a range are put in one order, and each place
    takes the last value before it, so no join by ranges is needed.
    """
    own = [c for c in asked.columns if c != "__k"]
    ranges = _ranges(counts).groupBy("__k").agg(F.array_sort(F.collect_list(F.struct((F.col("__start") + F.col("__m")).alias("__end"), "__part"))).alias("__ends"))
    found = F.get(F.filter("__ends", lambda e: e["__end"] > F.col(place)), F.lit(0))["__part"]
    packed = asked.select("__k", F.col(place), F.struct(*own).alias("__row")).join(ranges, "__k")
    questions = packed.select("__k", found.alias("__part"), (F.col(place) + F.lit(0.5)).alias("__at"), F.lit(None).cast(counts.schema["__v"].dataType).alias("__v"), "__row")
    nothing = F.lit(None).cast(packed.schema["__row"].dataType)
    answers = running_counts(counts).select("__k", "__part", F.col("below").cast("double").alias("__at"), "__v", nothing.alias("__row"))
    w = Window.partitionBy("__k", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = answers.unionByName(questions).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__row is not null").select("__k", "__row.*", "__v")


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their number (from 1) in one order of all rows, dealt by range of the order; a written table.

    Only the number of rows of each range comes to the driver.
    """
    w = Window.partitionBy("__part").orderBy(*order)
    dealt = stage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__own", F.row_number().over(w)), "numbered")
    starts, upto = {}, 0
    for r in sorted(dealt.groupBy("__part").agg(F.max("__own").alias("n")).collect()):
        starts[r["__part"]] = upto
        upto += r["n"]
    before = F.coalesce(*[F.when(F.col("__part") == p, F.lit(s)) for p, s in starts.items()], F.lit(0)) if starts else F.lit(0)
    return dealt.withColumn(name, (before + F.col("__own")).cast("long")).drop("__part", "__own")
