"""Queries of intervals around a course: mean quantities by part as traces, nations as features and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import zones
from lapsight.plans.registry import query, rounded, table

LENGTH = 1000.0

_FEATURES = "f AS (SELECT n_name AS name, n_nationkey * 40.0 AS fa, n_nationkey * 40.0 + 30 + n_regionkey * 20 AS fb FROM nation)"
_TRACE = """t AS (SELECT l_suppkey AS k, l_partkey * 7 % 1000 AS s, avg(l_quantity) AS v, avg(1 / l_quantity) AS p FROM lineitem GROUP BY ALL),
g AS (SELECT k, s AS s0, v AS v0, p AS p0, lead(s) OVER w AS s1, lead(v) OVER w AS v1, lead(p) OVER w AS p1 FROM t WINDOW w AS (PARTITION BY k ORDER BY s))"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 intervals of 30 to 110 m; neighbours overlap and the last goes over the finish."""
    c = F.col
    return table(spark, sf_dir, "nation").select(
        c("n_name").alias("name"), (c("n_nationkey") * 40.0).alias("fa"), F.pmod(c("n_nationkey") * 40.0 + 30 + c("n_regionkey") * 20, F.lit(LENGTH)).alias("fb")
    )


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.col("l_partkey") * 7 % 1000).alias("s")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), place).agg(F.avg("l_quantity").alias("v"), F.avg(1 / F.col("l_quantity")).alias("p"))


@query(
    "feature_totals",
    f"""
WITH {_FEATURES}, {_TRACE},
u AS (SELECT name, fa, fb, fa AS origin FROM f UNION ALL SELECT name, fa - 1000, fb - 1000, fa - 1000 FROM f),
c AS (SELECT *, greatest(s0, fa) AS a, least(s1, fb) AS b FROM g JOIN u ON s0 < fb AND s1 > fa AND s1 > s0),
y AS (SELECT k, name, a, b, a - origin AS away,
      v0 + (a - s0) / (s1 - s0) * (v1 - v0) AS va, v0 + (b - s0) / (s1 - s0) * (v1 - v0) AS vb, p0 + (a - s0) / (s1 - s0) * (p1 - p0) AS pa, p0 + (b - s0) / (s1 - s0) * (p1 - p0) AS pb FROM c WHERE b > a)
SELECT k, name, round(sum(CAST(b - a AS DOUBLE)), 4) + 0.0 AS length_m, round(sum((b - a) * (pa + pb) / 2), 4) + 0.0 AS time_s, round(arg_min(va, away), 4) + 0.0 AS entry,
       round(arg_max(vb, away), 4) + 0.0 AS exit, round(min(least(va, vb)), 4) + 0.0 AS least, round(max(greatest(va, vb)), 4) + 0.0 AS greatest FROM y GROUP BY ALL""",
)
def feature_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = zones.cut_segments(_traces(spark, sf_dir), ["k"], "s", ["v", "p"], _features(spark, sf_dir), "name", "fa", "fb", LENGTH)
    return rounded(zones.interval_totals(pieces, ["k", "name"], {"time_s": "p"}, "v"), 4)


@query(
    "zone_metrics",
    f"""
WITH {_FEATURES},
e AS (SELECT user_id, event_id * 37 % 5000 / 5.0 AS s, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events)
SELECT name, user_id, count(*) AS rows, round(median(v), 4) + 0.0 AS middle, round(avg(CASE WHEN v IS NOT NULL THEN CAST(v >= 100 AS INTEGER) END), 4) + 0.0 AS high_share,
       round(avg(CAST(v IS NOT NULL AS INTEGER)), 4) + 0.0 AS coverage
FROM e JOIN f ON s BETWEEN fa - 20 AND fb - 20 OR s BETWEEN fa + 980 AND fb + 980 OR s BETWEEN fa - 1020 AND fb - 1020 GROUP BY ALL""",
)
def zone_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v")
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 37 % 5000 / 5.0).alias("s"), value)
    shifted = _features(spark, sf_dir).withColumn("fa", F.col("fa") - 20).withColumn("fb", F.col("fb") - 20)
    members = zones.rows_in_zones(rows, "s", shifted, "fa", "fb", LENGTH)
    return rounded(zones.zone_metrics(members, ["name", "user_id"], {"middle": "v"}, {"high_share": ("v", F.col("v") >= 100)}, {"coverage": "v"}), 4)


_PROFILE = """p AS (SELECT l_returnflag AS k, l_partkey * 7 % 1000 // 3 * 3.0 AS s, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
w AS (SELECT * FROM p UNION ALL SELECT k, max(s) - 1000, arg_max(v, s) FROM p GROUP BY k UNION ALL SELECT k, min(s) + 1000, arg_min(v, s) FROM p GROUP BY k),
l AS (SELECT k, s, v, lead(s) OVER (PARTITION BY k ORDER BY s) AS s1, lead(v) OVER (PARTITION BY k ORDER BY s) AS v1 FROM w)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.floor(F.col("l_partkey") * 7 % 1000 / 3) * 3.0).alias("s")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), place).agg(F.avg("l_quantity").alias("v"))


@query(
    "slowdown_baseline",
    f"""
WITH {_PROFILE},
a AS (SELECT DISTINCT k, CAST(4 * i AS DOUBLE) AS anchor, CAST(r - 40 AS DOUBLE) AS rel FROM p, range(250) x(i), range(51) y(r)),
q AS (SELECT *, CASE WHEN anchor + rel < 0 THEN anchor + rel + 1000 WHEN anchor + rel >= 1000 THEN anchor + rel - 1000 ELSE anchor + rel END AS s FROM a),
z AS (SELECT q.k, anchor, rel, l.v + (q.s - l.s) / (l.s1 - l.s) * (l.v1 - l.v) AS v FROM q ASOF JOIN l ON q.k = l.k AND q.s >= l.s)
SELECT k, anchor AS s, round(median(v) FILTER (rel <= -5), 6) + 0.0 AS approach, round(min(v) FILTER (abs(rel) <= 10), 6) + 0.0 AS local_least,
       round(median(v) FILTER (rel <= -5) - min(v) FILTER (abs(rel) <= 10), 6) + 0.0 AS slowdown FROM z GROUP BY ALL""",
)
def slowdown_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zones.slowdown_baseline(_profiles(spark, sf_dir), ["k"], "s", "v", LENGTH, 4.0, 40.0, 5.0, 10.0, 1.0))


@query(
    "profile_entries",
    """
WITH p AS (SELECT l_suppkey AS k, l_partkey * 7 % 1000 AS s, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
l AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s) AS s1, lead(v) OVER (PARTITION BY k ORDER BY s) AS v1 FROM p),
e AS (SELECT n_name AS name, n_nationkey * 40.5 AS start, 20.0 + n_regionkey AS observed FROM nation),
a AS (SELECT k, name, start, observed FROM e, (SELECT DISTINCT k FROM p)),
x AS (SELECT k, arg_min(v, s) AS first FROM p GROUP BY k),
z AS (SELECT a.*, CASE WHEN l.s IS NULL THEN x.first WHEN l.s1 IS NULL THEN l.v ELSE l.v + (start - l.s) / (l.s1 - l.s) * (l.v1 - l.v) END AS v FROM a ASOF LEFT JOIN l ON a.k = l.k AND a.start >= l.s JOIN x ON x.k = a.k)
SELECT k, name, round(v, 6) + 0.0 AS v, round(v - observed, 6) + 0.0 AS error FROM z""",
)
def profile_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    events = table(spark, sf_dir, "nation").select(c("n_name").alias("name"), (c("n_nationkey") * 40.5).alias("start"), (20.0 + c("n_regionkey")).alias("observed"))
    traces = _traces(spark, sf_dir).withColumn("s", c("s").cast("double"))
    return rounded(zones.profile_entries(events, "start", "observed", traces, "k", "s", "v").select("k", "name", "v", "error"))
