"""Queries of places along a closed course, with other tables' columns as places, errors and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.functions import circular, geo
from lapsight.operators import consensus, course, events, telemetry
from lapsight.operators.staging import dealt
from lapsight.plans.registry import query, rounded, table


@query(
    "segment_summary",
    """
WITH t AS (SELECT user_id, event_id, value, CASE WHEN user_id % 5 = 0 AND event_id % 7 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS t FROM events),
p AS (SELECT *, epoch(t) - epoch(lag(t) OVER (PARTITION BY user_id ORDER BY event_id)) AS dt FROM t)
SELECT user_id AS run_id, count(*) AS points, count(*) FILTER (t IS NULL) AS missing_times, count(*) FILTER (dt = 0) AS same_times, count(*) FILTER (dt < 0) AS regressions,
       count(*) FILTER (dt > 5) AS gaps, round(sum(coalesce(value, 0)), 4) + 0.0 AS path_m, round(median(dt) FILTER (dt > 0), 4) AS median_step_s,
       count(*) FILTER (t IS NULL) = 0 AND count(*) FILTER (dt < 0) = 0 AS monotonic,
       CASE WHEN count(*) FILTER (t IS NULL) = 0 AND count(*) FILTER (dt < 0) = 0 THEN epoch(max(t)) - epoch(min(t)) END AS duration_s
FROM p GROUP BY 1""",
)
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    time = F.when(~((c("user_id") % 5 == 0) & (c("event_id") % 7 == 0)), F.date_trunc("minute", "ts"))
    points = table(spark, sf_dir, "events").select(
        c("user_id").alias("run_id"), F.lit(0).alias("track_index"), F.lit(0).alias("segment_index"), c("event_id").alias("point_index"), time.alias("timestamp_utc"), c("value").alias("step_distance_m")
    )
    w = telemetry.Window.partitionBy(*telemetry.SEGMENT).orderBy("point_index")
    now = telemetry.series.seconds(c("timestamp_utc"))
    out = telemetry.segment_summary(points.withColumn("time_step_s", now - F.lag(now).over(w)))
    return rounded(out.drop("track_index", "segment_index", "first_time", "last_time"), 4)


@query(
    "local_xy",
    """
WITH p AS (SELECT c_custkey, 43 + (c_custkey % 1000) / 1e4 AS lat, -79 + c_acctbal / 1e6 AS lon FROM customer), o AS (SELECT median(lat) AS lat0, median(lon) AS lon0 FROM p)
SELECT c_custkey, round(6371008.8 * radians(lon - lon0) * cos(radians(lat0)), 4) + 0.0 AS x_m, round(6371008.8 * radians(lat - lat0), 4) + 0.0 AS y_m FROM p, o""",
)
def local_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.lit(43) + (F.col("c_custkey") % 1000) / F.lit(1e4), F.lit(-79) + F.col("c_acctbal") / F.lit(1e6)
    points = table(spark, sf_dir, "customer").select("c_custkey", lat.alias("latitude_deg"), lon.alias("longitude_deg"))
    return rounded(geo.with_local_xy(points).select("c_custkey", "x_m", "y_m"), 4)


@query(
    "map_outlier_runs",
    """
WITH r AS (SELECT event_id, user_id, ts, value, coalesce(value >= 40, false) AS far, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, far ORDER BY i) AS g FROM r),
b AS (SELECT user_id, g, min(i) AS a, max(i) AS z FROM g WHERE far GROUP BY ALL HAVING count(*) <= 3)
SELECT x.event_id, round(x.value, 6) AS value FROM b JOIN r p ON p.user_id = b.user_id AND p.i = a - 1 JOIN r q ON q.user_id = b.user_id AND q.i = z + 1
JOIN r x ON x.user_id = b.user_id AND x.i BETWEEN a AND z WHERE p.value <= 20 AND q.value <= 20 AND epoch(q.ts) - epoch(p.ts) <= 1000000""",
)
def map_outlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.bracketed_outliers(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", time="ts", bridge_s=1e6)
    return rounded(out.select("event_id", "value"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as candidate ends: even places may begin its interval, odd ones end it."""
    c = F.col
    kind = F.when(c("l_linenumber") % 2 == 0, "start").otherwise("end")
    place = 2 * c("l_quantity") + c("l_linenumber") % 2
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("endpoint"), place.alias("place"), F.round(100 * c("l_discount")).alias("error"), (c("l_orderkey") % 102).cast("double").alias("anchor"))
    return dealt(lines, ["l_orderkey"]).groupBy("l_orderkey", "endpoint", "place", "anchor").agg(F.min("error").alias("error"))


_ENDS = """
e AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'start' ELSE 'end' END AS endpoint, 2 * l_quantity + l_linenumber % 2 AS place, (l_orderkey % 102)::DOUBLE AS anchor,
             min(round(100 * l_discount)) AS error FROM lineitem GROUP BY ALL)"""


@query(
    "endpoint_pairs",
    f"""
WITH {_ENDS},
p AS (SELECT a.l_orderkey, a.anchor, a.place AS a, a.error AS ea, b.place AS b, b.error AS eb FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.endpoint = 'start' AND b.endpoint = 'end'),
t AS (SELECT l_orderkey, anchor, a AS s, b AS e, ea AS se, eb AS ee, false AS r FROM p UNION ALL SELECT l_orderkey, anchor, b, a, eb, ea, true FROM p),
d AS (SELECT *, (e - s + 102) % 102 AS len, (anchor - s + 204) % 102 AS x, (anchor - e + 204) % 102 AS y FROM t),
c AS (SELECT *, se + ee + 0.05::DOUBLE * (least(x, 102 - x) + least(y, 102 - y)) + CASE WHEN len > 51 THEN 1000.0::DOUBLE ELSE 0 END + CASE WHEN r THEN 1 ELSE 0 END AS score FROM d),
o AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY score, s, e))
SELECT l_orderkey, s AS start, e AS "end", len AS length, se AS start_error, ee AS end_error, r AS reordered, e < s AS wraps, coalesce(nxt - score < 3, false) AS ambiguous FROM o WHERE i = 1""",
)
def endpoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.endpoint_pairs(_ends(spark, sf_dir), "l_orderkey", "place", "error", "anchor", 102.0))


@query(
    "nearest_endpoint",
    f"""
WITH {_ENDS},
c AS (SELECT *, min(error) OVER (PARTITION BY l_orderkey) AS low FROM e), d AS (SELECT *, (place - anchor + 204) % 102 AS x FROM c WHERE error <= low + greatest(3, anchor / 20)),
o AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY error, least(x, 102 - x), place) AS i FROM d)
SELECT l_orderkey, place, error, least(x, 102 - x) AS away, n AS candidates FROM o WHERE i = 1""",
)
def nearest_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = course.close_candidates(_ends(spark, sf_dir).withColumn("sd", F.col("anchor") / 20), ["l_orderkey"], "error", "sd")
    best = course.nearest_endpoint(close, "l_orderkey", "place", "error", "anchor", 102.0)
    return rounded(best.join(close.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("candidates")), "l_orderkey"))


@query(
    "response_groups",
    """
WITH e AS (SELECT user_id, event_id, event_type, value, coalesce(event_type = 'error', false) AS bad FROM events)
SELECT user_id, count(*) AS events, arg_min(event_type, event_id) AS name, round(arg_min(value, event_id), 6) AS first_anchor_s, round(arg_max(value, event_id), 6) AS last_anchor_s,
       round(min(-value), 6) AS start_rel, round(max(2 * value), 6) AS end_rel, bool_or(bad) AS gate_candidate, round(max(value / 10), 6) AS error_m,
       string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS event_ids, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS flags,
       round(((arg_max(value, event_id) - arg_min(value, event_id)) % 100 + 100) % 100, 6) AS span FROM e GROUP BY 1""",
)
def response_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_id").alias("sequence"), F.col("event_type").alias("name"), v.alias("anchor_s"), (-v).alias("start_rel"), (2 * v).alias("end_rel"),
        F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("gate_candidate"), (v / 10).alias("error_m"), F.array("event_type").alias("flags"),
    )
    joined = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    out = events.response_groups(rows, "user_id", 100.0)
    return rounded(out.select(*[joined(n) if n in ("event_ids", "flags") else n for n in out.columns]))


@query(
    "unwrapped_progress",
    """
WITH p AS (SELECT user_id, event_id, (event_id * 37 % 400)::DOUBLE / 4 AS pos FROM events),
d AS (SELECT *, CASE WHEN pos < lag(pos) OVER w - 3 THEN 1 WHEN pos - 100 >= lag(pos) OVER w - 3 THEN -1 ELSE 0 END AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM d)
SELECT user_id, event_id, pos + 100 * (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id))) AS progress FROM s""",
)
def unwrapped_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 37 % 400).cast("double") / 4).alias("at"))
    return rounded(course.unwrapped(places, ["user_id"], ["event_id"], "at", 100.0, "progress").drop("at"))


def _slope_sql(rows: str, value: str, to: str) -> str:
    """The second-order slope, written as weighted differences where the operator takes the parabola through three rows."""
    return f"""(SELECT * EXCLUDE (h0, h1, hb, hf, d0, d1, db, df), coalesce(d1 / h1 * h0 / (h0 + h1) + d0 / h0 * h1 / (h0 + h1), d1 / h1 + (d1 / h1 - df / hf) * h1 / (h1 + hf), d0 / h0 + (d0 / h0 - db / hb) * h0 / (h0 + hb)) AS {to}
FROM (SELECT *, s - lag(s) OVER w AS h0, lead(s) OVER w - s AS h1, lag(s) OVER w - lag(s, 2) OVER w AS hb, lead(s, 2) OVER w - lead(s) OVER w AS hf, {value} - lag({value}) OVER w AS d0,
      lead({value}) OVER w - {value} AS d1, lag({value}) OVER w - lag({value}, 2) OVER w AS db, lead({value}, 2) OVER w - lead({value}) OVER w AS df FROM {rows} WINDOW w AS (PARTITION BY k ORDER BY s)))"""


_LINE = "(SELECT user_id AS k, event_id::DOUBLE AS s, event_id::DOUBLE + 0.001 * (event_id * 7 % 11) AS x, 0.01 * (event_id * 13 % 29)::DOUBLE AS y FROM events)"
_SECOND = _slope_sql(_slope_sql(_slope_sql(_slope_sql(_LINE, "x", "dx"), "y", "dy"), "dx", "ddx"), "dy", "ddy")


@query("course_curvature", f"SELECT k, s, round((dx * ddy - dy * ddx) / nullif(pow(dx * dx + dy * dy, 1.5), 0), 6) + 0.0 AS curvature FROM {_SECOND}")
def course_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    x, y = e.cast("double") + 0.001 * (e * 7 % 11), 0.01 * (e * 13 % 29).cast("double")
    line = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), e.cast("double").alias("s"), x.alias("x"), y.alias("y"))
    return rounded(course.curvature(line, ["k"], "s", "x", "y").select("k", "s", "curvature"))


@query(
    "map_error_stats",
    """
WITH d AS (SELECT user_id, value, (event_id * 37 % 400) / 4.0 - lag((event_id * 37 % 400) / 4.0) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)
SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS worst, count(*) FILTER (d < -20) AS steps_back FROM d GROUP BY 1""",
)
def map_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = table(spark, sf_dir, "events").withColumn("at", (F.col("event_id") * 37 % 400) / 4)
    return rounded(course.map_errors(matched, ["user_id"], ["event_id"], "value", "at"))


@query(
    "uniform_error_share",
    """
WITH g AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1), n AS (SELECT user_id, unnest(range(lo, hi + 1, 25)) AS pos FROM g),
b AS (SELECT n.user_id, pos, a.event_id AS x0, a.value AS y0 FROM n ASOF JOIN (SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL) a ON n.user_id = a.user_id AND n.pos >= a.event_id),
c AS (SELECT b.*, e.event_id AS x1, e.value AS y1 FROM b ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL) e ON b.user_id = e.user_id AND b.pos <= e.event_id)
SELECT user_id, count(*) AS nodes, round(avg((CASE WHEN x1 IS NULL OR x0 = pos THEN y0 ELSE y0 + (pos - x0)::DOUBLE / (x1 - x0) * (y1 - y0) END > 30)::INT), 6) AS share FROM c GROUP BY 1""",
)
def uniform_error_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), "value")
    return rounded(course.uniform_share_above(samples, ["user_id"], "at", "value", 25.0, 30.0))


@query(
    "design_points",
    """
WITH l AS (SELECT p_partkey AS path, p_size::DOUBLE AS nominal, generate_subscripts(v, 1) AS i, unnest(v) AS v FROM (SELECT *, list_prepend(p_size::DOUBLE, list_transform(range(1 + p_partkey % 7), lambda k: 10 + 20 * CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE k::DOUBLE / (p_partkey % 7) END)) AS v FROM part)),
f AS (SELECT path, v, min(i) AS i FROM l GROUP BY ALL)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS level, round(v, 6) AS value FROM f""",
)
def design_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = (1 + F.col("p_partkey") % 7).cast("int")
    inputs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("path"), F.col("p_size").cast("double").alias("nominal"), course.sweep(F.lit(10.0), F.lit(30.0), steps).alias("levels")
    )
    return rounded(course.design_points(inputs, "path", "nominal", "levels"))


@query(
    "interval_expand",
    """
SELECT p_partkey, (p_partkey % 90)::DOUBLE AS start, CASE WHEN e >= p_partkey % 90 THEN e ELSE e + 40 * ceil((p_partkey % 90 - e) / 40) END AS "end"
FROM (SELECT p_partkey, p_size::DOUBLE AS e FROM part)""",
)
def interval_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("p_partkey") % 90).cast("double")
    end = circular.end_after(start, F.col("p_size").cast("double"), F.lit(40.0))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", start.alias("start"), end.alias("end")))


@query(
    "rescaled_shifts",
    """
SELECT p_partkey, round(least(d, 500 - d), 6) + 0.0 AS shift FROM (SELECT p_partkey, ((p_size * 12.5 * 1.25 - p_retailprice % 500) % 500 + 500) % 500 AS d FROM part)""",
)
def rescaled_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = circular.rescaled_shift(F.col("p_retailprice") % 500, 500.0, F.col("p_size") * 12.5, 400.0)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", shift.alias("shift")))


@query(
    "normalised_events",
    """
WITH r AS (SELECT c_nationkey::BIGINT AS course, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS place, c_custkey FROM customer),
b AS (SELECT *, CASE WHEN c_custkey % 6 = 0 THEN 'event_' || i ELSE lower(c_mktsegment) || '_zone' END AS base FROM r)
SELECT course, i AS sequence, base || CASE WHEN row_number() OVER (PARTITION BY course, base ORDER BY i) = 1 THEN '' ELSE '_' || row_number() OVER (PARTITION BY course, base ORDER BY i) END AS event_id,
       CASE WHEN c_custkey % 6 = 0 THEN base ELSE ' ' || c_mktsegment || ' (zone) ' END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'feature' END AS kind, round(place, 6) AS place,
       concat_ws(';', CASE WHEN c_custkey % 3 = 0 THEN 'a;b' ELSE 'c' END, CASE WHEN place IS NULL THEN 'no_place' END) AS flags FROM b""",
)
def normalised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as the records of a course."""
    c = F.col
    record = F.struct(
        "c_custkey",
        F.when(c("c_custkey") % 6 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" (zone) "))).alias("name"),
        F.when(c("c_custkey") % 4 != 0, F.lit(" Feature ")).alias("kind"),
        F.when(c("c_acctbal") >= 0, c("c_acctbal")).alias("place"),
        F.when(c("c_custkey") % 3 == 0, " a ; b;; a").otherwise("c").alias("flags"),
    )
    records = table(spark, sf_dir, "customer").groupBy(c("c_nationkey").cast("long").alias("course")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    out = course.normalised_events(records, "course", "records")
    return rounded(out.withColumn("flags", F.array_join("flags", ";")))


@query(
    "bundle_gates",
    """
SELECT n_nationkey::BIGINT AS course, s_suppkey AS gate, round(s_acctbal, 2) AS balance,
       (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS features FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0""",
)
def bundle_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as courses, written as one checked document each and opened again: their active gates, and how many features they hold."""
    c = F.col
    courses = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("course"))
    gates = table(spark, sf_dir, "supplier").select(
        c("s_nationkey").cast("long").alias("course"), c("s_suppkey").alias("gate"), (c("s_acctbal") > 0).alias("active_by_default"), c("s_acctbal").alias("balance")
    )
    features = table(spark, sf_dir, "customer").select(c("c_nationkey").cast("long").alias("course"), c("c_custkey").alias("feature"))
    bundles = course.bundle(courses, "course", {"gates": (gates, ["gate"]), "features": (features, ["feature"])})
    schema = "version int, course long, gates array<struct<gate:long,active_by_default:boolean,balance:double>>, features array<struct<feature:long>>"
    content = course.opened(bundles, "course", schema)
    counts = content.select("course", F.size("content.features").cast("long").alias("features"))
    return rounded(course.active_gates(content, "course").drop("active_by_default").join(counts, "course"), 2)


_NODES = """n AS (SELECT l_suppkey AS lap, l_linenumber AS node, avg(l_quantity) AS x, avg(l_discount) * 100 AS y FROM lineitem GROUP BY ALL),
line AS (SELECT node, median(x) AS lx, median(y) AS ly FROM n GROUP BY node),
o AS (SELECT a.lap, a.node, any_value(a.x) AS x, any_value(a.y) AS y, median(b.x) AS ox, median(b.y) AS oy FROM n a JOIN n b ON a.node = b.node AND a.lap <> b.lap GROUP BY ALL)"""


def _lap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as laps, line numbers as nodes, mean quantity and discount as places."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("lap"), F.col("l_linenumber").alias("node"))
    return means.agg(F.avg("l_quantity").alias("x_m"), (F.avg("l_discount") * 100).alias("y_m"))


@query(
    "left_out_lines",
    f"""
WITH {_NODES} SELECT lap, node, round(lx, 6) + 0.0 AS line_x_m, round(ly, 6) + 0.0 AS line_y_m, round(ox, 6) + 0.0 AS others_x_m, round(oy, 6) + 0.0 AS others_y_m FROM o JOIN line USING (node)""",
)
def left_out_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.left_out(_lap_nodes(spark, sf_dir), "lap").select("lap", "node", "line_x_m", "line_y_m", "others_x_m", "others_y_m"))


@query(
    "consensus_round",
    f"""
WITH {_NODES},
m AS (SELECT lap, quantile_cont(sqrt((x - ox) ** 2 + (y - oy) ** 2), 0.95) AS p95, avg(CASE WHEN sqrt((x - ox) ** 2 + (y - oy) ** 2) > 2 THEN 1.0 ELSE 0 END) AS sustained,
      max(sqrt((lx - ox) ** 2 + (ly - oy) ** 2)) AS shift FROM o JOIN line USING (node) GROUP BY lap),
c AS (SELECT count(*) AS n, median(p95) AS mp, median(shift) AS ms FROM m),
d AS (SELECT median(abs(p95 - mp)) AS dp, median(abs(shift - ms)) AS ds FROM m, c),
t AS (SELECT n, greatest(2, mp + 1.5 * 1.4826 * dp) AS tp, greatest(0.05, ms + 1.5 * 1.4826 * ds) AS ts FROM c, d),
s AS (SELECT lap, n, p95 / tp + shift / ts + sustained / 0.3 AS severity FROM m, t WHERE sustained >= 0.85 OR (sustained >= 0.3 AND (p95 > tp OR shift > ts)))
SELECT lap, round(severity, 6) + 0.0 AS severity FROM s QUALIFY row_number() OVER (ORDER BY severity DESC, lap DESC) <= least(greatest(1, floor(n * 0.2)), greatest(0, n - 3))""",
)
def consensus_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers that one round would exclude: all three rules' limits are robust ones of this table."""
    rules = consensus.Rules(p95_limit_m=2.0, sustained_error_m=2.0, minimum_sustained=0.3, strong_sustained=0.85, shift_limit_m=0.05, deviations=1.5)
    measures = consensus.node_measures(consensus.left_out(_lap_nodes(spark, sf_dir), "lap"), "lap", rules)
    return rounded(consensus.outlying_laps(measures, "lap", rules))


#: Name: end of the feature, first and last offset.
WINDOWS = {"approach": ("start", -60.0, -20.0), "entry": ("start", -8.0, -1.0), "exit": ("end", 2.0, 14.0)}


@query(
    "event_windows",
    """
WITH e AS (SELECT c_nationkey AS course, c_custkey AS seq, c_custkey // 2 AS grp, c_custkey % 2 = 0 AS iv, CAST(c_custkey % 1000 AS DOUBLE) AS s, abs(c_acctbal) / 500 AS er,
                  CASE WHEN c_custkey % 5 <> 0 THEN abs(c_acctbal) / 500 + c_custkey % 7 END AS alt, c_custkey % 3 = 0 AS hs, c_custkey % 4 = 0 AS he,
                  (c_custkey + 988) % 1000 AS ss, (c_custkey + c_custkey % 40 - 20) % 1000 AS es, 5.0 + c_custkey % 4 AS bf, 6.0 + c_custkey % 6 AS af FROM customer),
r AS (SELECT *, CASE WHEN hs THEN -12.0 ELSE -bf END AS sr,
             CASE WHEN NOT he THEN af WHEN seq % 40 - 20 > 500 THEN seq % 40 - 1020 ELSE seq % 40 - 20 END AS er0,
             CASE WHEN hs THEN seq % 25 ELSE er END AS se, CASE WHEN he THEN seq % 23 ELSE er END AS ee,
             CASE WHEN hs THEN 1.5 ELSE sqrt(4 + 1) END AS su, CASE WHEN he THEN 2.5 ELSE sqrt(4 + 9) END AS eu FROM e),
t AS (SELECT *, CASE WHEN er0 <= sr THEN er0 + 1000 ELSE er0 END AS nr FROM r),
o AS (SELECT *, lead(s + sr) OVER w AS nx, lead(grp) OVER w AS ng, first(s + sr) OVER v AS fx, first(grp) OVER v AS fg, count(*) OVER (PARTITION BY course) AS n,
             row_number() OVER w AS i FROM t WINDOW w AS (PARTITION BY course ORDER BY seq), v AS (PARTITION BY course ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, n > 1 AND CASE WHEN i < n THEN nx < s + nr AND ng <> grp ELSE fx + 1000 < s + nr AND fg <> grp END AS hits FROM o),
g AS (SELECT *, coalesce(lag(hits) OVER (PARTITION BY course ORDER BY seq), last(hits) OVER (PARTITION BY course ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS hit FROM h)
SELECT course, seq, sr + 0.0::DOUBLE AS start_rel, nr + 0.0::DOUBLE AS end_rel, CASE WHEN hs THEN 'placed' ELSE 'assumed' END AS start_source, CASE WHEN he THEN 'placed' ELSE 'assumed' END AS end_source,
       round(sqrt(se ** 2 + su ** 2)::DOUBLE, 6) + 0.0 AS start_effective_m, round(sqrt(ee ** 2 + eu ** 2)::DOUBLE, 6) + 0.0 AS end_effective_m,
       sr - 60 + 0.0::DOUBLE AS approach_from, sr - 20 + 0.0::DOUBLE AS approach_to, sr - 8 + 0.0::DOUBLE AS entry_from, sr - 1 + 0.0::DOUBLE AS entry_to, nr + 2 + 0.0::DOUBLE AS exit_from, nr + 14 + 0.0::DOUBLE AS exit_to,
       concat_ws(';', CASE WHEN er > 15 THEN 'anchor_far' END, CASE WHEN alt - er < 2.5 THEN 'other_branch_near' END, CASE WHEN iv AND NOT hs AND NOT he THEN 'extent_assumed' END,
                 CASE WHEN se > 15 THEN 'start_far' END, CASE WHEN ee > 15 THEN 'end_far' END, CASE WHEN hits OR hit THEN 'overlaps_neighbour' END) AS flags FROM g""",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as events of their nation's course of 1000 m; a third of the starts and a quarter of the ends are placed."""
    c, key = F.col, F.col("c_custkey")
    error = F.abs("c_acctbal") / 500
    placed = table(spark, sf_dir, "customer").select(
        c("c_nationkey").alias("course"), key.alias("seq"), F.floor(key / 2).alias("grp"), (key % 2 == 0).alias("is_interval"), (key % 1000).cast("double").alias("anchor_s"),
        error.alias("error_m"), F.when(key % 5 != 0, error + key % 7).alias("other_error_m"), F.lit(2.0).alias("anchor_uncertainty_m"),
        F.when(key % 3 == 0, ((key + 988) % 1000).cast("double")).alias("start_s"), (key % 25).cast("double").alias("start_error_m"), F.lit(1.5).alias("start_uncertainty_m"),
        F.when(key % 4 == 0, F.pmod(key + key % 40 - 20, F.lit(1000)).cast("double")).alias("end_s"), (key % 23).cast("double").alias("end_error_m"), F.lit(2.5).alias("end_uncertainty_m"),
        (5.0 + key % 4).alias("before_m"), F.lit(1.0).alias("before_uncertainty_m"), (6.0 + key % 6).alias("after_m"), F.lit(3.0).alias("after_uncertainty_m"),
    )
    found = events.event_windows(placed, "course", "seq", "grp", 1000.0, WINDOWS, most_error=15.0, apart=2.5)
    ends = [f"{name}_{side}" for name in WINDOWS for side in ("from", "to")]
    return rounded(found.select("course", "seq", "start_rel", "end_rel", "start_source", "end_source", "start_effective_m", "end_effective_m", *ends, "flags"))
