"""Queries on ordered measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.functions import circular
from lapsight.operators import series
from lapsight.plans.registry import query, rounded, table

GAP_S = 3600.0


@query(
    "kinematics_steps",
    """
WITH s AS (
  SELECT user_id, value, epoch_us(ts) / 1e6 AS t,
         epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS dt, value - lag(value) OVER w AS dv
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, count(*) FILTER (dt = 0) AS n_same_time, count(*) FILTER (dt > 3600) AS n_gaps,
       round(sum(dt), 3) + 0.0 AS duration_s, round(median(dt) FILTER (dt > 0), 6) + 0.0 AS median_dt_s,
       round(avg(dv / nullif(dt, 0)), 6) + 0.0 AS mean_rate
FROM s GROUP BY user_id""",
)
def kinematics_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", series.seconds(F.col("ts")))
    s = series.with_steps(events, ["user_id"], ["ts", "event_id"], {"dt": F.col("t"), "dv": F.col("value")})
    out = s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("dt") == 0).alias("n_same_time"),
        F.count_if(F.col("dt") > GAP_S).alias("n_gaps"),
        F.round(F.sum("dt"), 3).alias("duration_s"),
        F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("median_dt_s"),
        F.avg(F.try_divide("dv", "dt")).alias("mean_rate"),
    )
    return rounded(out)


@query(
    "speed_source_preference",
    """
SELECT event_id, round(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), value), 6) + 0.0 AS speed,
       CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL THEN 'device'
            WHEN value IS NOT NULL THEN 'reported' ELSE 'missing' END AS source
FROM events""",
)
def speed_source_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.get_json_object("props", "$.k").try_cast("double")
    out = table(spark, sf_dir, "events").select(
        "event_id",
        F.coalesce(device, "value").alias("speed"),
        F.when(device.isNotNull(), "device").when(F.col("value").isNotNull(), "reported").otherwise("missing").alias("source"),
    )
    return rounded(out)


@query(
    "hampel_spike_replace",
    """
WITH m AS (
  SELECT event_id, user_id, value, CASE WHEN count(value) OVER w >= 3 THEN quantile_cont(value, 0.5) OVER w END AS mid
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_id, user_id, round(CASE WHEN abs(value - mid) > 100 THEN mid ELSE value END, 6) + 0.0 AS clean,
       coalesce(abs(value - mid) > 100, false) AS replaced FROM m""",
)
def hampel_spike_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = series.replace_spikes(events, ["user_id"], ["ts", "event_id"], "value", 100.0, "clean")
    replaced = F.coalesce(F.col("clean") != F.col("value"), F.lit(False)).alias("replaced")
    return rounded(out.select("event_id", "user_id", "clean", replaced))


_ISLANDS = """
g AS (SELECT *, coalesce(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600, false) AS opens
      FROM events),
i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM g)"""


def _event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gap_islands(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", GAP_S)


@query(
    "gap_islands",
    f"WITH {_ISLANDS}"
    """
SELECT user_id, island, count(*) AS n, arg_min(event_id, struct_pack(v := value, e := event_id)) FILTER (value IS NOT NULL) AS closest_event,
       round(min(value), 6) + 0.0 AS closest_value FROM i GROUP BY ALL""",
)
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _event_islands(spark, sf_dir).groupBy("user_id", "island").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("event_id", F.when(F.col("value").isNotNull(), F.struct("value", "event_id"))).alias("closest_event"),
        F.min("value").alias("closest_value"),
    )
    return rounded(out)


@query(
    "lap_table",
    f"WITH {_ISLANDS},"
    """
l AS (SELECT user_id, island, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s, avg(value) AS mean_value,
             median(value) AS median_value FROM i GROUP BY ALL),
m AS (SELECT median(duration_s) AS typical FROM l)
SELECT user_id, island, n, round(duration_s, 6) + 0.0 AS duration_s, round(mean_value, 6) + 0.0 AS mean_value,
       round(median_value, 6) + 0.0 AS median_value, round(duration_s / nullif(typical, 0), 6) + 0.0 AS ratio,
       coalesce(duration_s / nullif(typical, 0) BETWEEN 0.85 AND 1.15 AND n >= 2, false) AS valid FROM l, m""",
)
def lap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = _event_islands(spark, sf_dir).groupBy("user_id", "island").agg(
        F.count(F.lit(1)).alias("n"),
        (series.seconds(F.max("ts")) - series.seconds(F.min("ts"))).alias("duration_s"),
        F.avg("value").alias("mean_value"),
        F.median("value").alias("median_value"),
    )
    typical = F.broadcast(laps.agg(F.median("duration_s").alias("typical")))  # one row
    ratio = F.try_divide("duration_s", "typical")
    valid = F.coalesce(ratio.between(0.85, 1.15) & (F.col("n") >= 2), F.lit(False))
    return rounded(laps.join(typical).withColumns({"ratio": ratio, "valid": valid}).drop("typical"))


@query(
    "boundary_inclusive_range_join",
    """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
m AS (SELECT user_id, i AS a, lead(i) OVER (PARTITION BY user_id ORDER BY i) AS b FROM n WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS lap FROM m WHERE b IS NOT NULL)
SELECT r.user_id, lap, count(*) AS n, min(n.event_id) AS first_event, max(n.event_id) AS last_event, round(sum(value), 4) + 0.0 AS total
FROM r JOIN n ON r.user_id = n.user_id AND n.i BETWEEN a AND b GROUP BY ALL""",
)
def boundary_inclusive_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    numbered, ranges = series.inclusive_ranges(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    out = series.rows_in_ranges(numbered, ranges, ["user_id"]).groupBy("user_id", F.col("range_index").alias("lap")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
        F.round(F.sum("value"), 4).alias("total"),
    )
    return rounded(out)


@query(
    "interp_on_grid",
    """
WITH m AS (SELECT o_orderpriority AS p, epoch_us(date_trunc('month', o_orderdate)) / 86400e6 AS x, median(o_totalprice) AS y FROM orders GROUP BY ALL),
g AS (SELECT p, unnest(range(7665, 11680, 10))::DOUBLE AS x FROM (SELECT DISTINCT p FROM m)),
s AS (SELECT g.p, g.x, (SELECT struct_pack(x := m.x, y := m.y) FROM m WHERE m.p = g.p AND m.x <= g.x ORDER BY m.x DESC LIMIT 1) AS a,
             (SELECT struct_pack(x := m.x, y := m.y) FROM m WHERE m.p = g.p AND m.x >= g.x ORDER BY m.x LIMIT 1) AS b FROM g)
SELECT p AS o_orderpriority, x AS day,
       round(CASE WHEN a IS NULL THEN b.y WHEN b IS NULL OR a.x = b.x THEN a.y ELSE a.y + (x - a.x) / (b.x - a.x) * (b.y - a.y) END, 4) + 0.0 AS price
FROM s""",
)
def interp_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = series.seconds(F.date_trunc("month", F.col("o_orderdate"))) / 86400
    monthly = table(spark, sf_dir, "orders").groupBy("o_orderpriority", day.alias("day")).agg(F.median("o_totalprice").alias("price"))
    days = F.explode(F.sequence(F.lit(7665), F.lit(11675), F.lit(10)).cast("array<double>"))
    grid = monthly.select("o_orderpriority").distinct().select("o_orderpriority", days.alias("day"))
    return rounded(series.interpolate(monthly, grid, ["o_orderpriority"], "day", "price"), 4)


@query(
    "trapezoid_energy",
    """
WITH s AS (SELECT user_id, value, lead(value) OVER w AS nv, lead(epoch_us(ts)) OVER w / 1e6 - epoch_us(ts) / 1e6 AS dt FROM events
           WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(sum((value + nv) / 2 * dt), 2) + 0.0 AS integral, round(sum(dt), 2) + 0.0 AS covered_s, count(*) AS n FROM s GROUP BY user_id""",
)
def trapezoid_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.time_integral(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value"), 2)


@query(
    "grade_screen",
    """
WITH m AS (SELECT epoch_us(date_trunc('month', o_orderdate)) / 86400e6 AS x, median(o_totalprice) / 1000 AS y,
                  quantile_cont(o_totalprice, 0.9) / 1000 - quantile_cont(o_totalprice, 0.1) / 1000 AS spread FROM orders GROUP BY 1),
s AS (SELECT x, spread, quantile_cont(y, 0.5) OVER (ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS z FROM m),
d AS (SELECT x, z, spread, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, z - lag(z) OVER w AS d0, lead(z) OVER w - z AS d1 FROM s WINDOW w AS (ORDER BY x)),
g AS (SELECT *, coalesce((d1 / h1) * (h0 / (h0 + h1)) + (d0 / h0) * (h1 / (h0 + h1)), d1 / h1, d0 / h0) AS slope FROM d)
SELECT count(*) AS n, round(max(z) - min(z), 6) + 0.0 AS height, round(median(spread), 6) + 0.0 AS median_spread,
       round(quantile_cont(abs(degrees(atan(slope))), 0.95), 6) + 0.0 AS p95_grade,
       CASE WHEN count(*) < 5 THEN 'insufficient_elevation_evidence' WHEN median(spread) > greatest(1.0, 0.5 * (max(z) - min(z))) THEN 'elevation_not_repeatable'
            WHEN max(z) - min(z) >= 3 AND quantile_cont(abs(degrees(atan(slope))), 0.95) >= 2 THEN 'paired_grade_sensitivity_recommended'
            ELSE 'grade_proxy_immaterial' END AS status FROM g""",
)
def grade_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lapsight.operators.profiles import grade_materiality

    monthly = table(spark, sf_dir, "orders").groupBy((series.seconds(F.date_trunc("month", F.col("o_orderdate"))) / 86400).alias("x")).agg(
        (F.median("o_totalprice") / 1000).alias("y"),
        (F.percentile("o_totalprice", 0.9) / 1000 - F.percentile("o_totalprice", 0.1) / 1000).alias("spread"),
    )
    return rounded(grade_materiality(monthly, "x", "y", "spread", window=3))


@query(
    "speed_bins",
    """
WITH b AS (SELECT user_id, least(floor(value / 100), 4)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
a AS (SELECT user_id, unnest(range(0, 5)) AS bin FROM (SELECT DISTINCT user_id FROM events)),
f AS (SELECT a.bin, coalesce(n, 0) AS n FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.bin = b.bin)
SELECT bin, count(*) AS users, round(quantile_cont(n, 0.1), 6) + 0.0 AS p10, round(quantile_cont(n, 0.5), 6) + 0.0 AS p50,
       round(quantile_cont(n, 0.9), 6) + 0.0 AS p90 FROM f GROUP BY bin""",
)
def speed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lapsight.operators.profiles import zero_filled_bins

    filled = zero_filled_bins(table(spark, sf_dir, "events"), "user_id", F.floor(F.col("value") / 100), 5)
    q = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = filled.groupBy("bin").agg(F.count(F.lit(1)).alias("users"), q.alias("q"))
    return rounded(out.select("bin", "users", *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))]))


@query(
    "circular_intervals",
    """
WITH d AS (SELECT o_orderkey, (dayofyear(o_orderdate) - 1)::DOUBLE AS a, (dayofyear(o_orderdate) - 1 + 30 + o_orderkey % 60)::DOUBLE AS b FROM orders),
i AS (SELECT o_orderkey, a, b % 365.0::DOUBLE AS b, a % 365.0::DOUBLE AS s FROM d)
SELECT o_orderkey, s AS start_day, b AS end_day, ((b - s + 365.0) % 365.0)::DOUBLE AS length, b < s AS wraps,
       CASE WHEN s <= b THEN 10.0 >= s AND 10.0 < b ELSE 10.0 >= s OR 10.0 < b END AS holds_day_10,
       least((100.0 - s + 365.0) % 365.0, 365.0 - (100.0 - s + 365.0) % 365.0)::DOUBLE AS from_day_100 FROM i""",
)
def circular_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.dayofyear("o_orderdate") - 1).cast("double")
    x = table(spark, sf_dir, "orders").select("o_orderkey", circular.interval(day, day + 30.0 + F.col("o_orderkey") % 60, 365.0).alias("i"))
    out = x.select(
        "o_orderkey",
        F.col("i.start").alias("start_day"),
        F.col("i.end").alias("end_day"),
        F.col("i.length").alias("length"),
        F.col("i.wraps").alias("wraps"),
        circular.inside(F.lit(10.0), F.col("i.start"), F.col("i.end")).alias("holds_day_10"),
        circular.shortest(F.col("i.start"), F.lit(100.0), 365.0).alias("from_day_100"),
    )
    return rounded(out)


@query(
    "growing_quantiles",
    """
WITH y AS (SELECT year(o_orderdate) AS yr, o_totalprice AS v FROM orders), k AS (SELECT DISTINCT yr FROM y)
SELECT k.yr::BIGINT AS year, count(*) AS n, round(quantile_cont(v, 0.1), 4) + 0.0 AS p10, round(quantile_cont(v, 0.5), 4) + 0.0 AS p50,
       round(quantile_cont(v, 0.9), 4) + 0.0 AS p90 FROM k JOIN y ON y.yr <= k.yr GROUP BY ALL HAVING count(*) >= 3""",
)
def growing_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lapsight.operators.profiles import prefix_quantiles

    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return rounded(prefix_quantiles(orders, "year", "o_totalprice", (0.1, 0.5, 0.9)), 4)


@query(
    "spatial_profile",
    """
WITH s AS (SELECT l_suppkey, round_even(l_quantity / 5.0, 0) * 5.0 AS s, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT s.s AS s, count(v) AS n, round(quantile_cont(v, 0.1), 4) + 0.0 AS p10, round(quantile_cont(v, 0.5), 4) + 0.0 AS p50,
       round(quantile_cont(v, 0.9), 4) + 0.0 AS p90 FROM s GROUP BY s.s""",
)
def spatial_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lapsight.operators.profiles import profile_over_laps

    return rounded(profile_over_laps(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice", 5.0), 4)


@query(
    "split_half_convergence",
    """
WITH r AS (SELECT event_type AS k, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
a AS (SELECT k, max(n) AS n, median(v) AS m, median(v) FILTER (i <= n // 2) AS a, median(v) FILTER (i > n // 2) AS b,
             stddev_pop(v) AS sp, stddev_samp(v) AS ss FROM r GROUP BY k)
SELECT k AS event_type, n, round(abs(a - b), 6) + 0.0 AS difference, round(abs(a - b) / greatest(abs(m), sp, 1e-9), 6) + 0.0 AS relative,
       round(ss / sqrt(n), 6) + 0.0 AS mean_se, n >= 20 AND abs(a - b) / greatest(abs(m), sp, 1e-9) <= 0.05 AS adequate FROM a""",
)
def split_half_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lapsight.operators.statistics import split_half

    events = table(spark, sf_dir, "events").where("value is not null")
    return rounded(split_half(events, ["event_type"], ["event_id"], "value"))


@query(
    "rolling_around_course",
    """
WITH m AS (SELECT dayofyear(o_orderdate)::BIGINT AS d, median(o_totalprice) AS v FROM orders GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS c FROM m),
p AS (SELECT d, v, i + k * c AS o, k FROM n, (VALUES (-1), (0), (1)) t(k)),
a AS (SELECT d, k, o, quantile_cont(v, 0.5) OVER (ORDER BY o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS z FROM p),
b AS (SELECT d, k, avg(z) OVER (ORDER BY o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM a)
SELECT d AS day, round(smooth, 4) + 0.0 AS smooth FROM b WHERE k = 0""",
)
def rolling_around_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.dayofyear("o_orderdate").alias("day")).agg(F.median("o_totalprice").alias("v"))
    return rounded(series.rolling_around(daily.withColumn("k", F.lit(0)), ["k"], "day", "v", "smooth").select("day", "smooth"), 4)


@query(
    "true_runs",
    """
WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, coalesce(value > 100, false) AS f FROM events),
g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM n WHERE f)
SELECT user_id, min(i) AS "start", max(i) AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
)
def true_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return rounded(series.true_runs(events, ["user_id"], ["ts", "event_id"], F.coalesce(F.col("value") > 100, F.lit(False))))
