"""Queries on traces against places and profiles, sweeps and summaries of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import comparison, ordered
from lapsight.plans.registry import query, rounded, table

Q3 = "quantile_cont({0}, 0.1) AS {1}_p10, quantile_cont({0}, 0.5) AS {1}_median, quantile_cont({0}, 0.9) AS {1}_p90"


@query(
    "sweep_summary",
    f"""
WITH r AS (SELECT *, l_extendedprice - min(l_extendedprice) OVER (PARTITION BY l_orderkey) AS regret FROM lineitem),
a AS (SELECT l_linenumber, count(*) AS replicates, avg((l_returnflag <> 'R')::INT) AS pass_share, avg((regret <= 1e-9)::INT) AS win_share, max(abs(l_discount - l_tax)) AS most_residual,
             {Q3.format("regret", "regret")}, {Q3.format("l_extendedprice", "l_extendedprice")}, {Q3.format("l_quantity", "l_quantity")} FROM r GROUP BY l_linenumber)
SELECT l_linenumber::BIGINT AS l_linenumber, replicates, round(pass_share, 6) AS pass_share, round(win_share, 6) AS win_share, round(most_residual, 6) AS most_residual,
       round(regret_p10, 4) AS regret_p10, round(regret_median, 4) AS regret_median, round(regret_p90, 4) AS regret_p90,
       round(l_extendedprice_p10, 4) AS l_extendedprice_p10, round(l_extendedprice_median, 4) AS l_extendedprice_median, round(l_extendedprice_p90, 4) AS l_extendedprice_p90,
       round(l_quantity_p10, 4) AS l_quantity_p10, round(l_quantity_median, 4) AS l_quantity_median, round(l_quantity_p90, 4) AS l_quantity_p90,
       rank() OVER (ORDER BY l_extendedprice_median, l_quantity_median) AS place FROM a""",
)
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {n: F.col(n) for n in ("l_extendedprice", "l_quantity")}
    rows = table(spark, sf_dir, "lineitem")
    found = comparison.sweep_summary(rows, "l_orderkey", "l_linenumber", "l_extendedprice", metrics, F.col("l_returnflag") != "R", F.col("l_discount") - F.col("l_tax"), "l_quantity")
    return rounded(found.withColumns({n: F.round(n, 4) for n in found.columns if n.endswith(("_p10", "_median", "_p90"))}))


#: Line numbers of prices along the order keys, as traces; other orders are gates.
@query(
    "gate_compliance",
    """
WITH s AS (SELECT l_linenumber AS t, (l_orderkey * 2)::DOUBLE AS x, avg(10 * sqrt(l_extendedprice)) AS y FROM lineitem WHERE l_linenumber IN (1, 2) AND l_orderkey % 3 = 0 AND l_extendedprice IS NOT NULL GROUP BY ALL),
g AS (SELECT o_orderkey, (o_orderkey * 2 - o_orderkey % 4)::DOUBLE AS place, 40 * sqrt(o_totalprice) AS target FROM orders),
u AS (SELECT t, x, y, x AS sx, 0 AS k FROM s UNION ALL SELECT DISTINCT t, place, NULL, NULL, 1 FROM g CROSS JOIN (SELECT DISTINCT t FROM s)),
w AS (SELECT t, x, k, last_value(sx IGNORE NULLS) OVER a AS ax, last_value(y IGNORE NULLS) OVER a AS ay, first_value(sx IGNORE NULLS) OVER b AS bx, first_value(y IGNORE NULLS) OVER b AS b_y FROM u
      WINDOW a AS (PARTITION BY t ORDER BY x, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY t ORDER BY x, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT x, max(y) FILTER (t = 1) AS one, max(y) FILTER (t = 2) AS two
      FROM (SELECT t, x, CASE WHEN ax IS NULL THEN b_y WHEN bx IS NULL OR ax = x THEN ay ELSE ay + (x - ax) / (bx - ax) * (b_y - ay) END AS y FROM w WHERE k = 1) GROUP BY x)
SELECT o_orderkey, place, round(target, 4) AS target, round(one, 4) AS first_speed, round(greatest(0.0, one - target), 4) + 0.0 AS first_excess, one <= target + 50 AS first_complies,
       round(two, 4) AS second_speed, round(greatest(0.0, two - target), 4) + 0.0 AS second_excess, two <= target + 50 AS second_complies FROM g LEFT JOIN v ON v.x = g.place""",
)
def gate_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    gates = table(spark, sf_dir, "orders").select("o_orderkey", (key * 2 - key % 4).cast("double").alias("place"), (F.sqrt("o_totalprice") * 40).alias("target"))
    name = F.when(F.col("l_linenumber") == 1, "first").when(F.col("l_linenumber") == 2, "second")
    traces = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(name.alias("trace"), (F.col("l_orderkey") * 2).cast("double").alias("place"), (F.sqrt("l_extendedprice") * 10).alias("speed"))
    return rounded(comparison.gate_table(gates, traces, [], "trace", ["first", "second"], "place", "speed", "target", 50.0), 4)


@query(
    "profile_comparison",
    """
WITH o AS (SELECT floor(epoch(o_orderdate) / 604800) AS x, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders GROUP BY 1),
p AS (SELECT l_returnflag, epoch(l_shipdate) / 604800 AS x, l_extendedprice * 5 AS y FROM lineitem),
q AS (SELECT p.*, a.x AS ax, a.m AS am, a.lo AS al, a.hi AS ah FROM p ASOF LEFT JOIN o a ON p.x >= a.x),
r AS (SELECT q.*, b.x AS bx, b.m AS bm, b.lo AS bl, b.hi AS bh FROM q ASOF LEFT JOIN o b ON q.x <= b.x),
i AS (SELECT l_returnflag, y, CASE WHEN ax IS NULL THEN 1.0 WHEN bx IS NULL OR ax = x THEN 0.0 ELSE (x - ax) / (bx - ax) END AS f,
             coalesce(am, bm) AS am, coalesce(al, bl) AS al, coalesce(ah, bh) AS ah, coalesce(bm, am) AS bm, coalesce(bl, al) AS bl, coalesce(bh, ah) AS bh FROM r),
e AS (SELECT l_returnflag, y - (am + f * (bm - am)) AS error, y BETWEEN al + f * (bl - al) AND ah + f * (bh - ah) AS inside FROM i)
SELECT l_returnflag, count(*) AS points, round(avg(error), 3) + 0.0 AS bias, round(avg(abs(error)), 3) AS mae, round(sqrt(avg(error * error)), 3) AS rmse, round(avg(inside::INT), 6) AS share_inside
FROM e GROUP BY 1""",
)
def profile_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 / 604800
    orders = table(spark, sf_dir, "orders").withColumn("week", F.floor(week("o_orderdate")).cast("double"))
    observed = ordered.quantiles(orders, ["week"], {"v": F.col("o_totalprice")}, {"low": ("v", 0.25), "middle": ("v", 0.5), "high": ("v", 0.75)})
    predictions = table(spark, sf_dir, "lineitem").select("l_returnflag", week("l_shipdate").alias("week"), (F.col("l_extendedprice") * 5).alias("predicted"))
    found = comparison.profile_summary(comparison.profile_points(observed, predictions, "week", "predicted", "middle", "low", "high"), "l_returnflag")
    return rounded(found.withColumns({n: F.round(n, 3) for n in ("bias", "mae", "rmse")}))


@query(
    "target_inventory",
    """
SELECT event_type, count(value) AS n, count(DISTINCT value) AS distinct_values, round(min(3.6 * value), 5) + 0.0 AS least, round(quantile_cont(3.6 * value, 0.1), 5) + 0.0 AS p10,
       round(median(3.6 * value), 5) + 0.0 AS median, round(quantile_cont(3.6 * value, 0.9), 5) + 0.0 AS p90, round(max(3.6 * value), 5) + 0.0 AS most
FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def target_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = comparison.distribution(table(spark, sf_dir, "events"), ["event_type"], F.col("value"))
    return rounded(found.withColumns({n: F.col(n) * 3.6 for n in ("least", "p10", "median", "p90", "most")}), 5)


@query(
    "family_screening",
    """
WITH a AS (SELECT l_returnflag AS metric, l_linestatus AS family, l_suppkey AS path, round(abs(corr(l_quantity, l_extendedprice)), 5) AS strength FROM lineitem
           GROUP BY ALL HAVING count(*) >= 8 AND count(DISTINCT l_quantity) > 1 AND count(DISTINCT l_extendedprice) > 1)
SELECT metric, family, count(DISTINCT path) AS inputs, arg_min(path, (-strength, path)) AS strongest, max(strength) AS strength, round(median(strength), 6) AS median_strength FROM a GROUP BY ALL""",
)
def family_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("family"), F.col("l_suppkey").alias("path"))
    varied = (F.col("n") >= 8) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.corr(x, y).alias("r")).where(varied)
    strengths = found.select("metric", "family", "path", F.round(F.abs("r"), 5).alias("strength"))
    return rounded(comparison.family_screening(strengths, "metric", "family", "path", "strength"))


@query(
    "case_summary",
    f"""
WITH a AS (SELECT o_orderpriority, min(o_orderstatus) AS category, count(*) AS scenarios, count(DISTINCT o_custkey) AS draws,
                  {Q3.format("o_totalprice", "lap")}, {Q3.format("sqrt(o_totalprice)", "penalty")} FROM orders GROUP BY 1)
SELECT o_orderpriority, category, scenarios, draws, round(lap_p10, 4) AS lap_p10, round(lap_median, 4) AS lap_median, round(lap_p90, 4) AS lap_p90,
       round(penalty_p10, 4) AS penalty_p10, round(penalty_median, 4) AS penalty_median, round(penalty_p90, 4) AS penalty_p90 FROM a""",
)
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {"lap": F.col("o_totalprice"), "penalty": F.sqrt("o_totalprice")}
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "category")
    return rounded(comparison.case_summary(orders, "o_orderpriority", "category", "o_custkey", metrics), 4)
