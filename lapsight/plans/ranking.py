"""Queries on designs, scenarios and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import ordered, ranking, statistics
from lapsight.plans.registry import query, rounded, table

_FACT = """
f AS (SELECT l_suppkey AS s, l_returnflag AS d, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
c AS (SELECT * FROM f WHERE s IN (SELECT s FROM f GROUP BY s HAVING count(DISTINCT d) = (SELECT count(DISTINCT d) FROM f)))"""


def _designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("price"))
    return ranking.complete_scenarios(fact, "l_suppkey", "l_returnflag")


@query(
    "paired_design_ranking",
    f"WITH {_FACT},"
    """
r AS (SELECT *, v - min(v) OVER (PARTITION BY s) AS g FROM c),
t AS (SELECT *, (g <= 1e-12)::INT::DOUBLE / sum((g <= 1e-12)::INT) OVER (PARTITION BY s) AS w FROM r)
SELECT d AS l_returnflag, count(DISTINCT s) AS scenario_count, 1.0::DOUBLE AS completion_fraction, round(avg(w), 6) + 0.0 AS paired_win_fraction,
       round(avg((g <= 1e-9)::INT), 6) + 0.0 AS full_win_fraction, round(avg(g), 4) + 0.0 AS mean_regret, round(median(g), 4) + 0.0 AS regret_median,
       round(quantile_cont(g, 0.9), 4) + 0.0 AS regret_p90, round(quantile_cont(v, 0.1), 4) + 0.0 AS metric_p10,
       round(quantile_cont(v, 0.5), 4) + 0.0 AS metric_median, round(quantile_cont(v, 0.9), 4) + 0.0 AS metric_p90 FROM t GROUP BY d""",
)
def paired_design_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.design_ranking(_designs(spark, sf_dir), "l_suppkey", "l_returnflag", "price")
    wide = [c for c in out.columns if c.startswith(("mean", "regret", "metric"))]
    return rounded(out.withColumns({c: F.round(c, 4) for c in wide}))


@query(
    "paired_case_effects",
    """
WITH f AS (SELECT year(l_shipdate)::BIGINT AS y, l_returnflag AS c, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT a.c AS l_returnflag, count(*) AS n, round(quantile_cont(a.v - b.v, 0.1), 4) + 0.0 AS delta_p10,
       round(median(a.v - b.v), 4) + 0.0 AS delta_median, round(quantile_cont(a.v - b.v, 0.9), 4) + 0.0 AS delta_p90
FROM f a JOIN f b ON a.y = b.y AND b.c = 'N' WHERE a.c <> 'N' GROUP BY a.c""",
)
def paired_case_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("draw"), "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    return rounded(ranking.case_effects(fact, "draw", "l_returnflag", "N", "v"), 4)


@query(
    "threshold_table",
    """
WITH f AS (SELECT avg(l_extendedprice) / 1000 AS v FROM lineitem GROUP BY l_orderkey), l AS (SELECT unnest([0.0, 20.0, 30.0, 40.0, 60.0])::DOUBLE AS x)
SELECT count(*) AS n, x AS "limit", count(*) FILTER (v > x) AS above, round(count(*) FILTER (v > x) / count(*), 6) + 0.0 AS fraction FROM f, l GROUP BY x""",
)
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.avg("l_extendedprice") / 1000).alias("v"))
    return rounded(ranking.threshold_counts(fact, "v", (0, 20, 30, 40, 60)))


@query(
    "loss_shares",
    """
WITH p AS (SELECT 'price' AS part, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'discount', l_extendedprice * l_discount FROM lineitem
           UNION ALL SELECT 'tax', l_extendedprice * (1 - l_discount) * l_tax FROM lineitem),
q AS (SELECT part, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.9) AS c FROM p GROUP BY part)
SELECT part, round(a, 4) + 0.0 AS p10, round(b, 4) + 0.0 AS median, round(c, 4) + 0.0 AS p90, round(b / sum(b) OVER (), 4) + 0.0 AS share FROM q""",
)
def loss_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    parts = {"price": price, "discount": price * off, "tax": price * (1 - off) * tax}
    return rounded(ranking.loss_shares(table(spark, sf_dir, "lineitem"), parts), 4)


@query(
    "structural_ranges",
    """
WITH l AS (SELECT p_type, p_size, avg(p_retailprice) AS v FROM part GROUP BY ALL),
g AS (SELECT p_type, count(*) AS levels, arg_min(v, p_size) AS nominal, min(v) AS low, max(v) AS high,
             arg_min(p_size, struct_pack(v := v, s := p_size)) AS low_level, arg_min(p_size, struct_pack(v := -v, s := p_size)) AS high_level FROM l GROUP BY p_type),
c AS (SELECT *, high - low AS span, greatest(abs(high - nominal), abs(low - nominal)) AS change FROM g)
SELECT p_type, levels, round(nominal, 4) + 0.0 AS nominal, round(low, 4) + 0.0 AS low, round(high, 4) + 0.0 AS high, low_level::BIGINT AS low_level,
       high_level::BIGINT AS high_level, round(span, 4) + 0.0 AS span, round(change, 4) + 0.0 AS change, round(100 * change / abs(nominal), 4) + 0.0 AS change_percent,
       round(span / max(span) OVER (), 4) + 0.0 AS importance, row_number() OVER (ORDER BY span DESC, p_type) AS rank FROM c""",
)
def structural_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return rounded(ranking.structural_ranges(levels, "p_type", "p_size", "v"), 4)


@query(
    "prediction_error_sets",
    """
WITH r AS (SELECT l_returnflag AS m, l_linestatus AS g, l_quantity * 1400.0 AS p, l_extendedprice AS o FROM lineitem),
e AS (SELECT m, g, p - o AS e, o FROM r)
SELECT m AS metric, coalesce(g, 'ALL') AS "group", count(e) AS n, round(avg(e), 4) + 0.0 AS bias, round(avg(abs(e)), 4) + 0.0 AS mae,
       round(sqrt(avg(e * e)), 4) + 0.0 AS rmse, round(median(abs(e)), 4) + 0.0 AS median_ae,
       round(avg(abs(e)) / (quantile_cont(o, 0.75) - quantile_cont(o, 0.25)), 4) + 0.0 AS mae_over_iqr
FROM e GROUP BY GROUPING SETS ((m), (m, g))""",
)
def prediction_error_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_quantity") * 1400.0)
    return rounded(ranking.prediction_errors(rows, "l_returnflag", "l_linestatus", "predicted", "l_extendedprice"), 4)


@query(
    "eta_squared",
    """
WITH m AS (SELECT avg(o_totalprice) AS g FROM orders),
l AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS a, sum((o_totalprice - g) ^ 2) AS t FROM orders, m GROUP BY 1)
SELECT count(*) AS levels, round(sum(n * (a - g) ^ 2) / sum(t), 5) + 0.0 AS eta_squared, round(max(a) - min(a), 5) + 0.0 AS span FROM l, m""",
)
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.category_effect(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice"), 5)


@query(
    "spearman_pace",
    """
WITH r AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice AS y,
                  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT k AS l_returnflag, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(regr_slope(y, x), 4) + 0.0 AS slope
FROM r GROUP BY k""",
)
def spearman_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.association(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rounded(out.withColumn("slope", F.round("slope", 4)))


@query(
    "driver_explorer",
    """
WITH l AS (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem),
j AS (SELECT 'price' AS metric, 'quantity' AS path, l_quantity AS x, l_extendedprice AS y FROM l UNION ALL SELECT 'price', 'discount', l_discount, l_extendedprice FROM l
      UNION ALL SELECT 'price', 'tax', l_tax, l_extendedprice FROM l UNION ALL SELECT 'charge', 'quantity', l_quantity, charge FROM l
      UNION ALL SELECT 'charge', 'discount', l_discount, charge FROM l UNION ALL SELECT 'charge', 'tax', l_tax, charge FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY metric, path ORDER BY x) + (count(*) OVER (PARTITION BY metric, path, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY metric, path ORDER BY y) + (count(*) OVER (PARTITION BY metric, path, y) - 1) / 2.0 AS ry FROM j),
c AS (SELECT metric, path, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, regr_slope(y, x) AS slope FROM r GROUP BY ALL)
SELECT metric, path, n, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman, round(slope, 3) + 0.0 AS slope,
       row_number() OVER (PARTITION BY metric ORDER BY abs(spearman) DESC, path) AS rank, round(abs(spearman) / max(abs(spearman)) OVER (PARTITION BY metric), 6) + 0.0 AS importance
FROM c""",
)
def driver_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lapsight.operators.attribution import driver_explorer as explore

    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    inputs = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    out = explore(rows.withColumn("charge", charge), "id", inputs, {"price": "l_extendedprice", "charge": "charge"}, complete=True)
    return rounded(out.withColumn("slope", F.round("slope", 3)))


@query(
    "wilson_interval",
    """
WITH c AS (SELECT c_mktsegment AS k, count(*) AS n, count(*) FILTER (o_totalprice < 200000) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
z AS (SELECT *, x / n AS p, 1.959963984540054::DOUBLE AS z FROM c),
h AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS w FROM z)
SELECT k AS c_mktsegment, n, x AS below, round(p, 6) + 0.0 AS fraction, round(greatest(0, m - w), 6) + 0.0 AS low, round(least(1, m + w), 6) + 0.0 AS high FROM h""",
)
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    out = joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") < 200000).alias("below"))
    low, high = statistics.wilson(F.col("below"), F.col("n"))
    return rounded(out.withColumns({"fraction": F.col("below") / F.col("n"), "low": low, "high": high}))


@query(
    "mad_outliers",
    """
WITH v AS (SELECT l_suppkey AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1),
m AS (SELECT median(v) AS m FROM v), d AS (SELECT median(abs(v - m)) AS d FROM v, m),
t AS (SELECT greatest(1000.0, m + 1.0 * 1.4826 * d) AS t FROM m, d), n AS (SELECT count(*) AS n FROM v),
r AS (SELECT k, v, v / t AS severity, row_number() OVER (ORDER BY v / t DESC, k DESC) AS rank FROM v, t WHERE v > t)
SELECT k AS l_suppkey, round(v, 4) + 0.0 AS v, round(t, 4) + 0.0 AS threshold, round(severity, 6) + 0.0 AS severity, rank
FROM r, t, n WHERE rank <= greatest(0, least(greatest(1, floor(0.2 * n)), n - 5))""",
)
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("v"))
    out = statistics.outliers(means, "l_suppkey", "v", 1000.0, 1.0, 0.2, 5)
    return rounded(out.withColumns({"v": F.round("v", 4), "threshold": F.round("threshold", 4)}))


@query(
    "loo_median_shift",
    """
WITH s AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal AS v FROM supplier),
m AS (SELECT k, count(*) AS n, median(v) AS m FROM s GROUP BY k HAVING count(*) >= 2),
o AS (SELECT a.k, a.id, median(b.v) AS m FROM s a JOIN s b ON a.k = b.k AND a.id <> b.id GROUP BY ALL)
SELECT m.k::BIGINT AS s_nationkey, any_value(n) AS n, round(max(abs(o.m - m.m)), 6) + 0.0 AS shift FROM m JOIN o ON o.k = m.k GROUP BY m.k""",
)
def loo_median_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").where("s_nationkey is not null")
    shifts = statistics.leave_one_out_shifts(ordered.counted(suppliers, ["s_nationkey"], {"v": F.col("s_acctbal")}), ["s_nationkey"], {"v": "shift"})
    sizes = suppliers.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("s_acctbal").alias("__m")).where("n >= 2")
    # without a supplier that has no balance the median stays
    out = sizes.join(shifts, "s_nationkey", "left").withColumn("shift", F.when(F.col("__m") == 1, F.lit(0.0)).otherwise(F.col("shift")))
    return rounded(out.drop("__m"))


@query(
    "histogram_bins",
    """
WITH e AS (SELECT value AS v FROM events WHERE value IS NOT NULL),
r AS (SELECT least(24, greatest(8, floor(sqrt(count(*)))))::BIGINT AS k, min(v) AS a, max(v) AS b FROM e)
SELECT least(floor((v - a) / ((b - a) / k)), k - 1)::BIGINT AS bin, k AS bins, count(*) AS n FROM e, r GROUP BY ALL""",
)
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(table(spark, sf_dir, "events"), "value")
