"""Queries on a study's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import reports
from lapsight.plans.registry import query, rounded, table


@query(
    "energy_accounting",
    """
WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag AS d, l_extendedprice * l_discount AS a, l_extendedprice * l_tax AS b, l_quantity * 10 AS c,
                  l_extendedprice * l_discount + l_extendedprice * l_tax + l_quantity * 10 AS t FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, d, sum(t) AS t FROM p GROUP BY ALL),
x AS (SELECT p.*, s.t AS whole FROM p JOIN s USING (l_orderkey, l_linenumber, d)),
l AS (SELECT d, 'discount' AS component, a AS v, a / nullif(whole, 0) AS share FROM x UNION ALL SELECT d, 'tax', b, b / nullif(whole, 0) FROM x
      UNION ALL SELECT d, 'handling', c, c / nullif(whole, 0) FROM x)
SELECT d AS l_returnflag, component, count(v) AS n, round(quantile_cont(v, 0.1), 4) + 0.0 AS p10, round(median(v), 4) + 0.0 AS median,
       round(quantile_cont(v, 0.9), 4) + 0.0 AS p90, round(median(share), 5) + 0.0 AS share_median FROM l GROUP BY ALL""",
)
def energy_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {"a": F.col("l_extendedprice") * F.col("l_discount"), "b": F.col("l_extendedprice") * F.col("l_tax"), "c": F.col("l_quantity") * 10}
    )
    out = reports.energy_accounting(rows, ["l_orderkey", "l_linenumber"], "l_returnflag", {"discount": "a", "tax": "b", "handling": "c"})
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("p10", "median", "p90")}), 5)


@query(
    "convergence_by_metric",
    """
WITH r AS (SELECT event_type AS k, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n
           FROM events WHERE value IS NOT NULL),
a AS (SELECT k, max(n) AS n, median(v) AS m, quantile_cont(v, [0.1, 0.5, 0.9]) FILTER (i <= n // 2) AS a, quantile_cont(v, [0.1, 0.5, 0.9]) FILTER (i > n // 2) AS b FROM r GROUP BY k),
c AS (SELECT k, n, m, abs(a[2] - b[2]) / abs(m) AS mc, greatest(abs(a[1] - b[1]), abs(a[3] - b[3])) / abs(m) AS tc FROM a)
SELECT k AS event_type, n, round(m, 6) + 0.0 AS median, round(mc, 6) + 0.0 AS median_change, round(tc, 6) + 0.0 AS tail_change,
       CASE WHEN n < 4 THEN 'too_few' WHEN mc <= 0.05 AND tc <= 0.1 THEN 'stable' ELSE 'unsettled' END AS status FROM c""",
)
def convergence_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value is not null")
    return rounded(reports.convergence_by_metric(events, ["event_type"], ["event_id"], "value", (0.05, 0.1)))


@query(
    "quality_summary",
    """
SELECT count(*) AS n, bool_and(l_discount <= 0.1) AS discount_all, round(avg((l_discount <= 0.1)::INT), 6) + 0.0 AS discount_share,
       bool_and(l_quantity >= 2) AS quantity_all, round(avg((l_quantity >= 2)::INT), 6) + 0.0 AS quantity_share,
       round(max(greatest(abs(l_discount - 0.05), abs(l_tax - 0.04))), 6) + 0.0 AS residual_max FROM lineitem""",
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"d": F.col("l_discount") - 0.05, "t": F.col("l_tax") - 0.04})
    checks = {"discount": F.col("l_discount") <= 0.1, "quantity": F.col("l_quantity") >= 2}
    return rounded(reports.quality_summary(rows, checks, {"residual": ["d", "t"]}))


@query(
    "decision_summary",
    """
WITH r AS (SELECT l_returnflag AS d, median(l_extendedprice) AS m, avg(l_quantity) AS v FROM lineitem GROUP BY 1),
i AS (SELECT l_returnflag AS d, avg((l_discount > 0.04)::INT) AS low FROM lineitem GROUP BY 1),
b AS (SELECT arg_min(d, struct_pack(m := m, d := d)) AS d, arg_min(v, struct_pack(m := m, d := d)) AS v, min(m) AS m, min(v) AS a, max(v) AS z, count(*) AS n FROM r)
SELECT b.d AS design, round(v, 6) + 0.0 AS value, round(m, 6) + 0.0 AS median, n AS designs, low > 0.5 AS clear, v = a OR v = z AS at_boundary,
       CASE WHEN NOT low > 0.5 THEN 'no_clear_winner' WHEN v = a OR v = z THEN 'winner_at_boundary' ELSE 'clear_winner' END AS status FROM b JOIN i USING (d)""",
)
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "design")
    ranked = lines.groupBy("design").agg(F.median("l_extendedprice").alias("median"), F.avg("l_quantity").alias("value"))
    intervals = lines.groupBy("design").agg(F.avg((F.col("l_discount") > 0.04).cast("double")).alias("low"))
    return rounded(reports.decision(ranked, intervals, "design", "median", "low", "value"))


#: All brands of the tables; a pivot has a column for each.
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "importance_matrix",
    f"""
WITH s AS (SELECT p_type AS p, p_brand AS m, stddev_samp(p_retailprice) AS s FROM part GROUP BY ALL),
t AS (SELECT p FROM s GROUP BY p ORDER BY max(s) DESC, p LIMIT 3)
SELECT p AS p_type, {", ".join(f"round(coalesce(max(s) FILTER (m = '{b}'), 0), 4) + 0.0 AS \"{b}\"" for b in BRANDS)}
FROM s WHERE p IN (SELECT p FROM t) GROUP BY p""",
)
def importance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.stddev_samp("p_retailprice").alias("s"))
    return rounded(reports.importance_matrix(scores, "p_type", "p_brand", "s", BRANDS, 3), 4)


@query(
    "ordered_union",
    """
WITH a AS (SELECT l_suppkey AS k, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS o FROM lineitem GROUP BY 1 QUALIFY o <= 10),
b AS (SELECT l_suppkey AS k, row_number() OVER (ORDER BY sum(l_tax * l_quantity) DESC, l_suppkey) AS o FROM lineitem GROUP BY 1 QUALIFY o <= 10),
u AS (SELECT k, 0 AS l, o FROM a UNION ALL SELECT k, 1, o FROM b), m AS (SELECT k, min(l * 1000 + o) AS p FROM u GROUP BY k)
SELECT k AS l_suppkey, row_number() OVER (ORDER BY p, k) AS rank FROM m QUALIFY rank <= 12""",
)
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a"), F.sum(F.col("l_tax") * F.col("l_quantity")).alias("b"))
    top = lambda c: sums.withColumn("o", F.row_number().over(w.orderBy(F.desc(c), "l_suppkey"))).where("o <= 10")
    return rounded(reports.ordered_union(top("a"), top("b"), "l_suppkey", "o", 12))


@query(
    "stability_corridor",
    """
WITH o AS (SELECT l_quantity AS n, l_extendedprice - 30000 AS x, l_returnflag <> 'R' AS s FROM lineitem)
SELECT n AS l_quantity, round(coalesce(quantile_cont(x, 0.1) FILTER (s), quantile_cont(x, 0.1)), 4) + 0.0 AS low,
       round(coalesce(quantile_cont(x, 0.9) FILTER (s), quantile_cont(x, 0.9)), 4) + 0.0 AS high,
       round(quantile_cont(x, 0.1), 4) + 0.0 AS all_low, round(quantile_cont(x, 0.9), 4) + 0.0 AS all_high FROM o GROUP BY n""",
)
def stability_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"x": F.col("l_extendedprice") - 30000, "ok": F.col("l_returnflag") != "R"})
    return rounded(reports.stability_corridor(rows, "l_quantity", "x", "ok"), 4)
