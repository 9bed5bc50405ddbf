"""Queries on scores of gates: nations as gates, priorities as vehicles, orders as passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import gate_scores as scores
from lapsight.plans.registry import query, rounded, table

SETTINGS = {
    "minimum_passes": 40.0, "cv_scale": 2.0, "pace_scale": 0.8, "spread_scale": 0.8, "error_scale": 20.0, "high": 66.0, "medium": 58.0, "accept": 60.0,
    "accept_evidence": 0.3, "accept_cv": 0.65, "accept_pace": 0.05, "little_evidence": 0.28, "much_evidence": 0.36, "stable_cv": 0.58,
}
WEIGHTS = {"sample": 0.15, "stability": 0.2, "evidence": 0.25, "pace": 0.15, "position": 0.15, "vehicle": 0.1}


@query(
    "gate_scores",
    """
WITH p AS (SELECT c_nationkey AS g, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS v, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS t,
                  o_totalprice > 200000 AS e, CASE WHEN o_orderkey % 7 <> 0 THEN c_acctbal END AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3),
q AS (SELECT g, count(t) AS n, stddev_samp(t) AS sd, avg(e::INT) AS ev, quantile_cont(t, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM p GROUP BY g),
r AS (SELECT g, t, d, rank() OVER (PARTITION BY g ORDER BY t) + (count(*) OVER (PARTITION BY g, t) - 1) / 2.0 AS rt,
             rank() OVER (PARTITION BY g ORDER BY -d) + (count(*) OVER (PARTITION BY g, d) - 1) / 2.0 AS rd FROM p WHERE t IS NOT NULL AND d IS NOT NULL),
s AS (SELECT g, CASE WHEN count(*) >= 4 AND count(DISTINCT t) > 1 AND count(DISTINCT d) > 1 THEN corr(rt, rd) END AS c FROM r GROUP BY g),
m AS (SELECT g, count(m) AS vehicles, max(m) - min(m) AS apart FROM (SELECT g, v, median(t) AS m FROM p WHERE v IS NOT NULL GROUP BY ALL) GROUP BY g),
k AS (SELECT n_nationkey AS gate, n_regionkey / 4.0 AS explicit, CASE WHEN n_nationkey <> 5 THEN n_nationkey::DOUBLE END AS error_m, coalesce(n, 0) AS n, coalesce(vehicles, 0) AS vehicles,
             coalesce(ev, 0.0) AS ev, q, c, CASE WHEN n > 0 THEN coalesce(sd, 0.0) / greatest(q[3], 1e-9) END AS cv,
             CASE WHEN vehicles >= 2 AND q[3] > 0 THEN apart / q[3] END AS sp, greatest(0.0, coalesce(c, 0.5)) AS pc
      FROM nation LEFT JOIN q ON q.g = n_nationkey LEFT JOIN s ON s.g = n_nationkey LEFT JOIN m ON m.g = n_nationkey),
x AS (SELECT *, least(1.0, n / 80.0) AS s1, least(1.0, greatest(0.0, coalesce(1 - cv / 2.0, 0.0))) AS s2, least(1.0, greatest(0.0, 1 - pc / 0.8)) AS s4,
             least(1.0, greatest(0.0, 0.45 + 0.4 * explicit + 0.15 * (1 - coalesce(error_m, 20.0) / 20.0))) AS s5, least(1.0, greatest(0.0, coalesce(1 - sp / 0.8, 0.5))) AS s6 FROM k),
y AS (SELECT *, 100 * (0.15 * s1 + 0.2 * s2 + 0.25 * ev + 0.15 * s4 + 0.15 * s5 + 0.1 * s6) AS score FROM x),
z AS (SELECT *, n >= 40 AND score >= 60 AND ev >= 0.3 AND coalesce(cv <= 0.65, false) AND pc <= 0.05 AS accepted FROM y)
SELECT gate, round(explicit, 6) + 0.0 AS explicit, round(error_m, 6) + 0.0 AS error_m, n, vehicles, round(ev, 6) + 0.0 AS evidence_score,
       round(q[1], 5) + 0.0 AS p10, round(q[2], 5) + 0.0 AS p25, round(q[3], 5) + 0.0 AS middle, round(q[4], 5) + 0.0 AS p75, round(q[5], 5) + 0.0 AS p90, round(q[4] - q[2], 5) + 0.0 AS iqr,
       round(c, 6) + 0.0 AS pace_correlation, round(cv, 6) + 0.0 AS cv, round(sp, 6) + 0.0 AS vehicle_spread, round(s1, 6) + 0.0 AS sample_score, round(s2, 6) + 0.0 AS stability_score,
       round(s4, 6) + 0.0 AS pace_score, round(s5, 6) + 0.0 AS position_score, round(s6, 6) + 0.0 AS vehicle_score, round(score, 6) + 0.0 AS score,
       CASE WHEN n < 40 THEN 'insufficient' WHEN score >= 66 THEN 'high' WHEN score >= 58 THEN 'medium' ELSE 'low' END AS confidence, accepted,
       CASE WHEN accepted THEN 'gate' WHEN ev < 0.28 THEN 'no_gate' ELSE 'review' END AS advice,
       concat_ws(';', CASE WHEN cv <= 0.58 THEN 'stable' WHEN cv > 0.65 THEN 'variable' END, CASE WHEN ev >= 0.36 THEN 'repeatable' WHEN ev < 0.28 THEN 'little_evidence' END,
                 CASE WHEN pc > 0.05 THEN 'rises_with_pace' END, CASE WHEN explicit < 1 THEN 'assumed_extent' END, CASE WHEN vehicles < 2 THEN 'single_vehicle' END) AS reasons
FROM z""",
)
def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    passes = orders.join(customers.where("c_nationkey <> 3"), c("o_custkey") == c("c_custkey")).select(
        c("c_nationkey").alias("gate"), F.when(c("o_orderkey") % 17 != 0, c("o_orderpriority")).alias("vehicle"), F.when(c("o_orderkey") % 13 != 0, c("o_totalprice")).alias("target"),
        (c("o_totalprice") > 200000).alias("slowed"), F.when(c("o_orderkey") % 7 != 0, c("c_acctbal")).alias("lap_s"),
    )
    gates = nations.select(c("n_nationkey").alias("gate"), (c("n_regionkey") / 4.0).alias("explicit"), F.when(c("n_nationkey") != 5, c("n_nationkey") * 1.0).alias("error_m"))
    out = scores.gate_scores(gates, passes, "gate", "vehicle", "target", "slowed", "lap_s", SETTINGS, WEIGHTS)
    return rounded(out.withColumns({n: F.round(n, 5) for n in (*scores.SHARES, "iqr")}))


#: A metric that no row has is left out.
DEFINITIONS = {"l_quantity": ("Quantity", "pieces"), "l_extendedprice": ("Price", "currency"), "l_discount": ("Discount", "1"), "l_weight": ("Weight", "kg")}


@query(
    "labelled_metrics",
    """
WITH a AS (SELECT l_returnflag, sum(l_quantity) AS q, sum(l_extendedprice) AS p, avg(l_discount) AS d FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, 'l_quantity' AS metric, 'Quantity' AS label, round(q, 4) + 0.0 AS value, 'pieces' AS unit FROM a
UNION ALL SELECT l_returnflag, 'l_extendedprice', 'Price', round(p, 1) + 0.0, 'currency' FROM a UNION ALL SELECT l_returnflag, 'l_discount', 'Discount', round(d, 4) + 0.0, '1' FROM a""",
)
def labelled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("l_quantity"), F.round(F.sum("l_extendedprice"), 1).alias("l_extendedprice"), F.avg("l_discount").alias("l_discount")
    )
    return rounded(scores.labelled_metrics(sums, ["l_returnflag"], DEFINITIONS), 4)
