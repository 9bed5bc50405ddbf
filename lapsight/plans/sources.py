"""Queries of sources and sinks: rows of the test tables written in a format and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import gate_draws as gates
from lapsight.operators import robustness
from lapsight.operators.staging import shared_dir, stage
from lapsight.plans.registry import query, rounded, table
from lapsight.sources import fit, publish, tracks


@query(
    "fit_round_trip",
    """
SELECT user_id, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) - 1 AS record_index,
       CAST(floor(epoch(ts)) AS BIGINT) AS second, round(value, 3) + 0.0 AS speed FROM events""",
)
def fit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a month as a FIT file, decoded by the scan that reads such files."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) - fit.EPOCH
    rows = table(spark, sf_dir, "events").select("user_id", month, "ts", "event_id", second.alias("timestamp"), F.col("value").alias("enhanced_speed"))

    def written(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["ts", "event_id"])
        fields = ordered[["timestamp", "enhanced_speed"]].to_dict("records")
        return pd.DataFrame({"path": [f"{group['user_id'].iloc[0]}/{group['month'].iloc[0]}"], "content": [fit.encode(fields, ["timestamp", "enhanced_speed"])]})

    found = fit.decode(rows.groupBy("user_id", "month").applyInPandas(written, "path string, content binary"))
    name = F.split("source_file", "/")
    return rounded(
        found.select(
            name[0].cast("long").alias("user_id"), name[1].alias("month"), "record_index", (F.col("timestamp") + fit.EPOCH).cast("long").alias("second"), F.col("enhanced_speed").alias("speed")
        ),
        3,
    )


@query(
    "published_versions",
    """
SELECT 'nation' AS name, n_name AS entry, CAST(count(c_custkey) AS BIGINT) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT 'region', r_name, CAST(count(c_custkey) AS BIGINT) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables published together over an older version, as a reader sees them."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    nation = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").withColumn("customers", F.coalesce("customers", F.lit(0)))
    region = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum("customers").alias("customers")).join(table(spark, sf_dir, "region"), "r_regionkey", "right")
    root = f"{shared_dir(spark)}/published-{uuid.uuid4().hex[:12]}"
    tables = {"nation": nation.select(F.col("n_name").alias("entry"), "customers"), "region": region.select(F.col("r_name").alias("entry"), F.coalesce("customers", F.lit(0)).alias("customers"))}
    first = publish.publish(spark, root, {n: df.where("customers > 10") for n, df in tables.items()})
    publish.publish(spark, root, tables, expected=first)
    seen = [publish.read_table(spark, root, n).select(F.lit(n).alias("name"), "entry", "customers") for n in tables]
    return seen[0].unionByName(seen[1])


@query(
    "robustness_cases",
    """
WITH o AS (SELECT r_name, n_name, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cases AS (SELECT 'leave_out_region__' || r_name AS case_id, r_name AS gone, 0.9 AS share FROM region UNION ALL SELECT 'upper_half', NULL, 0.5 UNION ALL SELECT 'no_share', NULL, NULL)
SELECT case_id, share IS NOT NULL AS success, CASE WHEN share IS NOT NULL THEN count(*) END AS n,
       round(CASE share WHEN 0.9 THEN quantile_cont(v, 0.9) WHEN 0.5 THEN quantile_cont(v, 0.5) END, 4) + 0.0 AS high
FROM cases JOIN o ON r_name IS DISTINCT FROM gone GROUP BY case_id, share""",
)
def robustness_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A high quantile of orders' prices without each region, with another share, and in a case that cannot be computed."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    changes = [("upper_half", "policy", "share", "set", 0.5, None, None), ("no_share", "policy", "share", "set", -1.0, None, None)]
    cases = robustness.leave_out_cases(nation, "region", []).unionByName(robustness.setting_cases(spark, {"share": 0.9}, changes))

    def compute(case):
        kept = orders.where(~F.col("region").isin(case["excluded"])) if case["excluded"] else orders
        return kept.agg(F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", robustness.setting(case, "share", 0.9)).alias("high"))

    root = f"{shared_dir(spark)}/robustness-{uuid.uuid4().hex[:12]}"
    status = robustness.run_cases(cases, root, compute, workers=3)
    return rounded(status.select("case_id", "success").join(robustness.case_results(status, root).drop("category"), "case_id", "left"), 4)


@query(
    "gate_draws",
    """
WITH s AS (SELECT layout, l_linenumber AS gate, l_suppkey AS lap, avg(l_quantity) AS v FROM lineitem, (VALUES ('common'), ('gaps')) AS t(layout)
           WHERE layout = 'common' OR (l_suppkey + l_linenumber) % 7 <> 0 GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY layout, gate ORDER BY lap) - 1 AS i, count(*) OVER (PARTITION BY layout, gate) AS n FROM s),
held AS (SELECT layout, lap, count(*) AS c FROM s GROUP BY ALL),
best AS (SELECT layout, lap, row_number() OVER (PARTITION BY layout ORDER BY lap) - 1 AS j, count(*) OVER (PARTITION BY layout) AS m FROM held h WHERE c = (SELECT max(c) FROM held WHERE layout = h.layout)),
d AS (SELECT c_custkey AS replicate, layout, lap FROM customer JOIN best ON j = CAST(floor((c_custkey * 7919 + 13) % 1009 / 1009.0 * m) AS BIGINT)),
p AS (SELECT d.replicate, d.layout, g.gate, any_value(d.lap) AS lap, any_value(g.n) AS n FROM d JOIN g ON g.layout = d.layout GROUP BY ALL)
SELECT p.replicate, p.layout, p.gate, coalesce(a.lap, b.lap) AS lap, round(coalesce(a.v, b.v), 6) + 0.0 AS v, a.lap IS NULL AS independent
FROM p LEFT JOIN g a ON a.layout = p.layout AND a.gate = p.gate AND a.lap = p.lap
JOIN g b ON b.layout = p.layout AND b.gate = p.gate AND b.i = CAST(floor((p.replicate * 10473 + p.gate * 31) % 2003 / 2003.0 * p.n) AS BIGINT)""",
)
def gate_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as gates, suppliers as laps, customers as draws; once with laps that have all gates, once with none that has."""
    c = F.col
    item = table(spark, sf_dir, "lineitem").groupBy(c("l_linenumber").alias("gate"), c("l_suppkey").alias("lap")).agg(F.avg("l_quantity").alias("v"))
    draws = stage(table(spark, sf_dir, "customer").select(c("c_custkey").alias("replicate")), "draws")
    u_lap = (c("replicate") * 7919 + 13) % 1009 / 1009.0
    u_gate = (c("replicate") * 10473 + c("gate") * 31) % 2003 / 2003.0
    found = []
    for layout, samples in (("common", item), ("gaps", item.where((c("lap") + c("gate")) % 7 != 0))):
        one = gates.gate_draws(samples, draws, "gate", "v", ["lap"], u_lap=u_lap, u_gate=u_gate)
        found.append(one.withColumn("layout", F.lit(layout)))
    return rounded(found[0].unionByName(found[1]))


@query(
    "clean_fixes",
    """
WITH k AS (SELECT user_id, date_trunc('day', ts) AS t, value, coalesce(value BETWEEN 5 AND 450, false) AS ok FROM events)
SELECT user_id, CAST(epoch(t) AS BIGINT) AS second, count(*) AS fixes, round(median(value), 6) + 0.0 AS value FROM k WHERE ok GROUP BY user_id, t""",
)
def clean_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("t"), "value")
    kept, _ = tracks.clean_fixes(rows, ["user_id"], "t", ["value"], F.col("value").between(5, 450))
    second = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / 1e6)
    return rounded(kept.select("user_id", second.alias("second"), "fixes", "value"))


@query(
    "extension_values",
    """
SELECT c_custkey, c_mktsegment AS segment, CAST(c_acctbal AS VARCHAR) AS balance, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""",
)
def extension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' columns as elements of two makers, nested and repeated, read back by name."""
    c = F.col
    inner = F.concat(F.lit("<a:box><a:v unit='x'> "), c("c_acctbal").cast("string"), F.lit(" </a:v></a:box><a:v>second</a:v>"))
    nation = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("<b:v>"), c("c_nationkey").cast("string"), F.lit("</b:v>"))).otherwise("<b:v/>")
    xml = F.concat(F.lit("<seg>"), c("c_mktsegment"), F.lit("</seg>"), inner, nation)
    found = table(spark, sf_dir, "customer").select("c_custkey", tracks.extension_values(xml).alias("m"))
    return found.select("c_custkey", c("m")["seg"].alias("segment"), c("m")["a:v"].alias("balance"), c("m")["b:v"].alias("nation"))
