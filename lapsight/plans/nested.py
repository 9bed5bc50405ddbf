"""Queries of nested JSON that Spark makes of the test tables, and of priors' tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.functions import distributions, nested
from lapsight.plans.registry import query, rounded, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and its lines as one JSON text; every 97th is cut short."""
    c = F.col
    line = F.struct(c("l_suppkey").alias("supplier"), (c("l_returnflag") == "R").alias("returned"), F.struct(c("l_quantity").alias("amount")).alias("quantity"), c("l_linestatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    text = F.to_json(F.struct(c("l_orderkey").alias("id"), c("lines")))
    cut = F.when(c("l_orderkey") % 97 == 0, F.expr("substring(text, 1, length(text) - 2)")).otherwise(c("text"))
    return lines.select("l_orderkey", text.alias("text")).withColumn("text", cut)


@query(
    "json_inventory",
    """
SELECT l_orderkey, l_orderkey % 97 = 0 AS malformed, CASE WHEN l_orderkey % 97 <> 0 THEN count(*) END AS lines, CASE WHEN l_orderkey % 97 <> 0 THEN count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') END AS returned,
       CASE WHEN l_orderkey % 97 <> 0 THEN CAST(0 AS BIGINT) END AS nowhere, CASE WHEN l_orderkey % 97 <> 0 THEN l_orderkey END AS id FROM lineitem GROUP BY l_orderkey""",
)
def json_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"lines": ("$.lines", {}), "returned": ("$.lines", {"returned": True, "status": "F"}), "nowhere": ("$.lines.of.nothing", {})}
    return nested.inventory(_documents(spark, sf_dir), "text", counts, {"id": ("$.id", "long")}).drop("text")


@query(
    "json_evidence",
    """
SELECT l_orderkey % 5 AS part, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_orderkey) FILTER (l_orderkey % 97 = 0) AS malformed, count(*) FILTER (l_orderkey % 97 <> 0) AS items,
       count(DISTINCT (l_suppkey, l_linestatus)) FILTER (l_orderkey % 97 <> 0) AS identities, count(*) FILTER (l_orderkey % 97 <> 0 AND l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1""",
)
def json_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir).withColumn("part", F.col("l_orderkey") % 5)
    return nested.evidence(documents, ["part"], "text", "$.lines", {"supplier": ("$.supplier", "long"), "status": ("$.status", "string")}, {"returned": ("$.returned", "boolean", True)})


@query(
    "impossible_tails",
    """
SELECT p_partkey, round((p_retailprice - 900) / (p_size * 20.0), 6) + 0.0 AS deviations, (p_retailprice - 900) / (p_size * 20.0) < 4.753424308822899 AS impossible FROM part""",
)
def impossible_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as means of normal priors that may not fall below 900: more than a millionth of the prior below is a violation."""
    mean, sd = F.col("p_retailprice"), F.col("p_size") * 20.0
    share = distributions.impossible_tail(mean, sd, lower=F.lit(900.0))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", ((mean - 900) / sd).alias("deviations"), (share > 1e-6).alias("impossible")))
