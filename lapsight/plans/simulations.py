"""Queries with seeded draws; SQL cannot reproduce their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.functions import distributions
from lapsight.operators import ranking, uncertainty
from lapsight.plans.registry import query, table


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v"))
    return uncertainty.bootstrap_quantiles(orders, ["o_orderpriority"], "v", seed=11)


@query("paired_bootstrap")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("price"))
    paired = ranking.with_regret(ranking.complete_scenarios(fact, "l_suppkey", "l_returnflag"), ["l_suppkey"], "price")
    return uncertainty.paired_bootstrap(paired.withColumn("study", F.lit("price")), ["study"], "l_suppkey", "l_returnflag", "regret", "shared_win", seed=3)


@query("slope_bootstrap")
def slope_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncertainty.slope_bootstrap(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], "l_quantity", "l_extendedprice", 7, 200)


@query("scenario_draws")
def scenario_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniforms for inputs named by part types, turned into triangular values of their size ranges."""
    ranges = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_size").alias("a"), F.avg("p_size").alias("m"), F.max("p_size").alias("b"))
    paths = sorted(r[0] for r in ranges.select("p_type").collect())
    draws = uncertainty.uniforms(spark, 5, 200, paths[2:], {"pair": (paths[:2], [[1.0, 0.6], [0.6, 1.0]])})
    joined = draws.join(ranges, draws["path"] == ranges["p_type"])
    value = distributions.triangular_ppf(F.col("u"), F.col("a").cast("double"), F.col("m"), F.col("b").cast("double"))
    return joined.select("replicate", "path", "u", value.alias("value"))
