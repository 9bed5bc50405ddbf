"""Queries on evidence for repeatable responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import evidence
from lapsight.plans.registry import query, rounded, table

SETTINGS = {
    "target_passes": 5000.0,
    "minimum_passes": 3.0,
    "repeatability_scale": 400.0,
    "slowdown_threshold": 100.0,
    "agreement_scale": 200.0,
    "accept_score": 60.0,
    "review_score": 40.0,
    "spacing": 2.0,
}
WEIGHTS = {"pass_score": 0.2, "repeatability": 0.2, "braking": 0.25, "pace_independence": 0.15, "agreement": 0.2}

_PASSES = """
p AS (SELECT o_orderpriority AS e, c_nationkey AS g, o_totalprice / 1000 AS entry, o_totalprice / 1000 - c_acctbal / 40 AS low, c_acctbal / 100 AS pace,
             (o_orderkey % 11)::DOUBLE AS place FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    price = F.col("o_totalprice") / 1000
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        "o_orderpriority",
        "c_nationkey",
        price.alias("entry"),
        (price - F.col("c_acctbal") / 40).alias("low"),
        (F.col("c_acctbal") / 100).alias("pace"),
        (F.col("o_orderkey") % 11).cast("double").alias("place"),
    )


@query(
    "gate_evidence",
    f"WITH {_PASSES},"
    """
s AS (SELECT e, CASE WHEN count(m) >= 2 THEN max(m) - min(m) END AS spread FROM (SELECT e, g, median(entry) AS m FROM p GROUP BY ALL) GROUP BY e),
a AS (SELECT e, count(*) AS n, count(DISTINCT g) AS groups, quantile_cont(entry, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q, avg(entry) AS mean, stddev_samp(entry) AS dev,
             avg((entry - low >= 100)::INT) AS braking, median(entry - low) AS slow, corr(entry, pace) AS c FROM p GROUP BY e),
c AS (SELECT *, least(1.0, n / 5000.0) AS c1, greatest(0.0, 1 - (q[4] - q[2]) / 400.0) AS c2, 1 - abs(coalesce(c, 0.5)) AS c4,
             coalesce(greatest(0.0, 1 - spread / 200.0), 0.5) AS c5 FROM a JOIN s USING (e)),
t AS (SELECT *, 100 * (0.2 * c1 + 0.2 * c2 + 0.25 * braking + 0.15 * c4 + 0.2 * c5) AS score FROM c)
SELECT e AS o_orderpriority, n AS pass_count, groups AS group_count, round(mean, 6) + 0.0 AS entry_mean, round(dev, 6) + 0.0 AS entry_deviation,
       round(braking, 6) + 0.0 AS braking, round(slow, 6) + 0.0 AS slowdown_median, round(spread, 6) + 0.0 AS spread, round(q[1], 6) + 0.0 AS entry_p10,
       round(q[2], 6) + 0.0 AS entry_p25, round(q[3], 6) + 0.0 AS entry_median, round(q[4], 6) + 0.0 AS entry_p75, round(q[5], 6) + 0.0 AS entry_p90,
       round(c1, 6) + 0.0 AS pass_score, round(c2, 6) + 0.0 AS repeatability, round(c4, 6) + 0.0 AS pace_independence, round(c5, 6) + 0.0 AS agreement,
       round(score, 6) + 0.0 AS score,
       CASE WHEN braking >= 0.75 AND slow >= 1.5 THEN 'strong' WHEN braking >= 0.5 OR slow >= 1.0 THEN 'moderate' ELSE 'weak' END AS slowdown_signature,
       CASE WHEN n < 3 THEN 'recommended_review' WHEN score >= 60 THEN 'accepted' WHEN score >= 40 THEN 'recommended_review' ELSE 'rejected' END AS recommendation
FROM t""",
)
def gate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.gate_evidence(_passes(spark, sf_dir), "o_orderpriority", "c_nationkey", "entry", "low", "pace", SETTINGS, WEIGHTS))


@query(
    "cross_group_agreement",
    f"WITH {_PASSES},"
    """
m AS (SELECT e, g, median(entry) AS m FROM p GROUP BY ALL)
SELECT e AS o_orderpriority, count(m) AS groups, round(CASE WHEN count(m) >= 2 THEN max(m) - min(m) END, 6) + 0.0 AS spread FROM m GROUP BY e""",
)
def cross_group_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.spread_between_groups(_passes(spark, sf_dir), "o_orderpriority", "c_nationkey", "entry"))


@query(
    "sustained_response",
    """
WITH p AS (SELECT l_suppkey AS e, l_extendedprice / 1000 AS entry, l_extendedprice / 1000 - l_quantity * 4 AS low, (l_orderkey % 7)::DOUBLE AS place FROM lineitem),
m AS (SELECT e, count(*) AS n, count(*) FILTER (entry - low >= 100) AS x, quantile_cont(low, 0.75) - quantile_cont(low, 0.25) AS si,
             quantile_cont(place, 0.75) - quantile_cont(place, 0.25) AS pi, list(low ORDER BY low) AS ls, list(place ORDER BY place) AS ps FROM p GROUP BY e),
w AS (SELECT *, list_aggregate(ls, 'median') AS lm, list_aggregate(ps, 'median') AS pm,
             CASE WHEN x = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(x, n + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0))))) END AS p FROM m),
q AS (SELECT *, list_max(list_transform(range(1, n + 1), lambda i: abs(list_aggregate(list_concat(ls[:i - 1], ls[i + 1:]), 'median') - lm))) AS sd,
             list_max(list_transform(range(1, n + 1), lambda i: abs(list_aggregate(list_concat(ps[:i - 1], ps[i + 1:]), 'median') - pm))) AS pd FROM w)
SELECT e AS l_suppkey, n, x AS successes, round(si, 4) + 0.0 AS speed_iqr, round(pi, 4) + 0.0 AS place_iqr, round(p, 4) + 0.0 AS p_value,
       round(sd, 4) + 0.0 AS speed_shift, round(pd, 4) + 0.0 AS place_shift FROM q""",
)
def sustained_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / 1000
    passes = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", price.alias("entry"), (price - F.col("l_quantity") * 4).alias("low"), (F.col("l_orderkey") % 7).cast("double").alias("place")
    )
    out = evidence.sustained_response(passes, "l_suppkey", "entry", "low", "place", SETTINGS)
    return rounded(out.select("l_suppkey", "n", "successes", "speed_iqr", "place_iqr", "p_value", "speed_shift", "place_shift"), 4)


@query(
    "baseline_percentile",
    """
WITH b AS (SELECT s_acctbal AS v FROM supplier WHERE s_acctbal IS NOT NULL)
SELECT c_custkey, c_acctbal, round((SELECT count(*) FROM b WHERE v <= c_acctbal) / (SELECT count(*) FROM b), 6) + 0.0 AS share FROM customer""",
)
def baseline_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return rounded(evidence.share_at_most(customers, "c_custkey", "c_acctbal", suppliers, "s_acctbal"))


@query(
    "jaccard_sets",
    """
WITH i AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), b AS (SELECT p FROM i WHERE s = 0),
c AS (SELECT s, count(*) AS own, count(b.p) AS common FROM i LEFT JOIN b ON i.p = b.p GROUP BY s)
SELECT s AS l_suppkey, own, common, round(common / (own + (SELECT count(*) FROM b) - common), 6) + 0.0 AS jaccard,
       round(common / (SELECT count(*) FROM b), 6) + 0.0 AS retained, own - common AS new_items FROM c""",
)
def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.set_agreement(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 0))


@query(
    "interval_metrics",
    """
WITH s AS (SELECT l_suppkey AS k, l_quantity - 25 AS rel, l_extendedprice AS v FROM lineitem),
b AS (SELECT k, median(v) FILTER (rel BETWEEN -24 AND -10) AS approach, median(v) FILTER (rel BETWEEN -9 AND 0) AS entry,
             min(struct_pack(v := v, "at" := rel)) AS low FROM s GROUP BY k),
r AS (SELECT s.k, min(rel) AS back FROM s JOIN b ON s.k = b.k WHERE rel > b.low['at'] AND v >= 0.98 * approach GROUP BY s.k)
SELECT b.k AS l_suppkey, round(approach, 4) + 0.0 AS approach, round(entry, 4) + 0.0 AS entry, round(low['v'], 4) + 0.0 AS least, low['at'] + 0.0 AS least_at,
       back - low['at'] + 0.0 AS recovery FROM b LEFT JOIN r USING (k)""",
)
def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").withColumn("rel", F.col("l_quantity") - 25)
    windows = {"approach": (-24.0, -10.0), "entry": (-9.0, 0.0)}
    return rounded(evidence.interval_metrics(samples, ["l_suppkey"], "rel", "l_extendedprice", windows), 4)


@query(
    "stability_by_case",
    """
WITH c AS (SELECT l_suppkey AS g, l_returnflag AS c, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
a AS (SELECT g, count(*) FILTER (c <> 'N') AS cases, bool_or(c = 'N' AND v > 38000) AS na, avg((v > 38000)::INT) FILTER (c <> 'N') AS s,
             quantile_cont(v, 0.1) FILTER (c <> 'N') AS a, quantile_cont(v, 0.9) FILTER (c <> 'N') AS b FROM c GROUP BY g)
SELECT g AS l_suppkey, cases, na AS nominal_accepted, round(s, 6) + 0.0 AS accepted_share, round(a, 4) + 0.0 AS score_p10, round(b, 4) + 0.0 AS score_p90,
       CASE WHEN na AND coalesce(s, 0) >= 0.8 THEN 'core' WHEN na OR coalesce(s, 0) >= 0.5 THEN 'conditional' WHEN coalesce(s, 0) >= 0.2 THEN 'near_miss' ELSE 'unsupported' END AS frontier
FROM a""",
)
def stability_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    out = evidence.stability_by_case(cases.withColumn("ok", F.col("v") > 38000), "l_suppkey", "l_returnflag", "N", "ok", "v")
    return rounded(out.withColumns({"score_p10": F.round("score_p10", 4), "score_p90": F.round("score_p90", 4)}))
