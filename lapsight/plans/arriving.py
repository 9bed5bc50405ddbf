"""Queries on the events table as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators.staging import shared_dir
from lapsight.plans.registry import query, rounded
from lapsight.streaming import live

EVENTS = "event_id long, user_id long, ts timestamp_ntz, value double"


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.read_arriving(spark, f"{sf_dir}/events.parque[t]", EVENTS)  # a pattern may be one file, a plain path must be a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "live_sessions",
    """
WITH o AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o),
a AS (SELECT user_id, min(ts) AS b, max(ts) + INTERVAL 8 HOUR AS e, count(*) AS n, avg(value) AS m FROM s GROUP BY user_id, g)
SELECT user_id, CAST(epoch_us(b) AS BIGINT) AS start_us, CAST(epoch_us(e) AS BIGINT) AS end_us, n, round(m, 6) + 0.0 AS mean FROM a WHERE e <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are final when all events have arrived: those that end a day before the last event."""
    found = live.run_available(live.live_sessions(_arriving(spark, sf_dir), "user_id", "ts", "value", "8 hours", "1 day"), f"{shared_dir(spark)}/live-{uuid.uuid4().hex[:12]}")
    return rounded(found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "mean"))


@query(
    "live_bins",
    """
SELECT user_id, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, count(*) AS n, min(value) AS least, max(value) AS greatest FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def live_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.run_available(live.live_bins(_arriving(spark, sf_dir), "user_id", "ts", "value", "1 day", "1 day"), f"{shared_dir(spark)}/live-{uuid.uuid4().hex[:12]}")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), "n", "least", "greatest")
