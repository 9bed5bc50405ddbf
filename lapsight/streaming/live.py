"""The same computations on arriving rows, with Structured Streaming (an extension; the batch operators need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def live_sessions(points: DataFrame, key: str, ts: str, value: str, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """Gap-separated sessions per key: begin, end, rows and mean value; rows that come later than ``late`` are dropped by the watermark."""
    session = F.session_window(ts, gap)
    return points.withWatermark(ts, late).groupBy(key, session.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean"
    )


def live_bins(points: DataFrame, key: str, ts: str, value: str, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Fixed windows per key: rows, least and greatest value."""
    return points.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest")
    ).select(key, F.col("w.start").alias("start"), "n", "least", "greatest")


def read_arriving(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """Parquet files below ``path`` as a stream, ``files`` of them to a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run_available(results: DataFrame, folder: str) -> DataFrame:
    """The rows that are final once all that has arrived is read, from a sink below ``folder``.

    The stream's offsets and state are kept there too: called again with the
    same folder, it goes on with what has arrived since and returns all rows.
    """
    query = results.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return results.sparkSession.read.schema(results.schema).parquet(f"{folder}/rows")
