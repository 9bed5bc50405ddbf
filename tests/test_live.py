"""Streams of files: what is final, what is late, and going on after a stop."""

import datetime as dt

from lapsight.streaming import live

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "k string, ts timestamp, v double"


def write(spark, path, rows):
    spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), v) for k, s, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_sessions_end_late_rows_go_and_a_stream_goes_on(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    sessions = lambda: live.live_sessions(live.read_arriving(spark, path, SCHEMA, 1), "k", "ts", "v", "3 seconds", "10 seconds")
    write(spark, path, [("a", 0, 1.0), ("a", 2, 3.0), ("b", 1, 5.0), ("a", 9, 7.0)])
    assert live.run_available(sessions(), out).count() == 0  # nothing is final while the watermark is at -1 s
    write(spark, path, [("a", 30, 1.0)])
    first = sorted(tuple(r) for r in live.run_available(sessions(), out).select("k", "n", "mean").collect())
    assert first == [("a", 1, 7.0), ("a", 2, 2.0), ("b", 1, 5.0)]
    write(spark, path, [("a", 3, 100.0), ("b", 40, 2.0)])  # the first is late: its session has been given out
    write(spark, path, [("c", 90, 2.0)])
    last = sorted(tuple(r) for r in live.run_available(sessions(), out).select("k", "n", "mean").collect())
    assert last == [*first[:1], ("a", 1, 1.0), *first[1:], ("b", 1, 2.0)] or last == sorted([*first, ("a", 1, 1.0), ("b", 1, 2.0)])


def test_bins(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [("a", 0, 1.0), ("a", 9, None), ("a", 10, 4.0), ("a", 100, 0.0)])
    got = live.run_available(live.live_bins(live.read_arriving(spark, path, SCHEMA), "k", "ts", "v"), f"{tmp_path}/out").orderBy("start").collect()
    assert [(r["n"], r["least"], r["greatest"]) for r in got] == [(2, 1.0, 1.0), (1, 4.0, 4.0)]
