"""Pieces, zones, baselines and entries around a closed course against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsight.operators import zones as z

L = 100.0


@pytest.fixture(scope="module")
def trace(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in "ab":
        s = np.concatenate([[0.0], np.sort(rng.uniform(0, L, 37)), [L]])
        rows += [(k, float(x), float(rng.uniform(1, 9)), float(rng.normal())) for x in s]
    return rows, spark.createDataFrame(rows, "k string, s double, v double, w double").repartition(3)


def test_totals_of_a_partition_are_those_of_the_lap(spark, trace):
    rows, df = trace
    bounds = [3.0, 3.5, 24.9, 25.0, 60.0, 99.0]  # the last goes over the finish to the first
    parts = spark.createDataFrame([(f"p{i}", a, b) for i, (a, b) in enumerate(zip(bounds, [*bounds[1:], bounds[0]], strict=True))], "name string, a double, b double")
    for cell in (7.0, 25.0, 1000.0):
        got = z.interval_totals(z.cut_segments(df, ["k"], "s", ["v", "w"], parts, "name", "a", "b", L, cell), ["k"], {"v_m": "v", "w_m": "w"}, "v").collect()
        for r in got:
            own = np.array([x[1:] for x in rows if x[0] == r["k"]])
            assert abs(r["length_m"] - L) < 1e-9 and abs(r["v_m"] - np.trapezoid(own[:, 1], own[:, 0])) < 1e-9 and abs(r["w_m"] - np.trapezoid(own[:, 2], own[:, 0])) < 1e-9
            assert (r["least"], r["greatest"]) == (own[:, 1].min(), own[:, 1].max())


def test_overlapping_intervals_and_wraps(spark, trace):
    rows, df = trace
    spans = {"wraps": (90.0, 15.0), "over": (5.0, 40.0), "whole": (20.0, 120.0), "long": (0.0, 250.0), "point": (30.0, 30.0), "none": (None, 5.0)}
    features = spark.createDataFrame([(n, a, b) for n, (a, b) in spans.items()], "name string, a double, b double")
    got = {(r["k"], r["name"]): r for r in z.interval_totals(z.cut_segments(df, ["k"], "s", ["v"], features, "name", "a", "b", L), ["k", "name"], {"v_m": "v"}, "v").collect()}
    assert {n for _, n in got} == {"wraps", "over", "whole", "long"}
    for (k, n), r in got.items():
        own = np.array([x[1:3] for x in rows if x[0] == k])
        a, b = spans[n]
        b = min(b + L * (b < a), a + L)
        fine = np.unique(np.concatenate([[a, b], own[:, 0], own[:, 0] + L]))
        fine = fine[(fine >= a) & (fine <= b)]
        at = lambda x: np.interp(np.where(x >= L, x - L, x), own[:, 0], own[:, 1])
        area = sum((q - p) * (np.interp(p % L if p >= L else p, *own.T) + np.interp(q - L if q > L else q, *own.T)) / 2 for p, q in zip(fine, fine[1:], strict=False))
        assert abs(r["length_m"] - (b - a)) < 1e-9 and abs(r["v_m"] - area) < 1e-9
        assert abs(r["entry"] - at(np.array(a))) < 1e-9 and abs(r["exit"] - np.interp(b - L if b > L else b, *own.T)) < 1e-9


def test_rows_in_zones(spark):
    places = [0.0, 0.5, 10.0, 25.0, 50.0, 99.5, 100.0, 130.0, -5.0, None]
    spans = [("a", 90.0, 10.0), ("b", 25.0, 50.0), ("c", 80.0, 100.0), ("d", 0.0, 100.0), ("e", 30.0, 130.0), ("f", 50.0, 50.0)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(places)], "i int, s double")
    zones = spark.createDataFrame(spans, "name string, a double, b double")
    for cell in (3.0, 25.0, 400.0):
        got = sorted((r["i"], r["name"]) for r in z.rows_in_zones(rows, "s", zones, "a", "b", L, cell).collect())
        want = []
        for i, p in enumerate(places):
            for n, a, b in spans:
                if p is not None:
                    width = min(b - a + L * (b < a), L)
                    if (p - a) % L <= width:
                        want.append((i, n))
        assert got == sorted(want)


def test_zone_metrics(spark):
    rows = spark.createDataFrame([("x", 1.0), ("x", None), ("x", 5.0), ("y", None)], "name string, v double")
    got = {r["name"]: r for r in z.zone_metrics(rows, ["name"], {"m": "v"}, {"f": ("v", F.col("v") > 2)}, {"c": "v"}).collect()}
    assert tuple(got["x"])[1:] == (3, 3.0, 0.5, 2 / 3) and tuple(got["y"])[1:] == (1, None, None, 0.0)


@pytest.mark.parametrize("step", [4.0, 3.3])
def test_baseline_equals_numpy(spark, step):
    rng = np.random.default_rng(8)
    s, v = np.sort(rng.uniform(0, L, 30)), rng.uniform(5, 20, 30)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(s, v, strict=True)], "k string, s double, v double")
    got = z.slowdown_baseline(df, ["k"], "s", "v", L, step, 12.0, 3.0, 5.0, 0.5).orderBy("s").collect()
    anchors = np.arange(0, L, step)
    rel = np.arange(-12.0, 5.0 + 0.25, 0.5)
    assert len(got) == len(anchors)
    for r, a in zip(got, anchors, strict=True):
        values = np.interp(a + rel, np.r_[s - L, s, s + L], np.r_[v, v, v])
        assert abs(r["approach"] - np.median(values[rel <= -3])) < 1e-9 and abs(r["local_least"] - values[np.abs(rel) <= 5].min()) < 1e-9


def test_entries_equal_numpy(spark):
    profile = spark.createDataFrame([("p", 10.0, 1.0), ("p", 20.0, 3.0), ("q", 0.0, 7.0)], "scenario string, s double, v double")
    events = spark.createDataFrame([("e", 15.0, 1.5), ("f", 99.0, 0.0), ("g", 2.0, 1.0)], "event string, start double, observed double")
    got = {(r["scenario"], r["event"]): (r["v"], r["error"]) for r in z.profile_entries(events, "start", "observed", profile, "scenario", "s", "v").collect()}
    assert got == {("p", "e"): (2.0, 0.5), ("p", "f"): (3.0, 3.0), ("p", "g"): (1.0, 0.0), ("q", "e"): (7.0, 5.5), ("q", "f"): (7.0, 7.0), ("q", "g"): (7.0, 6.0)}


def test_no_side_is_compared_with_all_of_the_other(spark, trace):
    _, df = trace
    zones = spark.range(3).selectExpr("id AS name", "id * 20.0 AS a", "id * 20.0 + 30 AS b")
    for out in (z.cut_segments(df, ["k"], "s", ["v"], zones, "name", "a", "b", L), z.rows_in_zones(df, "s", zones, "a", "b", L)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
