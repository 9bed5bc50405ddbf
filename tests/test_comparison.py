"""Traces at places, profiles, sweeps and summaries against plain computations."""

import random
import statistics as st

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lapsight.operators import comparison as cmp
from lapsight.operators import series


def near(a, b):
    return (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_along_equals_numpy_over_ranges(spark, keys):
    rng = random.Random(5)
    samples = [(k, float(x), rng.random(), rng.random()) for k in ("a", None) for x in rng.sample(range(3000), 700)]
    samples += [("a", None, 1.0, 1.0), ("a", 5.0, None, 1.0)]
    grid = [(k, rng.uniform(-50, 3050)) for k in ("a", None) for _ in range(900)] + [("a", None)]
    s = spark.createDataFrame(samples, "k string, x double, u double, v double").repartition(7)
    g = spark.createDataFrame(grid + grid[:20], "k string, x double")
    found = {(r.k if keys else 0, r.x): (r.u, r.v) for r in cmp.along(s, g, keys, "x", ["u", "v"]).collect()}
    assert len(found) == len({(k if keys else 0, x) for k, x in grid if x is not None})
    for key in ("a", None) if keys else (0,):
        given = {}
        for k, x, u, v in samples:
            if None not in (x, u, v) and (not keys or k == key):
                given.setdefault(x, []).append((u, v))
        xs = sorted(given)
        for i in (0, 1):
            ys = [st.mean(p[i] for p in given[x]) for x in xs]
            asked = [x for k, x in found if k == key]
            assert all(near(found[key, x][i], y) for x, y in zip(asked, np.interp(asked, xs, ys), strict=True))


def test_along_without_samples(spark):
    s = spark.createDataFrame([], "k string, x double, v double")
    g = spark.createDataFrame([("a", 1.0)], "k string, x double")
    assert [tuple(r) for r in cmp.along(s, g, ["k"], "x", ["v"]).collect()] == [("a", 1.0, None)]
    assert cmp.along(s, g.limit(0), ["k"], "x", ["v"]).collect() == []


def test_gate_table(spark):
    gates = spark.createDataFrame([(1, 5.0, 10.0), (2, 5.0, 14.0), (3, None, 1.0), (4, 20.0, None)], "g int, s double, target double")
    traces = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, 20.0), ("c", 0.0, 99.0)], "t string, s double, v double")
    found = {r.g: r for r in cmp.gate_table(gates, traces, [], "t", ["a", "b"], "s", "v", "target", 1.0).collect()}
    assert [(found[i].a_speed, found[i].a_excess, found[i].a_complies) for i in (1, 2, 3, 4)] == [(15.0, 5.0, False), (15.0, 1.0, True), (None, None, None), (20.0, None, None)]
    assert all(found[i].b_speed is None and found[i].b_excess is None for i in found)


def test_profile_points_and_errors(spark):
    o = spark.createDataFrame([(0.0, 10.0, 8.0, 12.0), (10.0, 20.0, 16.0, 24.0)], "s double, mid double, lo double, hi double")
    p = spark.createDataFrame([("x", 5.0, 18.0), ("x", 5.0, 19.0), (None, -1.0, 8.0)], "c string, s double, v double")
    points = cmp.profile_points(o, p, "s", "v", "mid", "lo", "hi")
    assert sorted((r.v, r.error, r.inside) for r in points.collect()) == [(8.0, -2.0, True), (18.0, 3.0, True), (19.0, 4.0, False)]
    found = {r.c: r for r in cmp.profile_summary(points, "c").collect()}
    assert (found["x"].points, found["x"].mae, found["x"].share_inside) == (2, 3.5, 0.5) and near(found["x"].rmse, 12.5**0.5) and found[None].bias == -2.0
    for bad in [("x", None, 1.0), ("x", 1.0, None), ("x", 1.0, float("nan"))]:
        with pytest.raises(PySparkException, match="lacks its place or value"):
            cmp.profile_points(o, spark.createDataFrame([bad], p.schema), "s", "v", "mid", "lo", "hi").collect()


def test_sweep_places_ties_and_nulls(spark):
    rows = [(r, v, float(loss), 1.0) for r in range(4) for v, loss in (("p", r + 1), ("q", r + 1), ("s", r + 3))] + [(9, None, 1.0, 1.0), (9, "u", None, 1.0)]
    t = spark.createDataFrame(rows, "r int, v string, loss double, time double")
    found = {r.v: r for r in cmp.sweep_summary(t, "r", "v", "loss", {"loss": F.col("loss"), "time": F.col("time")}, F.col("loss") < 3, F.col("time") - 3, "time").collect()}
    assert {k: found[k].place for k in found} == {None: 1, "p": 2, "q": 2, "s": 4, "u": None}
    assert (found["s"].regret_median, found["s"].win_share, found["p"].win_share, found["p"].pass_share, found["p"].most_residual) == (2.0, 0.0, 1.0, 0.5, 2.0)


def test_summaries(spark):
    rows = [("a", "f", "x", 0.5), ("a", "f", "y", 0.5), ("a", "f", "y", 0.25), ("a", "f", "z", None), ("b", None, "x", None)]
    t = spark.createDataFrame(rows, "m string, f string, path string, s double")
    found = {r.m: tuple(r)[2:] for r in cmp.family_screening(t, "m", "f", "path", "s").collect()}
    assert found == {"a": (3, "x", 0.5, 0.5), "b": (1, None, None, None)}
    d = cmp.distribution(t, ["m"], F.col("s")).collect()
    assert [tuple(r) for r in d] == [("a", 3, 2, 0.25, pytest.approx(0.3), 0.5, 0.5, 0.5)]
    c = {r.m: r for r in cmp.case_summary(t, "m", "f", "path", {"s": F.col("s")}).collect()}
    assert (c["a"].scenarios, c["a"].draws, c["a"].f, c["a"].s_median) == (4, 3, "f", 0.5) and (c["b"].scenarios, c["b"].s_median) == (1, None)


def test_one_long_group_is_interpolated_in_one_pass(spark):
    n = 60_000
    s = spark.range(n).select((F.col("id") * 2).cast("double").alias("x"), (F.col("id") * 3).cast("double").alias("y"))
    g = spark.range(n).select((F.col("id") * 2 + 0.5).alias("x"))
    for found in (series.interpolate(s, g, [], "x", "y"), cmp.along(s, g, [], "x", ["y"])):
        wrong = F.abs(F.col("y") - F.least(F.col("x"), F.lit(2.0 * n - 2)) * 1.5) > 1e-6
        assert found.agg(F.count(F.lit(1)), F.count_if(wrong)).first() == (n, 0)
