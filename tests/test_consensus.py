"""Lines of the others, outlying laps and the rounds of the consensus, against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsight.operators import consensus as c

CORNERS = [(0, 0), (0, 100), (100, 100), (130, 70), (100, 40), (100, 0), (0, 0)]


def laps(spark, n=7, cutter=(6,), samples=12, noise=0.15):
    rows = []
    for lap in range(n):
        way = [p for p in CORNERS if not (lap in cutter and p == (130, 70))]
        at = 0
        for a, b in zip(way, way[1:], strict=False):
            for k in range(samples + (b == way[-1])):
                share = k / samples
                rows.append((lap, at, a[0] + (b[0] - a[0]) * share + (lap - n / 2) * noise, a[1] + (b[1] - a[1]) * share + 0.1 * math.sin(lap), "x"))
                at += 1
    return spark.createDataFrame(rows, "lap_id int, i int, x_m double, y_m double, node string").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8])
def test_medians_of_the_others(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 5)), 1)  # with ties
    y = rng.normal(size=(n, 5))
    rows = [(lap, node, float(x[lap, node]), float(y[lap, node])) for lap in range(n) for node in range(5)] + [(0, 9, None, 1.0)]
    got = c.left_out(spark.createDataFrame(rows, "lap int, node int, x_m double, y_m double"), "lap").collect()
    assert len(got) == 5 * n
    for r in got:
        for name, v in (("x_m", x), ("y_m", y)):
            column = v[:, r["node"]]
            assert abs(r[f"line_{name}"] - np.median(column)) < 1e-12
            others = np.delete(column, r["lap"])
            assert (r[f"others_{name}"] is None) if n == 1 else abs(r[f"others_{name}"] - np.median(others)) < 1e-12


def test_three_rules(spark):
    """One lap for each rule, and laps just short of each; at most a share leaves, the most severe first."""
    plain = [(i, 1.0 + 0.01 * i, 0.01, 0.5, 0) for i in range(14)]
    odd = [(20, 2.0, 0.25, 0.5, 0), (21, 30.0, 0.06, 0.5, 0), (22, 2.0, 0.06, 9.0, 0), (23, 16.0, 0.0, 0.5, 1), (24, 14.0, 0.0, 0.5, 1), (25, 30.0, 0.04, 9.0, 0)]
    rows = spark.createDataFrame(plain + odd + [(30, None, None, None, None)], "lap int, p95_m double, sustained double, shift_m double, backward long")
    every = c.outlying_laps(rows, "lap", c.Rules(most_share=0.5)).collect()
    assert {r["lap"] for r in every} == {20, 21, 22, 23}
    severity = [r["severity"] for r in every]
    assert severity == sorted(severity, reverse=True)
    few = c.outlying_laps(rows, "lap", c.Rules(most_share=0.1)).collect()
    assert [r["lap"] for r in few] == [r["lap"] for r in every[:2]]
    assert c.outlying_laps(rows, "lap", c.Rules(minimum_laps=21)).count() == 0
    assert c.outlying_laps(rows.limit(0), "lap").count() == 0


def test_a_cut_corner_is_excluded(spark):
    found = c.consensus(laps(spark), "lap_id", "i", c.Rules(p95_limit_m=3.0, sustained_error_m=3.0))
    rows = {r["lap_id"]: r for r in found.laps.collect()}
    assert {i for i, r in rows.items() if r["included"]} == set(range(6))
    assert rows[6]["excluded_in"] == 1 and rows[6]["severity"] > 0 and not rows[6]["reference"]
    assert sum(r["reference"] for r in rows.values()) == 1 and found.converged
    assert found.line.where("y_m between 55 and 85").agg(F.max("x_m")).first()[0] > 120
    length = sum(math.dist(a, b) for a, b in zip(CORNERS, CORNERS[1:], strict=False))
    xy = found.line.orderBy("node").select("x_m", "y_m").toPandas().to_numpy()
    assert abs(c._along(xy, True)[-1] - length) < 0.05 * length  # smoothing rounds six corners off
    assert {r["laps"] for r in found.line.collect()} == {6}


def test_plans_do_not_grow_with_rounds(spark):
    """Two laps that leave in turn: more rounds, the same plan of the result."""
    one = c.consensus(laps(spark, 6, ()), "lap_id", "i", c.Rules(rounds=1))
    two = c.consensus(laps(spark, 8, (6, 7)), "lap_id", "i", c.Rules(p95_limit_m=3.0, sustained_error_m=3.0, most_share=0.15, tolerance_m=1.0))
    assert two.rounds >= 3 and two.converged and {r["lap_id"] for r in two.laps.where("included").collect()} == set(range(6))
    size = lambda df: df._jdf.queryExecution().executedPlan().toString().count("\n")
    assert size(one.line) == size(two.line) <= 4 and size(two.laps) <= 4


def test_laps_without_points_or_names(spark):
    extra = spark.createDataFrame([(50, 0, 1.0, 1.0, "x"), (51, 0, None, None, "x"), (None, 0, 3.0, 3.0, "x")], laps(spark, 1).schema)
    found = c.consensus(laps(spark, 4, ()).union(extra), "lap_id", "i", c.Rules(rounds=1))
    assert {r["lap_id"]: r["included"] for r in found.laps.collect()} == {0: True, 1: True, 2: True, 3: True, 50: False}
    with pytest.raises(ValueError, match="usable"):
        c.consensus(extra, "lap_id", "i")
