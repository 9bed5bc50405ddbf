"""Places along a closed course against plain loops and numpy."""

import random

import numpy as np

from lapsight.operators import course, telemetry


def test_unwrapped_equals_a_loop(spark):
    r = random.Random(3)
    places, at = [], 1.0
    for _ in range(400):
        at += r.choice([7.0, 11.5, 30.0, -1.5, -2.5, 0.0])
        places.append(at % 100)
    want, before = [], None
    for p in places:
        while before is not None and p < before - 3:
            p += 100
        want.append(p)
        before = p
    rows = spark.createDataFrame(list(enumerate(places)), "i int, s double")
    got = [x["u"] for x in course.unwrapped(rows, [], ["i"], "s", 100.0, "u").orderBy("i").collect()]
    assert np.allclose(got, want) and max(want) > 300


def test_slope_and_curvature_equal_numpy(spark):
    rng = np.random.default_rng(2)
    s = np.cumsum(rng.uniform(0.5, 2.0, 40))
    x, y = 50 * np.cos(s / 50), 50 * np.sin(s / 50)
    rows = spark.createDataFrame([("a", *map(float, v)) for v in zip(s, x, y, strict=True)], "k string, s double, x double, y double")
    got = [r["d"] for r in course.slope(rows, ["k"], "s", "x", "d").orderBy("s").collect()]
    assert np.allclose(got, np.gradient(x, s, edge_order=2))
    bend = [r["curvature"] for r in course.curvature(rows, ["k"], "s", "x", "y").orderBy("s").collect()]
    assert np.allclose(bend[3:-3], 1 / 50, rtol=1e-2)
    short = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0)], "k string, s double, x double")
    assert [r["d"] for r in course.slope(short, ["k"], "s", "x", "d").collect()] == [None, None]


def test_outlier_runs_need_a_short_bridge(spark):
    rows = [(1, i, e, f"2026-01-01 00:00:{i * step:02d}", step) for step in (2, 9) for i, e in enumerate([2.0, 75.0, 3.0, 2.0])]
    frame = spark.createDataFrame(rows, "lap int, i int, e double, t string, step int").withColumn("t", telemetry.F.col("t").cast("timestamp"))
    out = telemetry.bracketed_outliers(frame, ["step", "lap"], "i", "e", time="t").collect()
    assert [(r["step"], r["i"]) for r in out] == [(2, 1)]


def test_design_points_without_repeats(spark):
    inputs = spark.createDataFrame([("a", 1.0, [0.5, 1.0 + 1e-15, None, 2.0, 0.5]), ("b", 3.0, None)], "p string, n double, v array<double>")
    got = [tuple(r) for r in course.design_points(inputs, "p", "n", "v").orderBy("p", "level").collect()]
    assert got == [("a", 0, 1.0), ("a", 1, 0.5), ("a", 2, 2.0), ("b", 0, 3.0)]


def test_bundles_are_checked(spark):
    courses = spark.createDataFrame([(1,), (2,)], "c int")
    gates = spark.createDataFrame([(1, 20, True), (1, 10, True), (1, 30, False), (1, 40, None)], "c int, gate int, active_by_default boolean")
    made = course.bundle(courses, "c", {"gates": (gates, ["gate"])})
    assert course.bundle(courses, "c", {"gates": (gates.repartition(3), ["gate"])}).exceptAll(made).count() == 0
    schema = "version int, c int, gates array<struct<gate:int,active_by_default:boolean>>"
    content = course.opened(made, "c", schema)
    assert [tuple(r)[:2] for r in course.active_gates(content, "c").orderBy("gate").collect()] == [(1, 10), (1, 20)]
    assert content.where("c = 2").selectExpr("size(content.gates) as n").first()["n"] == 0
    F = telemetry.F
    changed = made.withColumn("bundle", F.regexp_replace("bundle", "10", "11"))
    newer = made.withColumn("bundle", F.regexp_replace("bundle", '"version":1', '"version":2')).withColumn("sha256", F.sha2("bundle", 256))
    broken = made.withColumn("bundle", F.lit("{")).withColumn("sha256", F.sha2("bundle", 256))
    problems = lambda b: [r["problem"] for r in course.opened(b, "c", schema).orderBy("c").collect()]
    assert problems(changed) == ["checksum", None] and problems(newer) == ["version"] * 2 and problems(broken) == ["unreadable"] * 2


def test_normalised_events(spark):
    rows = [("a", [("Log  Pit", "Hill", 3.0, "x; y"), ("log pit", None, None, None), (None, None, 1.0, "p,q")]), ("b", [])]
    frame = spark.createDataFrame(rows, "c string, r array<struct<name:string,kind:string,place:double,flags:string>>")
    got = [tuple(r) for r in course.normalised_events(frame, "c", "r").orderBy("sequence").collect()]
    assert got == [
        ("a", 1, "log_pit", "Log  Pit", "hill", 3.0, ["x", "y"]), ("a", 2, "log_pit_2", "log pit", "unknown", None, ["no_place"]), ("a", 3, "event_3", "event_3", "unknown", 1.0, ["p", "q"]),
    ]


def test_share_of_uniform_nodes_equals_interpolation_and_needs_no_nodes(spark):
    r = random.Random(5)
    rows = [(k, float(at), None if r.random() < 0.1 else r.choice([30.0, 30.0 + 4e-15, r.uniform(0, 60)])) for k in range(4) for at in sorted(r.sample(range(5000), 60))]
    samples = spark.createDataFrame(rows, "k int, at double, v double")
    got = {x.k: (x.nodes, x.share) for x in course.uniform_share_above(samples, ["k"], "at", "v", 7.0, 30.0).collect()}
    for k in range(4):
        own = [(at, v) for key, at, v in rows if key == k]
        known = [p for p in own if p[1] is not None]
        nodes = [p for p in np.arange(own[0][0], own[-1][0] + 1, 7.0) if p >= known[0][0]]
        high = 0
        for p in nodes:
            (x0, y0), after = [q for q in known if q[0] <= p][-1], [q for q in known if q[0] > p]
            high += (y0 if not after or x0 == p else y0 + (p - x0) / (after[0][0] - x0) * (after[0][1] - y0)) > 30
        assert got[k] == (len(nodes), high / len(nodes))
    long = spark.createDataFrame([(0, 0.0, 0.0), (0, 1e12, 60.0), (1, 5.0, 31.0)], "k int, at double, v double")
    found = {x.k: (x.nodes, x.share) for x in course.uniform_share_above(long, ["k"], "at", "v", 25.0, 30.0).collect()}
    assert found == {0: (40_000_000_001, 20_000_000_000 / 40_000_000_001), 1: (1, 1.0)}
