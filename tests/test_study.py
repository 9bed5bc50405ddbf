"""Study tables on small frames."""

import pytest
from pyspark.sql import functions as F

from lapsight.operators import relations, study, uncertainty
from lapsight.plans import study as plans


def test_line_distance(spark):
    line = lambda dy: spark.createDataFrame([("a", float(s), float(s), 2.0 * s + dy) for s in range(0, 101, 10)], "k string, s double, x double, y double")
    grid = spark.createDataFrame([("a", s / 2) for s in range(201)], "k string, s double")
    out = study.line_distance(line(0.0), line(1.5), grid, ["k"], "s", "x", "y").collect()
    assert [(r["k"], round(r["p95"], 9), round(r["max"], 9)) for r in out] == [("a", 1.5, 1.5)]


def test_input_ranges_and_flags(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2.5"), ("b", "x"), ("b", "7"), ("b", None)], "path string, value string")
    out = {r["path"]: (r["numeric"], r["low"], r["high"], r["texts"]) for r in study.input_ranges(rows, "path", "value").collect()}
    assert out == {"a": (True, 1.0, 2.5, None), "b": (False, None, None, "7;x")}
    flags = spark.createDataFrame([(1, ["f"]), (2, []), (3, None)], "i int, f array<string>")
    assert [r["i"] for r in study.flagged(flags, "f").collect()] == [1]


def test_selected_gate(spark):
    gates = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "g string, start boolean")
    assert [r["g"] for r in study.selected_gate(gates, gates["g"] == "b").collect()] == ["b"]
    with pytest.raises(Exception, match="exactly one"):
        study.selected_gate(gates, gates["start"]).collect()


def test_review_order_and_running_maximum(spark):
    rows = spark.createDataFrame([("x", 3), ("must", 2), ("ok", 1), (None, 0)], "s string, i int")
    assert [r["i"] for r in study.in_order(rows, "s", {"must": 0, "ok": 3}, ["i"]).collect()] == [2, 1, 0, 3]
    out = study.running_maximum(spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "t int, v int"), [], ["t"], "v", "m").orderBy("t").collect()
    assert [r["m"] for r in out] == [5, 5, 9]


def test_many_centres_go_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [i / 3.0, 1.0]) for i in range(40)], "k int, v array<double>")
    centres = spark.createDataFrame([(j, [float(j), 1.0]) for j in range(12)], "c int, w array<double>")
    whole = sorted(map(tuple, relations.nearest_centre(vectors, "k", "v", centres, "c", "w").collect()))
    monkeypatch.setattr(relations, "CENTRES_AT_ONCE", 5)
    assert sorted(map(tuple, relations.nearest_centre(vectors, "k", "v", centres, "c", "w").collect())) == whole
    for k, c, d in whole:
        best = min(((k / 3.0 - j) ** 2, j) for j in range(12))
        assert c == best[1] and abs(d - best[0]) < 1e-12


def test_crossed_limit(spark, monkeypatch):
    draws, variants = spark.range(3), spark.createDataFrame([("a",), ("b",)], "v string")
    assert uncertainty.crossed(draws, variants).count() == 6
    monkeypatch.setattr(uncertainty, "MOST_VARIANTS", 1)
    with pytest.raises(Exception, match="too many"):
        uncertainty.crossed(draws, variants).collect()


def test_gate_review_takes_the_first_action(spark):
    columns = "gate long, recommendation string, valid_pass_count long, speed_repeatability_score double, braking_evidence_score double, cross_vehicle_status string, sustained_gate_status string"
    rows = [
        (1, "accepted", 9, 90.0, 90.0, "measured", None),
        (2, "accepted", 9, 90.0, 90.0, "measured", "entry_only_fallback"),
        (3, "rejected", 2, 10.0, 10.0, None, None),
        (4, "rejected", 9, 60.0, 10.0, None, None),
        (5, "odd", None, None, None, None, None),
        (6, "not_a_candidate", 1, 1.0, 1.0, None, None),
        (7, "accepted", 9, 90.0, 90.0, "measured", "entry_only_fallback"),
    ]
    places = spark.createDataFrame([(1, None, "speed_gate"), (2, "", "speed_gate"), (6, "", "lap_gate"), (7, "a;;b", "speed_gate")], "gate long, review_flags string, analysis_role string")
    split = F.filter(F.split(F.coalesce("review_flags", F.lit("")), ";"), lambda f: f != "")
    actions = [(c.replace("550", "3").replace("43", "50"), a) for c, a in plans.GATE_ACTIONS]
    found = study.reviewed(spark.createDataFrame(rows, columns), places.withColumn("assumptions", split), "gate", "recommendation", plans.URGENCY, actions, "review_evidence")
    out = {r["gate"]: r for r in found.collect()}
    want = ["keep_both", "keep_entry_only", "add_laps", "move_entry_window", "add_vehicle", "separates_laps", "review_assumptions"]
    assert [out[i]["suggested_action"] for i in range(1, 8)] == want
    assert [out[i]["review_priority"] for i in range(1, 8)] == [3, 3, 2, 2, 9, 4, 3] and out[7]["assumptions"] == ["a", "b"]


def test_a_mean_of_the_limit_itself_is_eligible_in_any_order(spark, tmp_path):
    import random

    from lapsight.plans import registry

    rows = []
    for supplier in range(30):
        off = [0.01 * i for i in range(11)] * 60
        random.Random(supplier).shuffle(off)
        rows += [(supplier, d, 60000.0) for d in [round(d, 2) for d in off]]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert all(r["eligible"] and not r["reasons"] for r in registry.queries()["eligible_cases"](spark, str(tmp_path)).collect())
