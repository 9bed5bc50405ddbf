"""Cases from runs and settings, failures as rows, and runs that go on where they stopped."""

import pytest
from pyspark.sql import functions as F

from lapsight.operators import robustness as r


@pytest.fixture(scope="module")
def runs(spark):
    rows = [("r1", "v1", "d1", True, True), ("r2", "v1", "d2", True, False), ("r3", "v2", None, True, False)]
    return spark.createDataFrame(rows, "run_id string, vehicle_id string, driver_id string, line boolean, gates boolean")


def test_leave_out_cases(runs):
    got = {x["case_id"]: x["excluded"] for x in r.leave_out_cases(runs, "run_id", ["vehicle_id", "driver_id"], ["line", "gates"]).collect()}
    # r1 is the only run with gates, and with it v1 and d1
    assert got == {"leave_out_run_id__r2": ["r2"], "leave_out_run_id__r3": ["r3"], "leave_out_vehicle_id__v2": ["r3"], "leave_out_driver_id__d2": ["r2"]}
    assert r.leave_out_cases(runs.where("run_id = 'r1'"), "run_id", ["vehicle_id"]).count() == 0
    assert r.leave_out_cases(runs.limit(0), "run_id", ["vehicle_id"]).count() == 0


def test_setting_cases(spark):
    nominal = {"gate.passes": 5, "gate.accept": 60.0}
    changes = [("strict", "policy", "gate.passes", "plus", 2, None, None), ("strict", "policy", "gate.accept", "plus", 50, None, 95.0), ("lax", "policy", "gate.passes", "times", 0.1, 3, None)]
    got = {x["case_id"]: x for x in r.setting_cases(spark, nominal, changes).collect()}
    assert got["strict"]["overrides"] == {"gate.passes": "7", "gate.accept": "95.0"} and got["lax"]["overrides"] == {"gate.passes": "3"}
    assert r.setting(got["strict"], "gate.passes", 5) == 7 and r.setting(got["lax"], "gate.accept", 60.0) == 60.0
    with pytest.raises(KeyError, match="no setting"):
        r.setting_cases(spark, {}, changes)


def test_a_failing_case_is_a_row_and_a_second_run_computes_nothing(spark, tmp_path, runs):
    rows = spark.createDataFrame([("r1", 1.0), ("r2", 2.0), ("r3", 6.0)], "run_id string, v double")
    cases = r.leave_out_cases(runs, "run_id", []).unionByName(r.setting_cases(spark, {"x": 1.0}, [("broken", "policy", "x", "set", 0.0, None, None), ("unplanned", "policy", "x", "set", 2.0, None, None)]))
    seen = []

    def compute(case):
        seen.append(case["case_id"])
        if case["case_id"] == "unplanned":
            raise KeyError("no such column")
        kept = rows.where(~F.col("run_id").isin(case["excluded"]))
        return kept.agg((F.avg("v") / F.when(F.lit(r.setting(case, "x", 1.0)) == 0, F.raise_error(F.lit("planted")).cast("double")).otherwise(1.0)).alias("mean"))

    root = str(tmp_path)
    status = r.run_cases(cases, root, compute, workers=2)
    found = {x["case_id"]: x for x in status.collect()}
    assert len(found) == 5 and sorted(c for c, x in found.items() if not x["success"]) == ["broken", "unplanned"]
    assert "planted" in found["broken"]["error"] and "KeyError" in found["unplanned"]["error"] and found["broken"]["folder"] is None
    means = {x["case_id"]: x["mean"] for x in r.case_results(status, root).collect()}
    assert means == {"leave_out_run_id__r1": 4.0, "leave_out_run_id__r2": 3.5, "leave_out_run_id__r3": 1.5}
    assert len(seen) == 5
    good = cases.where("category = 'data_support'")
    again = r.run_cases(good, root, compute)
    assert len(seen) == 5 and again.where("success").count() == 3
    r.run_cases(cases, root, compute)
    assert sorted(seen[5:]) == ["broken", "unplanned"]  # failed ones are tried again
    r.run_cases(good, root, compute, version="2")
    assert len(seen) == 10


def test_limits_and_names(spark, runs):
    cases = r.leave_out_cases(runs, "run_id", ["vehicle_id"])
    assert [x["case_id"] for x in r.limited(cases, 2).collect()] == ["leave_out_run_id__r1", "leave_out_run_id__r2"]
    with pytest.raises(Exception, match="two cases"):
        r.limited(cases.union(cases)).collect()
