"""Scores of gates against a plain computation, with passes that lack values."""

import math
import statistics as st

import pytest

from lapsight.operators import gate_scores as g
from lapsight.plans.gates import SETTINGS, WEIGHTS

PASSES = "gate long, vehicle string, target double, slowed boolean, lap_s double"
S = {**SETTINGS, "minimum_passes": 3.0}


def quantile(x, p):
    x, at = sorted(x), p * (len(x) - 1)
    a = math.floor(at)
    return x[a] + (at - a) * (x[min(a + 1, len(x) - 1)] - x[a])


def ranks(x):
    return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]


def plain(rows, explicit, error):
    unit = lambda v: min(1.0, max(0.0, v))
    t = [r[2] for r in rows if r[2] is not None]
    both = [(r[2], -r[4]) for r in rows if r[2] is not None and r[4] is not None]
    c = None
    if len(both) >= 4 and all(len(set(x)) > 1 for x in zip(*both, strict=True)):
        c = st.correlation(*map(ranks, zip(*both, strict=True)))
    own = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            own.setdefault(r[1], []).append(r[2])
    medians = [st.median(x) for x in own.values()]
    spread = (max(medians) - min(medians)) / st.median(t) if len(medians) > 1 and st.median(t) > 0 else None
    cv = (st.stdev(t) if len(t) > 1 else 0.0) / max(st.median(t), 1e-9) if t else None
    shown = sum(bool(r[3]) for r in rows) / len(rows) if rows else 0.0
    pace = 0.5 if c is None else max(0.0, c)
    parts = [
        unit(len(t) / (2 * S["minimum_passes"])), 0.0 if cv is None else unit(1 - cv / S["cv_scale"]), shown, unit(1 - pace / S["pace_scale"]),
        unit(0.45 + 0.4 * (explicit or 0.0) + 0.15 * (1 - (S["error_scale"] if error is None else error) / S["error_scale"])), 0.5 if spread is None else unit(1 - spread / S["spread_scale"]),
    ]
    return len(t), len(medians), c, cv, spread, quantile(t, 0.1) if t else None, quantile(t, 0.75) if t else None, 100 * sum(w * p for w, p in zip(WEIGHTS.values(), parts, strict=True))


@pytest.fixture(scope="module")
def rows():
    own = [(1, "ab"[i % 2], 20.0 + i % 5, i % 3 == 0, 60.0 - i % 4) for i in range(12)]  # ties and repeated rows
    own += [(1, None, 90.0, None, 61.0), (1, "c", None, True, 62.0), (1, "a", 21.0, False, None)]
    own += [(2, "a", 5.0, True, 60.0)] * 4  # one value
    own += [(3, "a", None, True, 60.0)]  # no target
    own += [(4, "a", 0.0, None, 1.0), (4, "b", 0.0, False, 2.0), (4, "b", 0.0, True, 3.0)]
    return own + [(None, "a", 1.0, True, 1.0), (9, "a", 1.0, True, 1.0)]  # no such gate


def test_scores_equal_plain_ones(spark, rows):
    gates = [(1, 1.0, 2.0), (2, 0.5, None), (3, None, 50.0), (4, 0.0, 0.0), (5, 1.0, 0.0), (None, 1.0, 0.0)]
    out = g.gate_scores(spark.createDataFrame(gates, "gate long, explicit double, error_m double"), spark.createDataFrame(rows, PASSES).repartition(3), "gate", "vehicle", "target", "slowed", "lap_s", S, WEIGHTS)
    found = {r["gate"]: r for r in out.collect()}
    assert len(found) == len(gates)
    for key, explicit, error in gates:
        r = found[key]
        got = [r[k] for k in ("n", "vehicles", "pace_correlation", "cv", "vehicle_spread", "p10", "p75", "score")]
        assert got == pytest.approx(list(plain([x for x in rows if key is not None and x[0] == key], explicit, error)))
    assert found[5]["confidence"] == "insufficient" and found[5]["advice"] == "no_gate" and not found[5]["accepted"]
    assert found[2]["reasons"].split(";") == ["stable", "repeatable", "rises_with_pace", "assumed_extent", "single_vehicle"]


def test_empty_tables(spark, rows):
    gates = spark.createDataFrame([(1, 1.0, 0.0)], "gate long, explicit double, error_m double")
    none = spark.createDataFrame([], PASSES)
    out = g.gate_scores(gates, none, "gate", "vehicle", "target", "slowed", "lap_s", S, WEIGHTS).collect()
    assert [(r["n"], r["confidence"]) for r in out] == [(0, "insufficient")]
    assert g.gate_scores(gates.limit(0), spark.createDataFrame(rows, PASSES), "gate", "vehicle", "target", "slowed", "lap_s", S, WEIGHTS).count() == 0


def test_labelled_metrics(spark):
    rows = spark.createDataFrame([("x", 1, None)], "name string, time int, energy double")
    names = {"time": ("Time", "s"), "energy": ("Energy", "kJ"), "ratio": ("Ratio", "1")}
    assert [tuple(r) for r in g.labelled_metrics(rows, ["name"], names).collect()] == [("x", "time", "Time", 1.0, "s"), ("x", "energy", "Energy", None, "kJ")]
    with pytest.raises(ValueError, match="none of the metrics"):
        g.labelled_metrics(rows, ["name"], {"ratio": ("Ratio", "1")})
