"""Inheritance and merging of profiles against a plain resolver."""

import json
import random

import pytest

from lapsight.sources import profiles as p


def frame(spark, rows):
    return spark.createDataFrame([(i, s, e, json.dumps(c)) for i, s, e, c in rows], p.PROFILES).repartition(3)


def plain_order(rows, requested, scope):
    known, applied, active, problems = {r[0]: r for r in rows}, [], [], set()

    def apply(i):
        if i in applied:
            return
        if i not in known:
            problems.add(("not_found", i))
        elif i in active:
            problems.add(("cycle", i))
        elif known[i][1] not in (scope, "mixed"):
            problems.add(("scope_mismatch", i))
        else:
            active.append(i)
            for e in known[i][2]:
                apply(e)
            active.pop()
            if i not in applied:
                applied.append(i)

    for i in requested:
        apply(i)
    return applied, problems


def plain_merge(target, incoming):
    for k, v in incoming.items():
        if isinstance(v, dict) and isinstance(target.get(k), dict) and not p.is_complete(v):
            plain_merge(target[k], v)
        else:
            target[k] = json.loads(json.dumps(v))


def pruned(node):
    """Without tables that have no leaves, which have no path."""
    out = {k: pruned(v) if isinstance(v, dict) else v for k, v in node.items()}
    return {k: v for k, v in out.items() if v != {}}


def check(spark, rows, requested, scope="vehicle"):
    order, problems = p.application_order(frame(spark, rows), requested, scope)
    want, wrong = plain_order(rows, requested, scope)
    assert [r["id"] for r in order.orderBy("layer_order").collect()] == want
    assert {(r["problem"], r["id"]) for r in problems.collect()} == wrong
    settings, _ = p.resolve(frame(spark, rows), requested, scope)
    document = {}
    for i in want:
        plain_merge(document, next(r[3] for r in rows if r[0] == i))
    assert p.document_of(settings) == pruned(document)
    return settings


def test_diamond_cycle_scope_and_missing(spark):
    rows = [
        ("base", "mixed", [], {"a": {"x": 1, "y": 2}, "b": 1}),
        ("left", "vehicle", ["base"], {"a": {"x": 5}}),
        ("right", "vehicle", ["base", "gone"], {"a": {"y": 7}, "c": [1, 2]}),
        ("top", "vehicle", ["left", "right"], {"b": {"now": "a table"}}),
        ("loop", "vehicle", ["pool"], {"l": 1}), ("pool", "vehicle", ["loop", "track"], {"l": 2}), ("track", "track", ["base"], {"t": 1}),
    ]
    settings = check(spark, rows, ["top"])
    got = {".".join(r["path"]): r for r in settings.collect()}
    assert [(s["layer"], s["value"]) for s in got["a.x"]["provenance"]] == [("base", "1"), ("left", "5")]
    assert [s["layer"] for s in got["b.now"]["provenance"]] == ["top"] and "b" not in got
    check(spark, rows, ["loop", "top", "loop", "none"])
    check(spark, rows, [])
    check(spark, rows, ["track"], "track")


def test_quantities_are_replaced_whole(spark):
    quantity = lambda kind, **x: {"nominal": 1.0, "unit": "kg", "source": "s", "uncertainty": {"type": kind, **x}}
    rows = [
        ("a", "mixed", [], {"mass": quantity("triangular", low=0.5, high=2.0), "tyre": {"nominal": "hard", "source": "s", "uncertainty": {"options": ["hard", "soft"]}, "note": "x"}}),
        ("b", "mixed", ["a"], {"mass": quantity("normal", sd=0.1), "tyre": {"nominal": "soft"}}),
        ("c", "mixed", ["b"], {"mass": {"nominal": 3.0}, "tyre": {"nominal": "soft", "source": "t", "uncertainty": {"options": ["soft"]}}}),
    ]
    got = {".".join(r["path"]): r for r in check(spark, rows, ["c"]).collect()}
    assert "mass.uncertainty.low" not in got and "tyre.note" not in got
    assert [s["layer"] for s in got["mass.nominal"]["provenance"]] == ["a", "b", "c"] and got["mass.nominal"]["value"] == "3.0"


def test_a_profile_that_is_defined_twice(spark):
    rows = [("a", "mixed", [], {"x": 2}), ("a", "mixed", [], {"x": 1})]
    settings, problems = p.resolve(frame(spark, rows), ["a"], "vehicle")
    assert p.document_of(settings) == {"x": 1} and [r["problem"] for r in problems.collect()] == ["defined_twice"]


@pytest.mark.parametrize("seed", range(4))
def test_random_profiles(spark, seed):
    r = random.Random(seed)
    ids = [f"p{i}" for i in range(7)]

    def config(depth=0):
        return {k: config(depth + 1) if depth < 2 and r.random() < 0.5 else r.choice([1, "s", None, [1, {"z": 2}], 2.5]) for k in r.sample(["u", "nominal", "unit", "source", "uncertainty"], r.randint(1, 5))}

    rows = [(i, r.choice(["vehicle", "vehicle", "mixed", "track"]), r.sample([*ids, "gone"], r.randint(0, 2)), config()) for i in ids]
    check(spark, rows, r.sample(ids, 3))


def test_paths():
    d = {"a": 1}
    p.set_path(d, ["a", "b", "c"], 2)
    assert d == {"a": {"b": {"c": 2}}} and p.get_path(d, "a.b.c") == 2 and p.get_path(d, "a.x.c", 5) == 5 and p.get_path(d, "a.b.c.d") is None
