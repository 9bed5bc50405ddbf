"""Draws at gates against a plain sampler that has all samples in hand."""

import pytest
from pyspark.sql import functions as F

from lapsight.operators import gate_draws as g

SCHEMA = "gate_id string, run_id string, lap_id int, vehicle_id string, driver_id string, value double"
DRAWS = 200


def samples(spark, missing):
    """Laps at three gates; ``missing`` is the set of (gate, lap) that were not measured."""
    rows = [(gate, f"r{lap % 2}", lap, "v", None if lap == 3 else "d", 10.0 * n + lap) for n, gate in enumerate("abc") for lap in range(6) if (gate, lap) not in missing]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def brute(spark, rows, mode, seed=4):
    replicates = spark.range(DRAWS).withColumnRenamed("id", "replicate")
    u_lap = {r[0]: r[1] for r in replicates.select("replicate", g.keyed_uniform(seed, "replicate")).collect()}
    pairs = replicates.join(spark.createDataFrame([(x,) for x in "abc"], "gate_id string"))
    u_gate = {(r[0], r[1]): r[2] for r in pairs.select("replicate", "gate_id", g.keyed_uniform(seed + 1, "replicate", "gate_id")).collect()}
    first = lambda who: tuple((x is not None, "" if x is None else x) for x in who)  # noqa: E731  nulls first
    at = {gate: sorted((r[1:] for r in rows if r[0] == gate), key=lambda r: first(r[:4])) for gate in sorted({r[0] for r in rows})}
    held = {}
    for r in rows:
        held[r[1:5]] = held.get(r[1:5], 0) + 1
    best = sorted((w for w, n in held.items() if n == max(held.values())), key=first)
    out = set()
    for i in range(DRAWS):
        lap = best[int(u_lap[i] * len(best))]
        for gate, own in at.items():
            same = [r for r in own if r[:4] == lap]
            if mode == "paired_lap" and same:
                out.add((i, gate, same[0][4], *lap, False))
            else:
                r = own[int(u_gate[i, gate] * len(own))]
                out.add((i, gate, r[4], *r[:4], True))
    return out


@pytest.mark.parametrize("mode", g.MODES)
@pytest.mark.parametrize("missing", [set(), {("a", 1), ("b", 2)}, {("a", 0), ("a", 1), ("b", 2), ("b", 3), ("c", 4), ("c", 5)}])
def test_equals_a_plain_sampler(spark, mode, missing):
    df, rows = samples(spark, missing)
    draws = spark.range(DRAWS).withColumnRenamed("id", "replicate")
    got = [tuple(r) for r in g.gate_draws(df, draws, mode=mode, seed=4).collect()]
    assert len(got) == 3 * DRAWS and set(got) == brute(spark, rows, mode)
    again = g.gate_draws(df.coalesce(1), draws.repartition(7), mode=mode, seed=4).collect()
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in again)  # as rows are dealt otherwise
    if mode == "paired_lap":
        laps = {}
        for r in got:
            if not r[-1]:
                laps.setdefault(r[0], set()).add(r[3:7])
        assert all(len(x) == 1 for x in laps.values())  # identities are never mixed
        assert any(r[-1] for r in got) == (len(missing) > 2)


def test_uniforms_are_even(spark):
    u = spark.range(20_000).select(g.keyed_uniform(1, "id").alias("u"))
    low, high, mean, tenth = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg((F.col("u") < 0.1).cast("double"))).first()
    assert 0 <= low < 0.001 and 0.999 < high < 1 and abs(mean - 0.5) < 0.01 and abs(tenth - 0.1) < 0.01


def test_errors_and_nothing(spark):
    df, rows = samples(spark, set())
    draws = spark.range(3).withColumnRenamed("id", "replicate")
    with pytest.raises(Exception, match="twice at gate a"):
        g.gate_draws(df.union(df.where("gate_id = 'a' and lap_id = 1")), draws).collect()
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="no valid value at gate z"):
            g.gate_draws(df.union(spark.createDataFrame([("z", "r", 1, "v", "d", bad)], SCHEMA)), draws).collect()
    with pytest.raises(ValueError, match="mode"):
        g.gate_draws(df, draws, mode="other")
    assert g.gate_draws(df.limit(0), draws).count() == 0 and g.gate_draws(df, draws.limit(0)).count() == 0
