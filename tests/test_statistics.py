import math
import random
from statistics import NormalDist, median

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsight.functions import circular, distributions, text, units
from lapsight.operators import ordered, profiles, ranking, relations, statistics, uncertainty


def test_tied_wins_are_shared(spark):
    rows = [("A", 0, 1.0), ("A", 1, 3.0), ("A", 2, 1.0), ("B", 0, 2.0), ("B", 1, 2.0), ("B", 2, 1.0)]
    out = {r["d"]: r for r in ranking.design_ranking(spark.createDataFrame(rows, "d string, rep int, m double"), "rep", "d", "m").collect()}
    for d in "AB":
        assert out[d]["paired_win_fraction"] == 0.5 and abs(out[d]["mean_regret"] - 1 / 3) < 1e-12
        assert abs(out[d]["full_win_fraction"] - 2 / 3) < 1e-12


def test_unfinished_rows_never_win(spark):
    rows = [("A", 0, 1.0, False), ("B", 0, 2.0, True)]
    df = spark.createDataFrame(rows, "d string, rep int, m double, done boolean")
    out = {r["d"]: r for r in ranking.design_ranking(df, "rep", "d", "m", F.col("done")).collect()}
    assert out["A"]["full_win_fraction"] == 0 and out["B"]["full_win_fraction"] == 1 and out["A"]["regret_median"] is None


def test_quantile_functions(spark):
    one = spark.range(1)
    tri = distributions.triangular_ppf(F.lit(0.5), F.lit(1.0), F.lit(2.0), F.lit(5.0))
    emp = distributions.empirical_ppf(F.lit(0.99), F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)))
    pick = distributions.choice(F.lit(0.5), F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.5), F.lit(0.5)))
    cut = distributions.truncated_normal_ppf(F.lit(0.9), F.lit(2.0), F.lit(1.0), F.lit(0.5), F.lit(3.5))
    r = one.select(tri.alias("t"), emp.alias("e"), pick.alias("p"), distributions.normal_ppf(F.lit(0.975), F.lit(1.0), F.lit(2.0)).alias("n"), cut.alias("c")).first()
    n = NormalDist(2, 1)
    assert abs(r["t"] - 2.5505102572) < 1e-9 and r["e"] == 3.0 and r["p"] == "b"
    assert abs(r["n"] - NormalDist(1, 2).inv_cdf(0.975)) < 1e-9
    assert abs(r["c"] - n.inv_cdf(n.cdf(0.5) + 0.9 * (n.cdf(3.5) - n.cdf(0.5)))) < 1e-9


@pytest.mark.parametrize("n", [2, 3, 4, 7, 10])
def test_leave_one_out(spark, n):
    v = np.random.default_rng(n).integers(0, 9, n).astype(float).tolist()
    want = max(abs(median(v[:i] + v[i + 1 :]) - median(v)) for i in range(n))
    assert spark.range(1).select(statistics.leave_one_out_shift(F.array(*map(F.lit, v))).alias("x")).first()["x"] == want


def test_binomial_tail(spark):
    for n, k in [(1, 0), (1, 1), (10, 8), (30, 12), (200, 120)]:
        want = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        got = spark.range(1).select(statistics.binomial_upper_tail(F.lit(float(k)), F.lit(float(n))).alias("p")).first()["p"]
        assert abs(got - want) < 1e-9


def test_draws_are_children_of_the_seed(spark):
    got = uncertainty.uniforms(spark.newSession(), 7, 5, ["a", "b"]).orderBy("replicate", "path").collect()
    for i, child in enumerate(np.random.SeedSequence(7).spawn(5)):
        rng = np.random.default_rng(child)
        assert [r["u"] for r in got if r["replicate"] == i] == [rng.random(), rng.random()]
    both = uncertainty.uniforms(spark, 7, 400, [], {"g": (["x", "y"], [[1, 0.9], [0.9, 1]])}).groupBy("replicate").pivot("path", ["x", "y"]).agg(F.first("u"))
    assert both.select(F.corr("x", "y")).first()[0] > 0.8
    with pytest.raises(ValueError):
        uncertainty.check_correlation("g", ["x", "y"], np.array([[1, 2], [2, 1.0]]))


def test_circular(spark):
    rows = spark.createDataFrame([(999.9999999999,), (-1.0,), (1000.0,), (500.0,)], "v double")
    assert [r[0] for r in rows.select(circular.on_axis(F.col("v"), 1000.0)).collect()] == [0.0, 999.0, 0.0, 500.0]
    r = spark.range(1).select(circular.signed(F.lit(990.0), F.lit(10.0), 1000.0).alias("s"), circular.rescaled_shift(F.lit(10.0), 100.0, F.lit(20.0), 200.0).alias("z")).first()
    assert r["s"] == 20.0 and r["z"] == 0.0


def test_units_and_text(spark):
    df = spark.createDataFrame([(36.0, "kph", "speed"), (1.0, "N·m", "force"), (1.0, "?", "speed")], "v double, u string, d string")
    got = units.with_si(df, "v", "u").collect()
    assert sorted((r["u"], r["si_value"]) for r in got if r["si_value"] is not None) == [("N·m", 1.0), ("kph", 10.0)]
    assert units.wrong_dimension(df, "u", "d").count() == 2
    r = spark.range(1).select(text.tokens(F.lit(" a; b;;")).alias("t"), text.slug(F.lit(" Log Jump #2 ")).alias("s"), text.merged_flags(F.array(F.lit("x")), F.array(F.lit("y"), F.lit("x"))).alias("m")).first()
    assert r["t"] == ["a", "b"] and r["s"] == "log_jump_2" and r["m"] == ["x", "y"]


@pytest.mark.parametrize(("spread", "status"), [(0.4, "paired_grade_sensitivity_recommended"), (12.0, "elevation_not_repeatable")])
def test_grade(spark, spread, status):
    rows = [(2.5 * i, 4 * math.sin(2 * math.pi * i / 40), spread) for i in range(41)]
    out = profiles.grade_materiality(spark.createDataFrame(rows, "s double, z double, w double"), "s", "z", "w", 11).first()
    assert out["status"] == status


def test_grade_needs_coverage(spark):
    rows = [(2.5 * i, None if i < 21 else 1.0, 0.4) for i in range(41)]
    assert profiles.grade_materiality(spark.createDataFrame(rows, "s double, z double, w double"), "s", "z", "w", 11).first()["status"] == "insufficient_elevation_evidence"


def test_rules(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0), (2, "zz", 2.0)], "id int, ref string, v double")
    parents = spark.createDataFrame([("a",)], "name string")
    found = relations.Rules().unique(rows, "t", "id").not_null(rows, "t", "id", "ref").refers_to(rows, "t", "id", "ref", parents, "name").increasing(rows, "t", "id", "v", "v").violations()
    assert sorted((r["code"], r["path"]) for r in found.collect()) == [("id_repeated", "t/1"), ("ref_missing", "t/1"), ("ref_unknown", "t/2")]


def test_leave_one_out_shifts_of_large_groups_look_at_the_middle_only(spark):
    r = random.Random(8)
    rows = [(k, float(r.choice([r.randint(0, 9), r.uniform(0, 9)]))) for k, n in (("a", 2), ("b", 3), ("c", 40), (None, 41), ("d", 1)) for _ in range(n)]
    want = {}
    for k in {k for k, _ in rows}:
        v = [x for key, x in rows if key == k]
        want[k] = max(abs(np.median(v[:i] + v[i + 1 :]) - np.median(v)) for i in range(len(v))) if len(v) > 1 else None
    t = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: x.s for x in statistics.leave_one_out_shifts(ordered.counted(t, ["k"], {"v": F.col("v")}), ["k"], {"v": "s"}).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) if w is None else abs(got[k] - w) < 1e-12 for k, w in want.items())
    arrays = spark.range(1).select(statistics.leave_one_out_shift(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: (x * 7 % 300_007).cast("double"))).alias("x"))
    v = np.sort(np.arange(1, 300_001) * 7 % 300_007)
    assert arrays.first()["x"] == max(v[150_000] - (v[149_999] + v[150_000]) / 2, (v[149_999] + v[150_000]) / 2 - v[149_999])
