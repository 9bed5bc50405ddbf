import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapsight.operators import attribution, ordered, uncertainty


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 3000
    x = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.lognormal(0, 3, n), 3))  # one value holds two fifths
    return pd.DataFrame({"i": np.arange(n), "k": np.where(np.arange(n) % 10 == 0, "b", "a"), "x": x, "y": np.round(x + rng.normal(0, 5, n), 1)})


def test_quantiles_of_ties_nulls_and_a_null_key(spark, frame):
    rows = spark.createDataFrame(frame).withColumn("x", F.when(F.col("i") % 17 != 0, F.col("x"))).withColumn("k", F.when(F.col("k") != "b", F.col("k")))
    points = {f"q{i}": ("x", q) for i, q in enumerate((0.0, 0.1, 0.5, 0.75, 1.0))}
    got = {r["k"]: [r[c] for c in points] for r in ordered.quantiles(rows, ["k"], {"x": F.col("x")}, points).collect()}
    kept = frame[frame.i % 17 != 0]
    assert set(got) == {"a", None}
    for k, name in (("a", "a"), (None, "b")):
        assert np.allclose(got[k], np.quantile(kept.x[kept.k == name], [q for _, q in points.values()]))


def test_quantiles_of_few_rows_and_none(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", None)], "k string, x double")
    got = ordered.quantiles(rows, ["k"], {"x": F.col("x")}, {"m": ("x", 0.5)}).collect()
    assert [tuple(r) for r in got] == [("a", 3.0)]
    assert ordered.quantiles(rows.limit(0), ["k"], {"x": F.col("x")}, {"m": ("x", 0.5)}).count() == 0


def test_quantiles_of_many_values_over_many_ranges(spark):
    """Over 100,000 distinct values in one group, dealt to many tasks, read again after one branch was computed anew."""
    n = 120_000
    rows = spark.range(n).select(F.lit("g").alias("k"), ((F.col("id") * 48_271) % 2_147_483_647 / 7.0).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        counts = ordered.counted(rows, ["k"], {"x": F.col("x")})
        assert counts.select("__part").distinct().count() > 8
        points = {f"q{i}": ("x", i / 20) for i in range(21)}
        found = ordered.quantiles_of(counts, ["k"], points)
        one = found.first()
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        two = ordered.quantiles_of(counts, ["k"], points).first()
        numbers = ordered.numbered(rows, [F.desc("x")], "at").orderBy("at").select("at", "x").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = np.quantile(np.arange(n) * 48_271 % 2_147_483_647 / 7.0, np.arange(21) / 20)
    assert np.allclose([one[p] for p in points], want, rtol=1e-12) and tuple(one) == tuple(two)
    assert (numbers["at"] == np.arange(1, n + 1)).all() and (np.diff(numbers["x"]) <= 0).all()


def test_average_ranks(spark, frame):
    got = ordered.with_average_ranks(spark.createDataFrame(frame), ["k"], {"x": "rx", "y": "ry"}).toPandas().sort_values("i")
    for c in "xy":
        assert np.allclose(got[f"r{c}"], frame.groupby("k")[c].rank())


def test_values_at_places(spark, frame):
    rows = spark.createDataFrame(frame)
    asked = spark.createDataFrame([((k, "x"), p) for k, n in (("a", 2700), ("b", 300)) for p in range(0, n, 13)], "__k struct<k:string, __of:string>, p long")
    got = ordered.values_at(ordered.counted(rows, ["k"], {"x": F.col("x")}), asked, "p").select("__k.k", "p", F.col("__v").alias("x")).collect()
    of = {k: np.sort(g.x) for k, g in frame.groupby("k")}
    assert len(got) == asked.count() and all(of[r["k"]][r["p"]] == r["x"] for r in got)


def test_complete_rows_rank_as_pairs_do(spark, frame):
    rows = spark.createDataFrame(frame).withColumn("z", F.col("x") * F.col("y"))
    ask = (rows, "i", {"x": "x", "y": "y"}, {"z": "z"})
    a, b = ({r["path"]: r for r in attribution.driver_explorer(*ask, complete=c).collect()} for c in (False, True))
    for path in "xy":
        assert all(abs(a[path][c] - b[path][c]) < 1e-9 for c in ("pearson", "spearman", "slope", "importance")) and a[path]["rank"] == b[path]["rank"]


def test_bootstrap_quantiles_follow_resampling(spark, frame):
    got = {r["quantile"]: r for r in uncertainty.bootstrap_quantiles(spark.createDataFrame(frame[frame.k == "b"]), ["k"], "y", 5, 4000).collect()}
    v = frame.y[frame.k == "b"].to_numpy()
    draws = np.random.default_rng(1).choice(v, (4000, len(v)))
    for q, r in got.items():
        low, high = np.quantile(np.quantile(draws, q, axis=1), (0.025, 0.975))
        spread = high - low
        assert abs(r["estimate"] - np.quantile(v, q)) < 1e-9 and abs(r["low"] - low) < 0.15 * spread and abs(r["high"] - high) < 0.15 * spread


def test_bootstrap_of_one_row(spark):
    got = uncertainty.bootstrap_quantiles(spark.createDataFrame([("a", 2.0)], "k string, v double"), ["k"], "v", 1, 100).collect()
    assert len(got) == 3 and all(r["low"] == r["high"] == r["estimate"] == 2.0 for r in got)


def test_slope_bootstrap_covers_as_resampling_does(spark, frame):
    part = frame[frame.k == "b"]
    r = uncertainty.slope_bootstrap(spark.createDataFrame(part), ["k"], ["i"], "x", "y", 3, 2000).first()
    rng, x, y = np.random.default_rng(2), part.x.to_numpy(), part.y.to_numpy()
    slopes = [np.polyfit(x[i], y[i], 1)[0] for i in (rng.integers(0, len(x), len(x)) for _ in range(2000))]
    low, high = np.quantile(slopes, (0.025, 0.975))
    assert abs(r["low"] - low) < 0.25 * (high - low) and abs(r["high"] - high) < 0.25 * (high - low)


def test_paired_bootstrap_of_means(spark):
    rng = np.random.default_rng(8)
    wins = rng.random(400) < 0.3
    rows = [("s", i, d, float(w), float(g)) for i, w in enumerate(wins) for d, w, g in (("A", w, 0.0 if w else 2.0), ("B", not w, 2.0 if w else 0.0))]
    df = spark.createDataFrame(rows, "study string, c long, d string, w double, r double")
    got = {(r["design"], r["metric"]): r for r in uncertainty.paired_bootstrap(df, ["study"], "c", "d", "r", "w", 1).collect()}
    half = 1.96 * np.sqrt(wins.mean() * (1 - wins.mean()) / 400)
    a, b = got["A", "win_share"], got["B", "win_share"]
    assert abs(a["low"] - (wins.mean() - half)) < 0.01 and abs(a["high"] - (wins.mean() + half)) < 0.01
    assert abs(a["low"] + b["high"] - 1) < 1e-9 and abs(got["A", "mean_regret"]["high"] - 2 * (1 - a["low"])) < 1e-9
    assert got["A", "median_regret"]["low"] == got["A", "median_regret"]["high"] == 2.0
    with pytest.raises(Exception, match="every design needs every scenario"):
        uncertainty.paired_bootstrap(df.where("c > 0 or d = 'A'"), ["study"], "c", "d", "r", "w", 1).collect()


def test_quantiles_of_large_groups_shuffle_few_rows(spark):
    n = 200_000
    x = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.hash("id") / 1000.0)
    rows = spark.range(n).select((F.col("id") % 2).alias("k"), x.alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") * 7919 % n).cast("double").alias("y"))
    points = {"low": ("x", 0.0), "a": ("x", 0.1), "b": ("x", 0.5), "c": ("x", 0.9995), "high": ("x", 1.0), "m": ("y", 0.25)}
    seen = []
    stage, usual = ordered.stage, ordered.NEAR
    try:
        ordered.stage = lambda df, name: seen.append(name) or stage(df, name)
        got = {r["k"]: r for r in ordered.quantiles(rows, ["k"], {"x": F.col("x"), "y": F.col("y")}, points).collect()}
        assert seen == ["around", "points", "quantiles"]
        table = rows.toPandas()
        for near in (ordered.NEAR, 1e-12):  # bounds that hold nothing: counted by value
            ordered.NEAR = near
            got = {r["k"]: r for r in ordered.quantiles(rows, ["k"], {"x": F.col("x"), "y": F.col("y")}, points).collect()}
            for k, own in table.groupby("k"):
                for point, (of, p) in points.items():
                    v = own[of].dropna().to_numpy()
                    assert got[k][point] is None if not len(v) else abs(got[k][point] - np.quantile(v, p)) < 1e-9 * max(1, abs(np.quantile(v, p)))
    finally:
        ordered.stage, ordered.NEAR = stage, usual


def test_energy_keeps_components_as_columns_and_adds_rows_of_one_key(spark):
    from lapsight.operators import reports

    rows = [("x", 1, 1.0, 3.0), ("x", 1, None, 4.0), ("x", 2, 5.0, None), (None, 3, 2.0, 2.0), ("y", 4, 0.0, 0.0), ("y", 5, None, None)]
    t = spark.createDataFrame(rows, "d string, id int, a double, b double")
    out = reports.energy_accounting(t, ["id"], "d", {"heat": "a", "work": "b"})
    got = {(r["d"], r["component"]): (r["n"], r["median"], r["share_median"]) for r in out.collect()}
    assert got == {
        ("x", "heat"): (2, 3.0, (1 / 8 + 1.0) / 2), ("x", "work"): (2, 3.5, (3 / 8 + 4 / 8) / 2), (None, "heat"): (1, 2.0, 0.5), (None, "work"): (1, 2.0, 0.5),
        ("y", "heat"): (1, 0.0, None), ("y", "work"): (1, 0.0, None),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan  # no group's values in one task


def test_rows_of_few_large_groups_stay_where_they_are_when_slopes_are_drawn(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 2).alias("k"), "id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y")).write.parquet(f"{tmp_path}/t")
    out = uncertainty.slope_bootstrap(spark.read.parquet(f"{tmp_path}/t"), ["k"], ["id"], "x", "y", 3, 20)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(abs(r["low"] - 2) < 1e-9 and abs(r["high"] - 2) < 1e-9 for r in out.collect())


def test_tasks_follow_the_rows(spark):
    from lapsight.operators import staging

    usual, rows = staging.ROWS, spark.range(1000).withColumn("k", F.col("id") % 300)
    assert staging.dealt(rows, ["k"]) is rows
    try:
        staging.ROWS = 100
        assert staging.dealt(rows, ["k"]).rdd.getNumPartitions() == 11
    finally:
        staging.ROWS = usual
