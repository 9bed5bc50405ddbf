from pyspark.sql import functions as F

from lapsight.llm import source_mix as m
from tests.llm.conftest import prose


def water_fill(sizes):
    """Targets by the rule as told: share, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = 3.0 * sizes[s]
        open_ -= above
        left -= sum(target[s] for s in above)
    return target


def check(df, n):
    out = df.collect()
    assert len(out) == n
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    return out


def test_targets_and_taken(spark):
    rows = [(i, prose(i, 30 + i % 90), "hot" if i % 2 else [None, "b", "c", "d", "é"][i % 5]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = check(m.mix(docs, keep=("doc_id", "source")), 600)
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = water_fill(sizes)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) / want[s] - 1) < 0.03
    again = m.mix(docs.repartition(7), keep=("doc_id", "source"))
    assert sorted(map(str, out)) == sorted(map(str, again.collect()))


def test_schedule_follows_the_weights_early(spark):
    plan = spark.createDataFrame([("=a", "a", 50, 10, 0.0, 0.75, 100.0), ("=b", "b", 50, 10, 0.75, 1.0, 30.0)], "key string, source string, blocks long, block_words long, since double, upto double, wanted double")
    slots = m.schedule(spark, plan, 120).where("slot < 40").groupBy("key").count().collect()
    assert all(abs(r["count"] - {"=a": 30, "=b": 10}[r["key"]]) <= 2 for r in slots)
    ranks = [r["rank"] for r in m.schedule(spark, plan, 120).where("key = '=a'").orderBy("slot").collect()]
    assert ranks == list(range(len(ranks)))


def test_edges(spark, docs, empty, rows):
    out = check(m.mix(docs), len(rows))
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert m.mix(empty).count() == 0
    taken = m.take(spark, docs, "")
    assert taken.dtypes == docs.dtypes
    assert taken.groupBy("doc_id").count().where(F.col("doc_id").isNotNull() & (F.col("doc_id") != 4)).agg(F.max("count")).first()[0] <= 3
    assert m.take(spark, empty, "").count() == 0


def test_tables_without_words(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, " ", "b"), (3, "", None)], "doc_id long, text string, source string")
    out = m.mix(rows).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in out] == [(0, 0, 0.0, 0)] * 3
    assert m.take(spark, rows, "").count() == 0


def test_rows_of_one_id_and_helper_names(spark):
    schema = "doc_id long, text string, source string, of int, id int, hash int, times int, x int"
    rows = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3, 4, 5), (1, None, "s", 1, 2, 3, 4, 5), (2, "d e", "t", 1, 2, 3, 4, 5)], schema)
    out = m.take(spark, rows, "")
    assert out.dtypes == rows.dtypes
    assert {r["text"] for r in out.collect()} <= {"a b c", "d e"}
