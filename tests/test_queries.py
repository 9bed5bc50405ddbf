"""Every query of the library against its SQL, and against another number of partitions."""

import re

import duckdb
import pytest

from lapsight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Times a plan may read one table; what is staged on the way is read by plans of its own.
MOST_SCANS = 3


def plain(rows):
    return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(len(re.findall(rf"FileScan parquet [^\n]*/{t}\.parquet", plan)) <= MOST_SCANS for t in TABLES)
    columns = sorted(df.columns)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_bootstrap", "slope_bootstrap", "scenario_draws"])
def test_seeded_queries_do_not_depend_on_partitions(spark, name):
    run = registry.queries()[name]
    one = plain(run(spark, SF).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert plain(run(spark, SF).collect()) == one and one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
