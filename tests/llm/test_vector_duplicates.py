"""Links and components against the cosines of all pairs."""

import math

import duckdb
import numpy as np
import pytest

from lapsight.llm import vector_duplicates as vd

SCHEMA = "vec_id long, embedding array<float>, label int, class string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, "c", 7) for i, v, label in rows], SCHEMA).repartition(3)


def brute(rows, threshold=0.93):
    use = [v is not None and label is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    vectors = [np.array(v, np.float32).astype(float) if u else None for u, (_, v, _) in zip(use, rows, strict=True)]
    n = len(rows)
    near = [set() for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if use[a] and use[b] and rows[a][2] == rows[b][2] and len(vectors[a]) == len(vectors[b]):
                if vectors[a] @ vectors[b] / math.sqrt((vectors[a] @ vectors[a]) * (vectors[b] @ vectors[b])) >= threshold:
                    near[a].add(b)
                    near[b].add(a)
    out, seen = [None] * n, set()
    for a in range(n):
        if a in seen:
            continue
        group, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        seen |= group
        least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        for x in group:
            out[x] = (rows[x][0], len(near[x]), least, rows[x][0] == least)
    return sorted(out, key=str)


def run(spark, rows):
    out = vd.vector_duplicates(frame(spark, rows))
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted((tuple(r) for r in out.collect()), key=str)


def clusters(seed, groups, size, noise, length=16, labels=3):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        middle = r.normal(size=length)
        rows += [middle + noise * r.normal(size=length) * r.random() for _ in range(size)]
    return [(i, v, int(r.integers(labels)) if i % 3 else 0) for i, v in enumerate(rows)]


def test_tables_reach_the_recall():
    for n in (10, 10**4, 10**9):
        tables, directions = vd.tables_and_directions(n)
        near = vd.same_cell(math.sqrt(2 - 2 * vd.THRESHOLD)) ** directions
        assert 1 - (1 - near) ** tables >= vd.RECALL
        assert n * vd.same_cell(math.sqrt(2)) ** directions <= 1.0001


def test_same_cell_is_measured():
    r = np.random.default_rng(0)
    a = r.normal(size=(400_000,))
    b = r.uniform(0, vd.WIDTH, 400_000)
    assert abs((np.floor(b / vd.WIDTH) == np.floor((b + 0.4 * a) / vd.WIDTH)).mean() - vd.same_cell(0.4)) < 0.005


@pytest.mark.parametrize("block", [512, 7])
def test_equals_all_pairs(spark, monkeypatch, block):
    """Groups around the threshold, a hub, scaled and exact copies; buckets whole and in blocks."""
    monkeypatch.setattr(vd, "BLOCK", block)
    rows = clusters(3, 40, 8, 0.5)
    n = len(rows)
    rows += [(n, 3 * rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], 0), (n + 3, rows[3][1], None), (n + 4, -rows[0][1], 0)]
    want, got = brute(rows), run(spark, rows)
    linked = sum(w[1] for w in want)
    assert linked > 200 and sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True)) >= 0.99 * linked
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_tight_groups_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK", 16)
    rows = clusters(4, 12, 40, 0.05, length=64)
    assert run(spark, rows) == brute(rows)


def test_nulls_zeros_lengths_and_repeats(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=5)
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, None, 1), (5, [0.0] * 5, 1), (6, [1, None, 2, 3, 4], 1), (7, [float("nan")] * 5, 1),
        (8, [float("inf"), 0, 0, 0, 0], 1), (9, v, None), (None, v, 1), (None, -v, 1), (10, v[:4], 1), (11, [], 1), (12, -v, 1), (13, 1e-30 * v, 1),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, []) == []


def test_equals_sql(spark, tmp_path):
    rows = [(i, [float(np.float32(c)) for c in v], label) for i, v, label in clusters(5, 20, 6, 0.2)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(vd.OP13_SQL).fetchall()
    got = [tuple(r) for r in vd.op13_vector_duplicates(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
