"""Shifted Cholesky QR against eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from lapsight.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, n int, component string, x double"


def frame(spark, vectors, first=0):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "c", 0.5) for i, v in enumerate(vectors, first)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def check(spark, vectors, components=4):
    got = w.whiten(frame(spark, vectors), components=components).collect()
    usable = {i: np.floor(256 * np.array(v, np.float32).astype(float)) + 0 for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.unique(np.stack(list(usable.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(usable)
    for r in got:
        x, c = usable[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == int(((n * x - sums) ** 2).sum())
        want = (x - sums / n) @ vectors_[:, c] / math.sqrt(values[c])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-6 * max(1, abs(want))
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-9
        assert r["identity_error"] < 1e-8
    return got


def test_equals_eigenvectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 8)) * np.array([9, 5, 3, 2, 1, 0.5, 0.1, 0.02]) + 4
    rows = [*base, base[0], base[0], base[1]]
    got = check(spark, rows)
    by = {(g["vec_id"], g["component"]): g["whitened"] for g in got}
    assert by[0, 1] == by[300, 1] == by[301, 1]


def test_nulls_other_lengths_and_repeats(spark):
    r = np.random.default_rng(2)
    rows = [*r.normal(size=(40, 3)), None, [1, None, 2], [1, float("nan"), 2], [float("inf"), 0, 0]]
    check(spark, rows)
    ragged = [*rows, [], [1.0], [1, 2, 3, 4]]
    assert {g["vec_id"] for g in w.whiten(frame(spark, ragged)).collect()} == set(range(40))


@pytest.mark.parametrize("rank", [1, 2, 3])
def test_rows_that_do_not_span_all_dimensions(spark, rank):
    r = np.random.default_rng(rank)
    corners = r.integers(-8, 8, size=(rank, 6)) * 4.0
    mixed = r.integers(-3, 4, size=(60, rank)) @ corners
    check(spark, list(mixed))


def test_badly_conditioned_rows(spark):
    """Variances a factor of 1e10 apart: one Gram pass alone could not tell the last component."""
    r = np.random.default_rng(7)
    rows = r.normal(size=(500, 4)) * np.array([3000, 300, 3, 0.03])
    got = w.whiten(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()
    assert {g["component"] for g in got} == {1, 2, 3, 4} and max(g["identity_error"] for g in got) < 1e-6


def test_nothing_to_whiten(spark):
    for rows in ([], [None], [[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]]):
        out = w.whiten(frame(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_triangle_is_that_of_the_rows():
    r = np.random.default_rng(3)
    a = r.normal(size=(2000, 12)) * np.logspace(0, -6, 12)

    def gram(factors):
        q = a
        for f in factors:
            q = w.solve(q, f)
        return q.T @ q

    got = np.linalg.svd(w.triangle(gram, *a.shape), compute_uv=False)
    assert np.allclose(got, np.linalg.svd(a, compute_uv=False), rtol=1e-9)
