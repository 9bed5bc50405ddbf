"""Whitening of embeddings by shifted Cholesky QR.

The centred rows of the fit list are never gathered. Each pass adds up their
Gram matrix on the executors; the driver factors that matrix and the next pass
solves triangular systems with the factors so far, row by row, before it adds up
again. The first factor is taken of the matrix plus a shift, so that it exists
however badly conditioned the rows are; the passes end when the rows are
orthonormal. The product of the factors is the rows' R, and R's singular values
and right vectors give the components. Only sums of rows (one number for each
pair of dimensions, MOST_DIMENSIONS at most) come to the driver.

Rows whose vector is null or holds a null or non-finite entry go, and so do
those of another length than most rows have (the greater, if equally many): no
covariance holds two lengths. Repeated rows stay in the result and count once in
the fit list. Components without variance (VARIANCE of the first) cannot be
whitened and have no row, so one distinct vector, or none, gives no row. A
deviation beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import drop, shuffles_removed, stage

COMPONENTS = 4
MOST_DIMENSIONS = 2048
MOST_PASSES = 6
#: Least variance of a component, as a share of the first one's.
VARIANCE = 1e-12
#: Values are multiplied by it and rounded down.
SCALE = 256

_UNIT = np.finfo(float).eps / 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _whole(rows: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the whole numbers ``x`` of the rows that can be used."""
    v = F.col(vector)
    infinite = F.lit(float("inf"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != infinite))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.where(v.isNotNull() & fine).select(*keep, x.alias("__x"))


def _total(rows: DataFrame, terms: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray | None:
    """The sum over all tasks of ``terms`` of their blocks of rows, whose shape is the same for all; None without rows."""
    kind = pa.int64() if whole else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = terms(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            places = np.flatnonzero(np.ones(total.size) if total.ndim == 1 else np.triu(np.ones(total.shape)).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(total.ravel()[places], kind)], names=["place", "value"])

    summed = rows.select("__x").mapInArrow(run, f"place long, value {'long' if whole else 'double'}").groupBy("place").agg(F.sum("value").alias("value"))
    found = summed.toPandas().sort_values("place")
    return found["value"].to_numpy() if len(found) else None


def _full(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return np.triu(out) + np.triu(out, 1).T


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``factor``, column by column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def triangle(gram: Callable[[list[np.ndarray]], np.ndarray], n: int, d: int) -> np.ndarray:
    """R of n rows in d dimensions; ``gram`` gives their Gram matrix after solving with a list of factors."""
    factors: list[np.ndarray] = []
    eye = np.eye(d)
    for _ in range(MOST_PASSES):
        g = gram(factors)
        size = np.linalg.norm(g, 2)
        if size == 0:
            return np.zeros((d, d))
        least = np.linalg.eigvalsh(g)[0]
        if factors and np.abs(g - eye).max() < 64 * d * _UNIT:
            break
        if not factors:
            shift = 11 * (n * d + d * (d + 1)) * _UNIT * size
        else:
            shift = 0.0 if least > 1e-6 * size else 128 * d * _UNIT * size  # rows that don't span all dimensions
        factors.append(np.linalg.cholesky(g + shift * eye).T)
    out = eye
    for f in factors:
        out = f @ out
    return out


def whiten(rows: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: ``keep``, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    names = [f"__k{i}" for i in range(len(keep))]
    whole = _whole(rows.select(*[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)], F.col(vector).alias("__v")), "__v", names)
    lengths = whole.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    d = lengths["d"] if lengths else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; {MOST_DIMENSIONS} at most")
    whole = whole.where(F.size("__x") == d)
    result = ", ".join(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in names)
    result += ", component int, n long, deviation long, whitened double, explained double, identity_error double"
    back = [F.col(k).alias(c) for c, k in zip(keep, names, strict=True)]
    rest = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    nothing = spark.createDataFrame([], result).select(*back, *rest)
    if not d:
        return nothing

    fit = stage(whole.select("__x").distinct(), "whitening-fit")
    with shuffles_removed(spark):
        n = fit.count()
        sums = _total(fit, lambda x: x.sum(axis=0), whole=True)
        mean = sums / n
        upper = lambda m: _full(m, m_d) if (m_d := int((np.sqrt(8 * len(m) + 1) - 1) / 2)) else m

        def centred(x: np.ndarray) -> np.ndarray:
            return x - mean

        def gram(factors: list[np.ndarray]) -> np.ndarray:
            def terms(x: np.ndarray) -> np.ndarray:
                q = centred(x)
                for f in factors:
                    q = solve(q, f)
                return q.T @ q

            return upper(_total(fit, terms))

        _, sigma, turned = np.linalg.svd(triangle(gram, n, d))
        variance = sigma**2 / n
        k = int((variance[:components] > VARIANCE * variance[0]).sum()) if variance[0] > 0 else 0
        if not k:
            drop(fit)
            return nothing
        axes = turned[:k] * np.sign(turned[np.arange(k), np.abs(turned[:k]).argmax(axis=1)])[:, None]
        weights = axes.T / np.sqrt(variance[:k])
        middle = _total(fit, lambda x: (centred(x) @ weights).sum(axis=0)) / n
        spread = upper(_total(fit, lambda x: (z := centred(x) @ weights - middle).T @ z)) / n
        drop(fit)
    error = float(np.abs(spread - np.eye(k)).max())
    explained = variance[:k] / variance.sum()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(names)))
            z = centred(x) @ weights
            if float(np.abs(n * x.astype(float) - sums).max(initial=0)) ** 2 * d < 2.0**62:
                away = ((n * x - sums) ** 2).sum(axis=1)
            else:
                away = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
            m = batch.num_rows
            again = pa.array(np.repeat(np.arange(m), k))
            made = [
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(away, pa.int64()).take(again),
                pa.array(z.ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in batch.columns[: len(names)]), *made], names=[*names, *rest])

    return whole.mapInArrow(project, result).select(*back, *rest)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
