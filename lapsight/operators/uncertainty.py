"""Scenario draws and bootstrap intervals: seeded NumPy on executors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.operators import ordered
from lapsight.operators.staging import stage

#: Track variants of a crossed layout.
MOST_VARIANTS = 10_000


def uniforms(spark: SparkSession, seed: int, replicates: int, paths: Sequence[str], groups: Mapping[str, tuple[Sequence[str], Sequence[Sequence[float]]]] | None = None) -> DataFrame:
    """(replicate, seed, path, u): independent uniforms per path, correlated ones within groups.

    Replicate i has its own stream, child i of the seed, so draws do not depend
    on partitions. Paths are drawn in order, then groups through normal
    variables of their correlation matrix. Each row of work is one replicate.
    """
    correlated = {g: (list(p), np.asarray(m, float)) for g, (p, m) in (groups or {}).items()}
    for name, (members, matrix) in correlated.items():
        check_correlation(name, members, matrix)
    order = list(paths)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                stream = np.random.SeedSequence(seed, spawn_key=(int(i),))
                rng = np.random.default_rng(stream)
                own = int(stream.generate_state(1, np.uint64)[0]) & ((1 << 63) - 1)
                u = {p: float(rng.random()) for p in order}
                for members, matrix in correlated.values():
                    z = rng.multivariate_normal(np.zeros(len(members)), matrix)
                    u.update({p: 0.5 * math.erfc(-v / math.sqrt(2)) for p, v in zip(members, z, strict=True)})
                rows += [(int(i), own, p, x) for p, x in u.items()]
            yield pd.DataFrame(rows, columns=["replicate", "seed", "path", "u"])

    return spark.range(replicates).mapInPandas(draw, "replicate long, seed long, path string, u double")


def check_correlation(name: str, members: Sequence[str], matrix: np.ndarray) -> None:
    n = len(members)
    if matrix.shape != (n, n) or not np.allclose(matrix, matrix.T) or not np.allclose(np.diag(matrix), 1):
        raise ValueError(f"group {name}: a symmetric {n} x {n} matrix with unit diagonal is needed")
    if np.linalg.eigvalsh(matrix).min() < -1e-10:
        raise ValueError(f"group {name}: the matrix is not positive semidefinite")


def bootstrap_quantiles(rows: DataFrame, keys: Sequence[str], value: str, seed: int, resamples: int = 1000, quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Per group and quantile: estimate and 95 % interval over resamples of the group's rows.

    Which row a resample has at a place of its order depends on the group's
    size alone: the places' uniforms are beta variables. So the row numbers are
    drawn without the rows, as from n draws with replacement, and only the
    values at these numbers are looked up. Groups may have any size.
    """
    names = list(keys)
    shares = [float(q) for q in quantiles]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, n in zip(batch["g"], batch["n"], strict=True):
                for at, q in enumerate(shares):
                    rng = np.random.default_rng([seed, at])
                    place = q * (n - 1)
                    k = int(place) + 1
                    low = rng.beta(k, n + 1 - k, resamples)
                    high = low + (1 - low) * rng.beta(1, n - k, resamples) if k < n else low
                    found = {"low": low * n, "high": high * n, "estimate_low": [place], "estimate_high": [math.ceil(place)]}
                    for end, x in found.items():
                        row = np.minimum(np.floor(x).astype("int64"), n - 1)
                        yield pd.DataFrame({"g": [group] * len(row), "quantile": q, "f": place - int(place), "draw": np.arange(len(row)), "end": end, "row": row})

    clean = rows.select(F.struct(*names).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    counts = ordered.counted(clean.select("g.*", "v"), names, {"v": F.col("v")})
    kind = counts.schema["__k"].dataType.simpleString()
    sizes = counts.groupBy("__k").agg(F.sum("n").alias("n"))
    text = sizes.select(F.to_json("__k", {"ignoreNullFields": "false"}).alias("g"), "n")  # Arrow hands a struct over as a dict
    drawn = text.mapInPandas(draw, "g string, quantile double, f double, draw long, end string, row long")
    asked = drawn.withColumn("__k", F.from_json("g", kind)).drop("g")
    looked = ordered.values_at(counts, asked, "row").withColumn("g", F.struct(*[F.col(f"__k.{n}") for n in names]))
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("__v")))
    between = lambda a, b: at(a) + (at(b) - at(a)) * F.max("f")
    each = looked.groupBy("g", "quantile", "draw").agg(between("low", "high").alias("x"), between("estimate_low", "estimate_high").alias("e"))
    return each.groupBy("g", "quantile").agg(F.max("e").alias("estimate"), F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).select(
        "g.*", "quantile", "estimate", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high")
    )  # resamples values in a group


#: P(X <= k) of a Poisson variable of mean 1; beyond the last, less than 1e-12.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])
#: Rows weighted at once, and groups whose sums a task holds.
BLOCK = 512
MOST_GROUPS = 256


def _weights(units: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) weights of units in each resample, from a hash of both: the same in every task."""
    with np.errstate(over="ignore"):
        x = units.astype("uint64")[:, None] + np.arange(1, resamples + 1, dtype="uint64")[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values of the splitmix64 finaliser
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)).astype(float) / 2.0**53, side="right").astype(float)


def bootstrap_sums(rows: DataFrame, keys: Sequence[str], unit: Sequence[str], values: Mapping[str, Column], seed: int, resamples: int = 1000) -> DataFrame:
    """(keys, replicate, weight, one weighted sum per value): sums of each resample.

    A row counts in a resample as often as a Poisson variable of mean 1 says,
    which its ``unit`` fixes; rows of one unit stay together. Tasks add their
    own rows, Spark adds the tasks' sums, so no group has to fit anywhere.
    """
    names = list(values)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for g, sums in held.items():
                yield pd.DataFrame(sums, columns=["weight", *names]).assign(g=g, replicate=np.arange(resamples))[["g", "replicate", "weight", *names]]
            held.clear()

        for batch in batches:
            for g, part in batch.groupby("g", sort=False):
                if g not in held and len(held) >= MOST_GROUPS:
                    yield from out()
                sums = held.setdefault(g, np.zeros((resamples, 1 + len(names))))
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
                u = part["u"].to_numpy("int64")
                for i in range(0, len(part), BLOCK):
                    sums += _weights(u[i : i + BLOCK], resamples).T @ x[i : i + BLOCK]
        yield from out()

    key = F.struct(*keys)
    kind = rows.select(key.alias("g")).schema["g"].dataType.simpleString()
    given = rows.select(
        F.to_json(key, {"ignoreNullFields": "false"}).alias("g"), F.xxhash64(F.lit(seed), *unit).alias("u"), *[c.cast("double").alias(n) for n, c in values.items()]
    ).dropna(subset=names)
    columns = ", ".join(f"`{n}` double" for n in ["weight", *names])
    parts = given.mapInPandas(add, f"g string, replicate long, {columns}")
    whole = parts.groupBy("g", "replicate").agg(*[F.sum(n).alias(n) for n in ["weight", *names]])
    return whole.withColumn("g", F.from_json("g", kind)).select("g.*", "replicate", "weight", *names)


def _interval(of: str) -> list[Column]:
    return [F.percentile(of, 0.025).alias("low"), F.percentile(of, 0.975).alias("high")]  # one value per resample


def paired_bootstrap(rows: DataFrame, study: Sequence[str], scenario: str, design: str, regret: str, win: str, seed: int, resamples: int = 1000) -> DataFrame:
    """95 % intervals of win share, mean and median regret per design; whole scenarios are resampled, so pairs stay together.

    Means are ratios of weighted sums (``bootstrap_sums``). Medians take each
    design's rows alone, as an interval of one design needs no partner.
    A study in which a design lacks a scenario is an error.
    """
    names = list(study)
    wide = rows.select(*names, F.col(scenario).alias("__s"), F.col(design).cast("string").alias("design"), F.col(regret).alias("__r"), F.col(win).alias("__w"))
    wide = stage(wide, "paired")
    sizes = wide.groupBy(*names, "design").agg(F.count_distinct("__s").alias("m"))
    whole = sizes.groupBy(F.struct(*names).alias("__k")).agg(F.min("m").alias("a"), F.max("m").alias("b"))
    whole = whole.where(F.when(F.col("a") == F.col("b"), F.lit(True)).otherwise(F.raise_error(F.lit("every design needs every scenario")).cast("boolean")))
    sums = bootstrap_sums(wide, [*names, "design"], [*names, "__s"], {"win_share": F.col("__w"), "mean_regret": F.col("__r")}, seed, resamples)
    each = sums.select(*names, "design", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(m, "weight").alias("x")) for m in ("win_share", "mean_regret")])))
    means = each.groupBy(*names, "design", "metric").agg(*_interval("x"))
    middle = bootstrap_quantiles(wide, [*names, "design"], "__r", seed, resamples, [0.5])
    out = means.unionByName(middle.select(*names, "design", F.lit("median_regret").alias("metric"), "low", "high"))
    return out.withColumn("__k", F.struct(*names)).join(whole.select("__k"), "__k", "left_semi").drop("__k")


def slope_bootstrap(rows: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str, seed: int, resamples: int = 1000) -> DataFrame:
    """(keys, low, high): 95 % interval of the least-squares slope over resamples; those with a single x count for none."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = rows.where(a.isNotNull() & b.isNotNull())
    # sums around each group's means, so that large offsets cost no digits
    # and written, so that Spark knows whether they are few enough to go to the rows instead of the rows to a few groups
    middle = stage(both.groupBy(F.struct(*keys).alias("__k")).agg(F.avg(a).alias("__mx"), F.avg(b).alias("__my")), "middles")
    near = both.withColumn("__k", F.struct(*keys)).join(middle, "__k")
    a, b = a - F.col("__mx"), b - F.col("__my")
    sums = bootstrap_sums(near, keys, unit, {"sx": a, "sy": b, "sxx": a * a, "sxy": a * b}, seed, resamples)
    spread = F.col("weight") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 0, (F.col("weight") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    return sums.withColumn("slope", slope).groupBy(*keys).agg(*_interval("slope"))


def crossed(draws: DataFrame, variants: DataFrame) -> DataFrame:
    """Every draw with every track variant: the variants as one array, in each row of the draws.

    The result has a row for each pair by definition; more than MOST_VARIANTS
    variants are an error.
    """
    packed = F.struct(*variants.columns)
    one = variants.agg(F.count(F.lit(1)).alias("n"), F.collect_list(packed).alias("v"))
    few = one.select(F.when(F.col("n") <= MOST_VARIANTS, F.col("v")).otherwise(F.raise_error(F.lit("too many variants"))).alias("__v"))
    return draws.join(F.broadcast(few)).select(*draws.columns, F.inline("__v"))  # one row of bounded size


def round_robin(draws: DataFrame, variants: DataFrame, order: str) -> DataFrame:
    """Draws dealt to variants in turn."""
    from pyspark.sql import Window

    n = F.broadcast(variants.agg(F.count(F.lit(1)).alias("__n")))  # one row
    numbered = variants.withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)) - 1)
    return draws.join(n).withColumn("__i", F.pmod("replicate", "__n").cast("int")).join(F.broadcast(numbered), "__i").drop("__i", "__n")
