"""Which inputs move which outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import ordered
from lapsight.operators.statistics import association


def unpivot(rows: DataFrame, key: str, columns: Mapping[str, str], name: str, value: str) -> DataFrame:
    """(key, name, value) for each of the columns."""
    return rows.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias(name), F.col(c).cast("double").alias(value)) for n, c in columns.items()])))


def driver_explorer(
    rows: DataFrame, key: str, inputs: Mapping[str, str], outputs: Mapping[str, str], least: int = 5, complete: bool = False
) -> DataFrame:
    """Association of every output with every input over their common rows, ranked within each output.

    Both sides are columns of one row, so they are paired by generating them
    from it, without a join. With ``complete`` only rows with all inputs and
    outputs count; then each column is ranked once, whatever its partners.
    """
    found = _over_complete_rows(rows, inputs, outputs, least) if complete else _over_common_rows(rows, key, inputs, outputs, least)
    w = Window.partitionBy("metric")  # a row per input
    strength = F.abs("spearman")
    return found.withColumn("rank", F.row_number().over(w.orderBy(F.desc(strength), "path"))).withColumn(
        "importance", F.try_divide(strength, F.max(strength).over(w))
    )


def _over_common_rows(rows: DataFrame, key: str, inputs: Mapping[str, str], outputs: Mapping[str, str], least: int) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(p).alias("path"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
            for m, y in outputs.items()
            for p, x in inputs.items()
        ]
    )
    return association(rows.select(key, F.inline(pairs)), ["metric", "path"], "x", "y", least)


def _over_complete_rows(rows: DataFrame, inputs: Mapping[str, str], outputs: Mapping[str, str], least: int) -> DataFrame:
    columns = {c: f"__c{i}" for i, c in enumerate(dict.fromkeys([*inputs.values(), *outputs.values()]))}
    wide = rows.select(F.lit(0).alias("__all"), *[F.col(c).cast("double").alias(n) for c, n in columns.items()])
    ranked = ordered.with_average_ranks(wide, ["__all"], {n: f"{n}r" for n in columns.values()})

    def pair(metric: str, path: str, x: str, y: str) -> Column:
        ranks = F.var_pop(f"{x}r") * F.var_pop(f"{y}r")
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(path).alias("path"),
            F.count(F.lit(1)).alias("n"),
            F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))).alias("pearson"),
            F.when(ranks > 0, F.covar_pop(f"{x}r", f"{y}r") / F.sqrt(ranks)).alias("spearman"),
            F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("slope"),
        )

    pairs = F.array(*[pair(m, p, columns[x], columns[y]) for m, y in outputs.items() for p, x in inputs.items()])
    return ranked.agg(pairs.alias("__p")).select(F.inline("__p")).where((F.col("n") >= least) & F.col("spearman").isNotNull())


def local_slopes(levels: DataFrame, parameter: str, x: str, y: str, nominal: str) -> DataFrame:
    """Slope between the nearest levels below and above the nominal one, and over all levels."""
    below, above = F.col(x) < F.col(nominal), F.col(x) > F.col(nominal)
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    out = levels.groupBy(parameter).agg(
        F.max_by(point, F.when(below, F.col(x))).alias("a"),
        F.min_by(point, F.when(above, F.col(x))).alias("b"),
        F.max_by(point, F.when(F.col(x) == F.col(nominal), F.col(x))).alias("m"),
        F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("global_slope"),
    )
    a, b = F.coalesce("a", "m"), F.coalesce("b", "m")
    return out.select(parameter, F.try_divide(b["y"] - a["y"], b["x"] - a["x"]).alias("local_slope"), "global_slope")
