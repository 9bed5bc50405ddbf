"""Speeds at gates drawn from measured passes, with the gates of one draw from one lap wherever there is such a lap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsight.operators import ordered
from lapsight.operators.uncertainty import crossed

IDENTITY = ("run_id", "lap_id", "vehicle_id", "driver_id")
MODES = ("paired_lap", "independent")


def keyed_uniform(seed: int, *columns: str) -> Column:
    """A number from 0 up to 1 that the seed and the columns' values alone fix, however rows are dealt."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(2**53)


def checked(samples: DataFrame, gate: str, identity: Sequence[str], value: str) -> DataFrame:
    """(gate, __who, identity, value); a negative or missing value, or an identity twice at a gate, is an error."""
    fine = F.coalesce((F.col(value) >= 0) & (F.col(value) < float("inf")), F.lit(False))
    sound = F.when(fine, F.col(value).cast("double")).otherwise(F.raise_error(F.concat(F.lit("no valid value at gate "), F.col(gate).cast("string"))).cast("double"))
    rows = samples.where(F.col(gate).isNotNull()).select(gate, F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}).alias("__who"), *identity, sound.alias(value))
    once = rows.groupBy(gate, "__who").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in (*identity, value)])
    message = F.concat(F.lit("an identity is twice at gate "), F.col(gate).cast("string"))
    return once.withColumn(value, F.when(F.col("__n") == 1, F.col(value)).otherwise(F.raise_error(message).cast("double"))).drop("__n")


def gate_draws(
    samples: DataFrame, draws: DataFrame, gate: str = "gate_id", value: str = "value", identity: Sequence[str] = IDENTITY, mode: str = "paired_lap", seed: int = 0,
    u_lap: Column | None = None, u_gate: Column | None = None, replicate: str = "replicate",
) -> DataFrame:
    """(replicate, gate, value, identity, independent): a value for every draw and gate.

    ``paired_lap``: each draw takes one identity among those that most gates
    have, so all gates' values come from one lap if any lap has all; gates that
    lack the identity are drawn on their own and marked ``independent``.
    ``independent``: every gate is drawn on its own. Identities and a gate's
    samples are numbered in their order and a draw takes a number, so samples
    are looked up and never collected. Uniforms depend on seed, replicate and
    gate; ``u_lap`` and ``u_gate`` replace them.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    numbered = ordered.numbered(checked(samples, gate, identity, value), [F.col(gate), *[F.col(c) for c in identity]], "__at")
    gates = numbered.groupBy(gate).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    u_lap = keyed_uniform(seed, replicate) if u_lap is None else u_lap
    u_gate = keyed_uniform(seed + 1, replicate, gate) if u_gate is None else u_gate
    asked = draws.select(*draws.columns)
    whole = crossed(asked, gates)
    result = [replicate, gate, value, *identity, "independent"]

    def alone(pairs: DataFrame) -> DataFrame:
        at = F.col("__first") + F.floor(u_gate * F.col("__n"))
        found = pairs.withColumn("__at", at).drop(gate).join(numbered, "__at")
        return found.select(replicate, gate, value, *identity, F.lit(True).alias("independent"))

    if mode == "independent":
        return alone(whole).select(*result)
    held = numbered.groupBy("__who").agg(F.count(F.lit(1)).alias("__gates"), *[F.first(c).alias(c) for c in identity])
    best = held.agg(F.max("__gates").alias("m")).first()["m"]
    if best is None:
        return alone(whole).select(*result)
    laps = ordered.numbered(held.where(F.col("__gates") == best).select("__who", *identity), [F.col(c) for c in identity], "__lap").select("__who", "__lap")
    n_laps, n_gates = laps.count(), gates.count()
    taken = asked.withColumn("__lap", (1 + F.floor(u_lap * n_laps)).cast("long")).join(laps, "__lap")
    paired = taken.join(numbered, "__who").select(replicate, gate, value, *identity, F.lit(False).alias("independent"))
    if best == n_gates:
        return paired.select(*result)
    missing = whole.join(paired.select(replicate, gate), [replicate, gate], "left_anti")
    return paired.unionByName(alone(missing)).select(*result)
