"""Scores of places as speed gates from passes that may lack targets, vehicles or lap times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsight.operators.ordered import quantiles
from lapsight.operators.statistics import association

SHARES = {"p10": 0.1, "p25": 0.25, "middle": 0.5, "p75": 0.75, "p90": 0.9}


def _unit(score: Column, missing: float = 0.0) -> Column:
    """``score`` within 0 to 1; greatest() and least() alone would pass over a null."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(missing))))


def vehicle_spread(passes: DataFrame, gate: str, vehicle: str, target: str) -> DataFrame:
    """Per gate, the vehicles with a target and the distance of their medians; passes without a vehicle do not count."""
    known = passes.where(F.col(vehicle).isNotNull())
    medians = quantiles(known, [gate, vehicle], {"t": F.col(target)}, {"m": ("t", 0.5)})
    return medians.groupBy(gate).agg(F.count("m").alias("vehicles"), (F.max("m") - F.min("m")).alias("__apart"))


def gate_scores(
    gates: DataFrame, passes: DataFrame, gate: str, vehicle: str, target: str, evidence: str, lap_time: str, settings: Mapping[str, float], weights: Mapping[str, float]
) -> DataFrame:
    """A row per row of ``gates`` (key ``gate``, shares ``explicit``, distances ``error_m``): statistics, scores, class and advice.

    ``settings``: minimum_passes, cv_scale, pace_scale, spread_scale,
    error_scale; high, medium and accept scores; accept_evidence, accept_cv,
    accept_pace; little_evidence, much_evidence, stable_cv. ``weights`` belong
    to sample, stability, evidence, pace, position and vehicle scores.

    Quantiles are exact. A pass without a target counts only in the share of
    evidence, where null is no evidence. The correlation is that of ranks of
    target and pace (minus lap time) over passes with both; with fewer than
    four, or without variation, it is null and counts as one half. A single
    vehicle, or targets around 0, score one half too. A gate without passes
    has evidence 0, stability 0 and is insufficient; one without a position
    error is taken to be off by a whole error_scale. A null gate matches none.
    """
    points = quantiles(passes, [gate], {"t": F.col(target)}, {n: ("t", s) for n, s in SHARES.items()})
    counts = passes.groupBy(gate).agg(
        F.count(target).alias("n"), F.stddev_samp(target).alias("__sd"), F.avg(F.coalesce(F.col(evidence), F.lit(False)).cast("double")).alias("evidence_score")
    )
    paired = association(passes.withColumn(lap_time, -F.col(lap_time)), [gate], target, lap_time, least=4)
    pace = paired.select(gate, F.col("spearman").alias("pace_correlation"))
    spread = vehicle_spread(passes, gate, vehicle, target)
    known = gates
    for part in (counts, points, pace, spread):
        known = known.join(part, gate, "left")
    known = known.withColumns({"n": F.coalesce("n", F.lit(0)), "vehicles": F.coalesce("vehicles", F.lit(0)), "evidence_score": F.coalesce("evidence_score", F.lit(0.0))})
    c, s = F.col, settings
    many = (c("vehicles") >= 2) & (c("middle") > 0)
    known = known.withColumns(
        {
            "cv": F.when(c("n") > 0, F.coalesce("__sd", F.lit(0.0)) / F.greatest(c("middle"), F.lit(1e-9))),
            "vehicle_spread": F.when(many, c("__apart") / c("middle")),
            "__pace": F.greatest(F.lit(0.0), F.coalesce("pace_correlation", F.lit(0.5))),
            "iqr": c("p75") - c("p25"),
        }
    )
    off = F.coalesce(c("error_m"), F.lit(s["error_scale"])) / s["error_scale"]
    known = known.withColumns(
        {
            "sample_score": _unit(c("n") / (2 * s["minimum_passes"])),
            "stability_score": _unit(1 - c("cv") / s["cv_scale"]),
            "pace_score": _unit(1 - c("__pace") / s["pace_scale"]),
            "position_score": _unit(0.45 + 0.4 * F.coalesce("explicit", F.lit(0.0)) + 0.15 * (1 - off)),
            "vehicle_score": _unit(1 - c("vehicle_spread") / s["spread_scale"], missing=0.5),
        }
    )
    score = 100 * sum((c(f"{k}_score") * w for k, w in weights.items()), F.lit(0.0))
    enough = c("n") >= s["minimum_passes"]
    known = known.withColumn("score", score).withColumns(
        {
            "confidence": F.when(~enough, "insufficient").when(c("score") >= s["high"], "high").when(c("score") >= s["medium"], "medium").otherwise("low"),
            "accepted": enough
            & (c("score") >= s["accept"])
            & (c("evidence_score") >= s["accept_evidence"])
            & F.coalesce(c("cv") <= s["accept_cv"], F.lit(False))
            & (c("__pace") <= s["accept_pace"]),
        }
    )
    little = c("evidence_score") < s["little_evidence"]
    reasons = F.array_compact(
        F.array(
            F.when(c("cv") <= s["stable_cv"], "stable").when(c("cv") > s["accept_cv"], "variable"),
            F.when(c("evidence_score") >= s["much_evidence"], "repeatable").when(little, "little_evidence"),
            F.when(c("__pace") > s["accept_pace"], "rises_with_pace"),
            F.when(F.coalesce(c("explicit"), F.lit(0.0)) < 1, "assumed_extent"),
            F.when(c("vehicles") < 2, "single_vehicle"),
        )
    )
    advice = F.when(c("accepted"), "gate").when(little, "no_gate").otherwise("review")
    return known.withColumns({"advice": advice, "reasons": F.array_join(reasons, ";")}).drop("__sd", "__apart", "__pace")


def labelled_metrics(rows: DataFrame, keep: Sequence[str], definitions: Mapping[str, tuple[str, str]]) -> DataFrame:
    """A row per row and metric with its label, value and unit; metrics that ``rows`` does not have are left out."""
    there = [(m, *d) for m, d in definitions.items() if m in rows.columns]
    if not there:
        raise ValueError("none of the metrics is a column")
    each = [F.struct(F.lit(m).alias("metric"), F.lit(label).alias("label"), F.col(m).cast("double").alias("value"), F.lit(unit).alias("unit")) for m, label, unit in there]
    return rows.select(*keep, F.inline(F.array(*each)))
