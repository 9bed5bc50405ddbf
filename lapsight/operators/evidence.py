"""Evidence for repeatable responses: passes scored per event."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.operators import ordered
from lapsight.operators.staging import drop, stage
from lapsight.operators.statistics import binomial_upper_tail, leave_one_out_shifts


def spread_between_groups(passes: DataFrame, event: str, group: str, value: str) -> DataFrame:
    """Per event, how far the groups' medians are apart; null with fewer than two groups."""
    own = passes.groupBy(event, group).agg(F.median(value).alias("__m"))
    out = own.groupBy(event).agg(F.count("__m").alias("groups"), (F.max("__m") - F.min("__m")).alias("spread"))
    return out.withColumn("spread", F.when(F.col("groups") >= 2, F.col("spread")))


def gate_evidence(
    passes: DataFrame, event: str, group: str, entry: str, least: str, pace: str, settings: Mapping[str, float], weights: Mapping[str, float]
) -> DataFrame:
    """Component scores in 0 to 1, their weighted score in 0 to 100 and a recommendation per event.

    ``settings``: target_passes, minimum_passes, repeatability_scale,
    slowdown_threshold, agreement_scale, accept_score, review_score. Weights
    are normalised to 1. A constant entry or pace has no correlation and counts
    as half independent; fewer than two groups as half agreed.
    """
    slowdown = F.col(entry) - F.col(least)
    q = F.percentile(entry, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    scored = passes.groupBy(event).agg(
        F.count(F.lit(1)).alias("pass_count"),
        F.count_distinct(group).alias("group_count"),
        q.alias("q"),
        F.avg(entry).alias("entry_mean"),
        F.stddev_samp(entry).alias("entry_deviation"),
        F.avg((slowdown >= settings["slowdown_threshold"]).cast("double")).alias("braking"),
        F.median(slowdown).alias("slowdown_median"),
        F.covar_pop(entry, pace).alias("__cov"),
        F.var_pop(entry).alias("__ve"),
        F.var_pop(pace).alias("__vp"),
    )
    spread = spread_between_groups(passes, event, group, entry).select(event, "spread")
    correlation = F.when((F.col("__ve") > 0) & (F.col("__vp") > 0), F.col("__cov") / F.sqrt(F.col("__ve") * F.col("__vp")))
    iqr = F.col("q")[3] - F.col("q")[1]
    zero = F.lit(0.0)
    parts = {
        "pass_score": F.least(F.lit(1.0), F.col("pass_count") / settings["target_passes"]),
        "repeatability": F.greatest(zero, 1 - iqr / settings["repeatability_scale"]),
        "braking": F.col("braking"),
        "pace_independence": 1 - F.abs(F.coalesce(correlation, F.lit(0.5))),
        "agreement": F.coalesce(F.greatest(zero, 1 - F.col("spread") / settings["agreement_scale"]), F.lit(0.5)),
    }
    total = sum(weights.values())
    score = sum((F.col(k) * (w / total) for k, w in weights.items()), F.lit(0.0)) * 100
    signature = (
        F.when((F.col("braking") >= 0.75) & (F.col("slowdown_median") >= 1.5), "strong")
        .when((F.col("braking") >= 0.5) | (F.col("slowdown_median") >= 1.0), "moderate")
        .otherwise("weak")
    )
    advice = (
        F.when(F.col("pass_count") < settings["minimum_passes"], "recommended_review")
        .when(F.col("score") >= settings["accept_score"], "accepted")
        .when(F.col("score") >= settings["review_score"], "recommended_review")
        .otherwise("rejected")
    )
    names = ("entry_p10", "entry_p25", "entry_median", "entry_p75", "entry_p90")
    return (
        scored.join(spread, event)
        .withColumns({n: F.col("q")[i] for i, n in enumerate(names)})
        .withColumns(parts)
        .withColumn("score", score)
        .withColumn("slowdown_signature", signature)
        .withColumn("recommendation", advice)
        .drop("q", "__cov", "__ve", "__vp")
    )


def sustained_response(passes: DataFrame, event: str, entry: str, least: str, place: str, settings: Mapping[str, float]) -> DataFrame:
    """Five checks on the response minimum per event and the share passed; events with few complete passes fail.

    Success of a slowdown is tested against chance by the binomial tail;
    medians must move little when one pass is left out.
    """
    complete = passes.where(F.col(entry).isNotNull() & F.col(least).isNotNull() & F.col(place).isNotNull())
    sums = complete.groupBy(F.struct(event).alias("__k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(entry) - F.col(least) >= settings["slowdown_threshold"]).alias("successes")
    )
    counts = ordered.counted(complete, [event], {"speed": F.col(least).cast("double"), "place": F.col(place).cast("double")})
    quarters = ordered.quantiles_of(counts, [event], {f"__{of}{p}": (of, p / 100) for of in ("speed", "place") for p in (25, 75)})
    iqr = {f"{of}_iqr": F.col(f"__{of}75") - F.col(f"__{of}25") for of in ("speed", "place")}
    shifts = leave_one_out_shifts(counts, [event], {of: f"{of}_shift" for of in ("speed", "place")})
    out = sums
    for part in (quarters.select(event, *[c.alias(n) for n, c in iqr.items()]), shifts):
        out = out.join(part.withColumn("__k", F.struct(event)).drop(event), "__k", "left")
    out = stage(out.select(f"__k.{event}", *[c for c in out.columns if c != "__k"]), "responses")
    drop(counts)
    p = binomial_upper_tail(F.col("successes"), F.col("n").cast("double"))
    checks: list[Column] = [
        (F.col("successes") / F.col("n") >= 0.8) & (F.col("p_value") <= 0.05),
        F.col("speed_iqr") <= settings["repeatability_scale"],
        F.col("place_iqr") <= max(5.0, 2 * settings["spacing"]),
        F.col("speed_shift") <= max(0.25, 0.25 * settings["repeatability_scale"]),
        F.col("place_shift") <= max(2.5, settings["spacing"]),
    ]
    passed = sum((F.coalesce(c, F.lit(False)).cast("double") for c in checks), F.lit(0.0)) / len(checks)
    enough = F.col("n") >= settings["minimum_passes"]
    return (
        out.withColumn("p_value", p)
        .withColumn("confidence", F.when(enough, 100 * passed).otherwise(0.0))
        .withColumn("evidence_pass", enough & (passed == 1.0))
    )


def interval_metrics(samples: DataFrame, keys: list[str], rel: str, value: str, windows: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Medians of ``value`` in windows of ``rel``, the least value with its place, and where it first recovers.

    Recovery: the nearest place after the minimum where 98 % of the first
    window's median is reached again.
    """
    inside = {n: F.col(rel).between(a, b) for n, (a, b) in windows.items()}
    first = next(iter(windows))
    base = samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.median(F.when(c, F.col(value))).alias(n) for n, c in inside.items()],
        F.min(F.struct(F.col(value).alias("v"), F.col(rel).alias("at"))).alias("low"),
    )
    joined = samples.join(base, keys)
    back = joined.where((F.col(rel) > F.col("low.at")) & (F.col(value) >= 0.98 * F.col(first))).groupBy(*keys).agg(F.min(rel).alias("recovered_at"))
    return base.join(back, keys, "left").select(
        *keys, *windows, F.col("low.v").alias("least"), F.col("low.at").alias("least_at"), (F.col("recovered_at") - F.col("low.at")).alias("recovery")
    )


def stability_by_case(cases: DataFrame, gate: str, category: str, nominal: str, accepted: str, score: str) -> DataFrame:
    """Per gate over robustness cases: share of cases that accept it, quantiles of its score, and where it stands.

    core: accepted nominally and in 80 % of the other cases; conditional: in
    half of them; near_miss: rejected nominally but accepted in a fifth.
    """
    other = F.col(category) != nominal
    out = cases.groupBy(gate).agg(
        F.count_if(other).alias("cases"),
        F.bool_or((~other) & F.col(accepted)).alias("nominal_accepted"),
        F.avg(F.when(other, F.col(accepted).cast("double"))).alias("accepted_share"),
        F.percentile(F.when(other, F.col(score)), 0.1).alias("score_p10"),
        F.percentile(F.when(other, F.col(score)), 0.9).alias("score_p90"),
    )
    share = F.coalesce("accepted_share", F.lit(0.0))
    frontier = (
        F.when(F.col("nominal_accepted") & (share >= 0.8), "core")
        .when(F.col("nominal_accepted") | (share >= 0.5), "conditional")
        .when(share >= 0.2, "near_miss")
        .otherwise("unsupported")
    )
    return out.withColumn("frontier", frontier)


def set_agreement(cases: DataFrame, case: str, item: str, nominal: str) -> DataFrame:
    """Per case: items in common with the nominal case, Jaccard similarity, retained share and new items."""
    items = cases.select(case, item).distinct()
    base = items.where(F.col(case) == nominal).select(item, F.lit(1).alias("__in"))
    size = F.broadcast(base.agg(F.count(F.lit(1)).alias("__base")))  # one row
    shared = items.join(base, item, "left").groupBy(case).agg(F.count(F.lit(1)).alias("own"), F.count("__in").alias("common"))
    return shared.join(size).select(
        case,
        "own",
        "common",
        F.try_divide(F.col("common"), F.col("own") + F.col("__base") - F.col("common")).alias("jaccard"),
        F.try_divide("common", "__base").alias("retained"),
        (F.col("own") - F.col("common")).alias("new_items"),
    )


def share_at_most(rows: DataFrame, key: str, value: str, baseline: DataFrame, baseline_value: str) -> DataFrame:
    """Per row, the share of baseline values that are not above its own.

    Values fall into a thousand equal cells; running counts are taken within a
    cell and added to those of the cells below, so neither all rows are
    compared with all values nor sorted in one task.
    """
    known = baseline.where(F.col(baseline_value).isNotNull()).select(F.col(baseline_value).alias("__v"), F.lit(1).alias("__c"))
    ends = known.agg(F.min("__v").alias("a"), F.max("__v").alias("b"), F.count(F.lit(1)).alias("n")).first()  # three numbers
    both = rows.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(1).alias("__row")).unionByName(known, allowMissingColumns=True)
    width = None if ends["n"] == 0 else float(ends["b"]) - float(ends["a"])
    share = F.coalesce(F.try_divide(F.col("__v") - F.lit(ends["a"]), F.lit(width).cast("double")), F.lit(0.0))
    placed = both.withColumn("__cell", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1000.0), share * 1000))))
    below = Window.partitionBy(F.lit(1)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("__cell").agg(F.sum("__c").alias("__own")).withColumn("__below", F.coalesce(F.sum("__own").over(below), F.lit(0)))
    upto = Window.partitionBy("__cell").orderBy("__v").rangeBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("__in", F.coalesce(F.sum("__c").over(upto), F.lit(0))).join(F.broadcast(cells.select("__cell", "__below")), "__cell")
    at = F.try_divide(F.col("__in") + F.col("__below"), F.lit(ends["n"]))
    return counted.where("__row = 1").select(F.col("__k").alias(key), F.col("__v").alias(value), at.alias("share"))
