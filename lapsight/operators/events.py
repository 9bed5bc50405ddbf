"""Events on a closed course: candidate places, their order, intervals and groups."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsight.functions import circular


def distinct_candidates(projections: DataFrame, event: str, place: str, error: str, length: float, separation: float = 18.0, most: int = 12) -> DataFrame:
    """Per event, the nearest places that are apart from nearer ones: a fold over the event's places by error."""
    kind = "array<struct<e:double,s:double>>"
    ordered = projections.groupBy(event).agg(F.array_sort(F.collect_list(F.struct(F.col(error).alias("e"), F.col(place).alias("s")))).alias("all"))

    def step(done: Column, c: Column) -> Column:
        close = F.exists(done, lambda d: circular.shortest(d["s"], c["s"], length) < separation)
        return F.when((F.size(done) >= most) | close, done).otherwise(F.concat(done, F.array(c)))

    kept = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), step)
    return ordered.select(event, F.posexplode(kept).alias("candidate", "c")).select(event, "candidate", F.col("c.s").alias(place), F.col("c.e").alias(error))


def ordered_choice(candidates: DataFrame, course: str, sequence: str, place: str, error: str, slack: float = 3.0) -> DataFrame:
    """One candidate per event so that places don't go back along the course and errors are small.

    The cost of a path is the sum of squared errors, a start far from the gate,
    and a large penalty for each step back of more than ``slack``. A course has
    tens of events; each is one group.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        stages = [g.reset_index(drop=True) for _, g in frame.sort_values([sequence, "candidate"]).groupby(sequence)]
        cost = stages[0][error].to_numpy(float) ** 2 + (stages[0][place].to_numpy(float) / 5) ** 2
        came_from = []
        for before, now in zip(stages, stages[1:], strict=False):
            ahead = now[place].to_numpy(float)[:, None] - before[place].to_numpy(float)
            through = cost + np.where(ahead >= -slack, 0.0, 1e6 - 1e4 * ahead)
            came_from.append(through.argmin(axis=1))
            cost = through.min(axis=1) + now[error].to_numpy(float) ** 2
        at = [int(cost.argmin())]
        for back in reversed(came_from):
            at.append(int(back[at[-1]]))
        return pd.concat([g.iloc[[i]] for g, i in zip(stages, reversed(at), strict=True)])

    return candidates.groupBy(course).applyInPandas(choose, candidates.schema)


def endpoint_pairs(candidates: DataFrame, event: str, place: str, error: str, anchor: str, length: float, ambiguity: float = 3.0) -> DataFrame:
    """Per event, the best pair of a start and an end place around its anchor.

    Both orders are tried; a pair's score is its errors, the distances of both
    ends to the anchor weighing little, and a cost for being the wrong way
    round. Pairs within ``ambiguity`` of the best are marked.
    """
    ends = lambda kind, s, e: candidates.where(F.col("endpoint") == kind).select(event, F.col(anchor).alias("__anchor"), F.col(place).alias(s), F.col(error).alias(e))
    pairs = ends("start", "a", "ea").join(ends("end", "b", "eb").drop("__anchor"), event)
    both = F.array(
        F.struct(F.col("a").alias("start"), F.col("b").alias("end"), F.col("ea").alias("start_error"), F.col("eb").alias("end_error"), F.lit(False).alias("reordered")),
        F.struct(F.col("b").alias("start"), F.col("a").alias("end"), F.col("eb").alias("start_error"), F.col("ea").alias("end_error"), F.lit(True).alias("reordered")),
    )
    tried = pairs.select(event, "__anchor", F.inline(both)).withColumn("length", circular.forward(F.col("start"), F.col("end"), length))
    near = circular.shortest(F.col("start"), F.col("__anchor"), length) + circular.shortest(F.col("end"), F.col("__anchor"), length)
    score = F.col("start_error") + F.col("end_error") + 0.05 * near + F.when(F.col("length") > length / 2, 1000.0).otherwise(0.0) + F.col("reordered").cast("double")
    w = Window.partitionBy(event).orderBy("score", "start", "end")
    ranked = tried.withColumn("score", score).withColumn("__i", F.row_number().over(w)).withColumn("__next", F.lead("score").over(w))
    return ranked.where("__i = 1").select(
        event, "start", "end", "length", "start_error", "end_error", "reordered", (F.col("end") < F.col("start")).alias("wraps"),
        F.coalesce(F.col("__next") - F.col("score") < ambiguity, F.lit(False)).alias("ambiguous"),
    )


def response_groups(events: DataFrame, group: str, length: float) -> DataFrame:
    """Events of one response as one feature: extent, anchors of its ends, members in order and their flags."""
    first = F.struct("sequence", "event_id")
    return events.groupBy(group).agg(
        F.count(F.lit(1)).alias("events"),
        F.min_by("name", first).alias("name"),
        F.min_by("anchor_s", first).alias("first_anchor_s"),
        F.max_by("anchor_s", first).alias("last_anchor_s"),
        F.min(F.col("start_rel")).alias("start_rel"),
        F.max(F.col("end_rel")).alias("end_rel"),
        F.bool_or("gate_candidate").alias("gate_candidate"),
        F.max("error_m").alias("error_m"),
        F.transform(F.array_sort(F.collect_list(F.struct("sequence", "event_id"))), lambda x: x["event_id"]).alias("event_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
    ).withColumn("span", circular.forward(F.col("first_anchor_s"), F.col("last_anchor_s"), length))


def interval_audit(features: DataFrame, length: float, near_full: float = 0.9) -> DataFrame:
    """Absolute interval of each feature, its share of the course and flags."""
    start = F.col("anchor_s_m") + F.col("feature_start_rel_m")
    span = F.col("feature_end_rel_m") - F.col("feature_start_rel_m")
    at = circular.interval(start, F.col("anchor_s_m") + F.col("feature_end_rel_m"), length)
    flags = F.array_compact(
        F.array(F.when(F.col("i.wraps"), "interval_wraps_start_finish"), F.when(span <= 0, "empty_interval"), F.when(span >= near_full * length, "near_full_lap"))
    )
    return features.withColumn("i", at).select("*", F.col("i.start").alias("start_s"), F.col("i.end").alias("end_s"), (span / length).alias("share"), flags.alias("interval_flags")).drop("i")


def event_windows(events: DataFrame, course: str, sequence: str, group: str, length: float, windows: Mapping[str, tuple[str, float, float]], most_error: float, apart: float = 3.0) -> DataFrame:
    """Extent of each placed event relative to its anchor, windows around it, errors and flags for review.

    An event has its place ``anchor_s`` with ``error_m``, the next best
    place's ``other_error_m``, ``is_interval`` and, for start and end,
    a place ``<end>_s`` with ``<end>_error_m`` and ``<end>_uncertainty_m`` or,
    where that place is null, the extent ``before_m`` or ``after_m`` with its
    uncertainty, to which the anchor's is added. ``windows`` names intervals as
    (start or end, first offset, last offset). An end that is not after the
    start is a course further on. Neighbours in the order of ``sequence``, the
    last and the first included, that overlap are both marked unless they
    share a ``group``; null groups are one. Null errors raise no flag.
    """
    out = events
    for end, extent, sign in (("start", "before", -1.0), ("end", "after", 1.0)):
        placed = F.col(f"{end}_s").isNotNull()
        assumed = F.hypot("anchor_uncertainty_m", f"{extent}_uncertainty_m")
        out = out.withColumns(
            {
                f"{end}_rel": F.when(placed, circular.signed(F.col("anchor_s"), F.col(f"{end}_s"), length)).otherwise(F.col(f"{extent}_m") * sign),
                f"{end}_source": F.when(placed, "placed").otherwise("assumed"),
                f"{end}_error_m": F.when(placed, F.col(f"{end}_error_m")).otherwise(F.col("error_m")),
                f"{end}_uncertainty_m": F.when(placed, F.col(f"{end}_uncertainty_m")).otherwise(assumed),
            }
        ).withColumn(f"{end}_effective_m", F.hypot(f"{end}_error_m", f"{end}_uncertainty_m"))
    out = out.withColumn("end_rel", F.when(F.col("end_rel") <= F.col("start_rel"), F.col("end_rel") + length).otherwise(F.col("end_rel")))
    for name, (end, first, last) in windows.items():
        out = out.withColumns({f"{name}_from": F.col(f"{end}_rel") + first, f"{name}_to": F.col(f"{end}_rel") + last})

    around = Window.partitionBy(course).orderBy(sequence, "anchor_s", group)  # a course has tens of events
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((F.col("anchor_s") + F.col("start_rel")).alias("a"), (F.col("anchor_s") + F.col("end_rel")).alias("b"), F.col(group).alias("g"))
    out = out.withColumn("__own", own).withColumns({"__next": F.lead("__own").over(around), "__first": F.first("__own").over(whole), "__n": F.count(F.lit(1)).over(whole)})
    starts = F.when(F.col("__next").isNotNull(), F.col("__next.a")).otherwise(F.col("__first.a") + length)
    same = F.col("__own.g").eqNullSafe(F.when(F.col("__next").isNotNull(), F.col("__next.g")).otherwise(F.col("__first.g")))
    out = out.withColumn("__hits", F.coalesce((F.col("__n") > 1) & (starts < F.col("__own.b")) & ~same, F.lit(False)))
    out = out.withColumn("__hit", F.coalesce(F.lag("__hits").over(around), F.last("__hits").over(whole)))
    far = lambda c: F.col(c) > most_error
    flags = {
        "anchor_far": far("error_m"),
        "other_branch_near": F.col("other_error_m") - F.col("error_m") < apart,
        "extent_assumed": F.col("is_interval") & (F.col("start_source") == "assumed") & (F.col("end_source") == "assumed"),
        "start_far": far("start_error_m"),
        "end_far": far("end_error_m"),
        "overlaps_neighbour": F.col("__hits") | F.col("__hit"),
    }
    listed = F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()])), ";")
    return out.withColumn("flags", listed).drop("__own", "__next", "__first", "__n", "__hits", "__hit")
