"""Windows around events: neighbours over the finish, missing values, single events."""

from lapsight.operators.events import event_windows

COLUMNS = (
    "course string, seq int, grp string, is_interval boolean, anchor_s double, error_m double, other_error_m double, anchor_uncertainty_m double, start_s double, start_error_m double, "
    "start_uncertainty_m double, end_s double, end_error_m double, end_uncertainty_m double, before_m double, before_uncertainty_m double, after_m double, after_uncertainty_m double"
)
WINDOWS = {"entry": ("start", -8.0, -1.0), "exit": ("end", 2.0, 12.0)}


def event(course, seq, grp, at, before=5.0, after=5.0, start=None, end=None, error=1.0, other=None, interval=True):
    return (course, seq, grp, interval, at, error, other, 3.0, start, 30.0, 6.0, end, None, 8.0, before, 4.0, after, 4.0)


def windows(spark, rows):
    out = event_windows(spark.createDataFrame(rows, COLUMNS).repartition(3), "course", "seq", "grp", 100.0, WINDOWS, most_error=20.0)
    return {(r["course"], r["seq"]): r for r in out.collect()}


def test_extents_errors_and_windows(spark):
    out = windows(spark, [event("a", 1, "x", 10.0, start=95.0, end=12.0), event("a", 2, "y", 50.0, interval=False), event("e", 3, "z", 70.0, start=75.0, error=25.0, other=27.0)])
    a, b, c = out["a", 1], out["a", 2], out["e", 3]
    assert (a["start_rel"], a["end_rel"], a["start_source"], a["end_source"]) == (-15.0, 2.0, "placed", "placed")
    assert (a["entry_from"], a["entry_to"], a["exit_from"], a["exit_to"]) == (-23.0, -16.0, 4.0, 14.0)
    assert a["flags"] == "start_far" and a["end_effective_m"] is None
    assert (b["start_rel"], b["end_rel"], b["start_uncertainty_m"], b["flags"]) == (-5.0, 5.0, 5.0, "")
    assert (c["start_rel"], c["end_rel"], c["end_source"]) == (5.0, 105.0, "assumed")  # not after the start: a course further on
    assert c["flags"] == "anchor_far;other_branch_near;start_far;end_far"


def test_neighbours(spark):
    rows = [event("a", i, f"g{i}", s) for i, s in ((1, 2.0), (2, 30.0), (3, 38.0), (4, 95.0))]  # 2 and 3 overlap, 4 and 1 over the finish
    rows += [event("b", 1, None, 10.0), event("b", 2, None, 12.0), event("c", 1, "x", 50.0, before=60.0, after=60.0), event("d", 1, "x", 10.0), event("d", 2, "y", None), event("d", 3, "z", 11.0)]
    out = windows(spark, rows)
    hit = {k for k, r in out.items() if "overlaps_neighbour" in r["flags"]}
    assert hit == {("a", i) for i in (1, 2, 3, 4)}  # not: null groups are one, a single event, a place that is missing
    assert len(out) == len(rows) and windows(spark, []) == {}
