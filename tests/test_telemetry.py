import datetime as dt
import math

import numpy as np
import pytest

from lapsight.operators import consensus, events, series, telemetry as t
from lapsight.sources import tracks

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
NORMAL, BAD = (43.0, -79.0), (43.01, -79.01)


def points(spark, places, run="r"):
    rows = [(run, 0, 0, i, T0 + dt.timedelta(seconds=i), float(a), float(b), None, None, None) for i, (a, b) in enumerate(places)]
    return spark.createDataFrame(
        rows,
        "run_id string, track_index int, segment_index int, point_index int, timestamp_utc timestamp, latitude_deg double, longitude_deg double, "
        "device_distance_m double, device_speed_mps double, reported_speed_mps double",
    )


def along(n, start=0):
    return [(43.0 + 0.00003 * (start + i), -79.0) for i in range(n)]


def test_isolated_excursion_is_removed(spark):
    p = points(spark, [*along(2), BAD, *along(2, 2)])
    kept, rejected = t.clean(t.kinematics(p))
    assert [r["point_index"] for r in rejected.collect()] == [2]
    assert kept.count() == 4 and kept.agg({"step_distance_m": "max"}).first()[0] < 10


def test_sustained_excursion_stays(spark):
    far = [(43.01 + 0.00003 * i, -79.01) for i in range(4)]
    kept, rejected = t.clean(t.kinematics(points(spark, [*along(2), *far, *along(2, 2)])))
    assert rejected.count() == 0 and kept.count() == 8


def test_cap_is_all_or_nothing(spark):
    places = [*along(2), BAD, along(3)[2], BAD, along(4)[3]]
    _, rejected = t.clean(t.kinematics(points(spark, places)), most=1)
    assert rejected.count() == 0


GPX = """<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="1"/><trk><name>a</name>
<trkseg><trkpt lat="43" lon="-79"><ele>100</ele><time>2026-01-01T00:00:00Z</time><extensions><speed>3.5</speed></extensions></trkpt>
<trkpt lat="43.00001" lon="-79"><ele>101</ele><time>nonsense</time></trkpt></trkseg>
<trkseg><trkpt lat="95" lon="-79"><ele>102</ele></trkpt><trkpt lat="43.1" lon="-79"><ele>102</ele><time>2026-01-01T00:00:09</time></trkpt></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    got = tracks.canonical_points(tracks.read_gpx(spark, str(tmp_path / "a.gpx")), "run")
    rows = got.points.orderBy("segment_index", "point_index").collect()
    assert [(r["segment_index"], r["point_index"]) for r in rows] == [(0, 0), (0, 1), (1, 1)]
    assert [r["elevation_m"] for r in rows] == [100, 101, 102]
    s = got.summary.first()
    assert (s["points"], s["invalid_positions"], s["missing_times"], s["invalid_times"], s["naive_times"]) == (4, 1, 1, 1, 1)
    assert got.rejected.count() == 1


def test_gpx_with_entities_fails(spark, tmp_path):
    bad = '<?xml version="1.0"?><!DOCTYPE gpx [<!ENTITY x SYSTEM "file:///etc/hostname">]><gpx><trk><name>&x;</name><trkseg><trkpt lat="1" lon="1"/></trkseg></trk></gpx>'
    (tmp_path / "a.gpx").write_text(bad)
    with pytest.raises(Exception):  # noqa: B017
        tracks.read_gpx(spark, str(tmp_path / "a.gpx")).collect()


def course(spark, n_laps=6, cutter=None):
    """Laps of a rectangle with a corner, at 8 m/s; one lap may leave the corner out."""
    corners = [(0, 0), (0, 100), (100, 100), (130, 70), (100, 40), (100, 0), (0, 0)]
    rows, time, index = [], 0.0, 0
    for lap in range(n_laps):
        way = [c for c in corners if not (lap == cutter and c == (130, 70))]
        for a, b in zip(way, way[1:], strict=False):
            for k in range(12):
                x, y = a[0] + (b[0] - a[0]) * k / 12 + 0.1 * (lap - 2), a[1] + (b[1] - a[1]) * k / 12 + 0.1 * math.sin(lap)
                step = math.dist(a, b) / 12
                rows.append(("r", 0, 0, index, T0 + dt.timedelta(seconds=time), x, y, step, 8.0, step / 8.0))
                time, index = time + step / 8.0, index + 1
    rows.append(("r", 0, 0, index, T0 + dt.timedelta(seconds=time), 0.0, 0.0, 8.0, 8.0, 1.0))
    return spark.createDataFrame(
        rows, "run_id string, track_index int, segment_index int, point_index int, timestamp_utc timestamp, x_m double, y_m double, step_distance_m double, analysis_speed_mps double, time_step_s double"
    )


def test_laps_and_consensus(spark):
    p = course(spark, 7, cutter=6).cache()
    crossings = t.gate_crossings(p, 0, 0, 9.0, 20.0)
    assert crossings.count() == 8
    table, members = t.laps(p, crossings)
    assert table.where("valid").count() == 7
    assert members.groupBy("point_index").count().where("count = 2").count() == 6
    nodes = t.resample(members, 120, ["lap_id"])
    rules = consensus.Rules(p95_limit_m=3.0, sustained_error_m=3.0, smooth=(1, 1))  # smoothing rounds the corners off
    found = consensus.consensus(nodes, "lap_id", "node", rules)
    line = found.line
    got = {r["lap_id"]: r["included"] for r in found.laps.collect()}
    assert found.laps.where("reference").count() == 1 and found.laps.where("reference and included").count() == 1
    assert not got[6] and all(got[i] for i in range(6))
    assert line.where("y_m between 55 and 85").agg({"x_m": "max"}).first()[0] > 120
    matched = t.project(members.where("lap_id = 0").select("x_m", "y_m"), line)
    assert matched.agg({"map_error_m": "max"}).first()[0] < 2


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(1)
    angle = np.linspace(0, 2 * math.pi, 60, endpoint=False)
    line = spark.createDataFrame([(float(i), float(50 * math.cos(a)), float(30 * math.sin(a))) for i, a in enumerate(angle)], "node double, x_m double, y_m double")
    places = rng.normal(0, 40, (40, 2))
    got = t.project(spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(places)], "i int, x_m double, y_m double"), line).orderBy("i").collect()
    xy = np.stack([50 * np.cos(angle), 30 * np.sin(angle)], axis=1)
    for r, p in zip(got, places, strict=True):
        best = min(
            math.dist(p, a + np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1) * (b - a)) for a, b in zip(xy, np.roll(xy, -1, axis=0), strict=True)
        )
        assert abs(best - r["map_error_m"]) < 1e-9


def test_bracketed_outlier(spark):
    rows = [(1, i, e) for i, e in enumerate([2.0, 3.0, 75.0, 3.0, 2.0, 2.0])]
    out = t.bracketed_outliers(spark.createDataFrame(rows, "lap_id int, point_index int, map_error_m double"), ["lap_id"], "point_index", "map_error_m")
    assert [r["point_index"] for r in out.collect()] == [2]


def test_interpolation_equals_numpy(spark):
    xs, ys = [0.0, 1.0, 4.0, 6.0], [1.0, 3.0, -3.0, 0.0]
    grid = [-1.0, 0.0, 0.5, 2.5, 4.0, 5.9, 6.0, 9.0]
    s = spark.createDataFrame([("a", x, y) for x, y in zip(xs, ys, strict=True)], "k string, x double, y double")
    g = spark.createDataFrame([("a", x) for x in grid], "k string, x double")
    got = [r["y"] for r in series.interpolate(s, g, ["k"], "x", "y").orderBy("x").collect()]
    assert np.allclose(got, np.interp(grid, xs, ys))


def test_gradient_equals_numpy(spark):
    xs, ys = [0.0, 1.0, 4.0, 6.0, 7.0], [1.0, 3.0, -3.0, 0.0, 5.0]
    rows = spark.createDataFrame([("a", x, y) for x, y in zip(xs, ys, strict=True)], "k string, x double, y double")
    got = [r["g"] for r in series.gradient(rows, ["k"], "x", "y", "g").orderBy("x").collect()]
    assert np.allclose(got, np.gradient(ys, xs))


def test_ordered_choice_never_goes_back(spark):
    rows = [("c", 1, 0, 10.0, 1.0), ("c", 1, 1, 300.0, 0.5), ("c", 2, 0, 50.0, 2.0), ("c", 2, 1, 5.0, 0.1), ("c", 3, 0, 40.0, 0.1), ("c", 3, 1, 90.0, 3.0)]
    df = spark.createDataFrame(rows, "course string, sequence int, candidate int, s double, e double")
    got = [r["s"] for r in events.ordered_choice(df, "course", "sequence", "s", "e").orderBy("sequence").collect()]
    assert got == [10.0, 50.0, 90.0]


@pytest.mark.parametrize(
    ("anchor", "starts", "ends", "want"),
    [
        (200.0, [(200.0, 0.5), (700.0, 1.5)], [(235.0, 2.7), (195.0, 40.0)], (200.0, 35.0, 2.7, False, False)),
        (200.0, [(235.0, 1.0)], [(200.0, 1.0)], (200.0, 35.0, 1.0, True, False)),
        (980.0, [(980.0, 1.0)], [(20.0, 1.0)], (980.0, 40.0, 1.0, False, True)),
    ],
)
def test_endpoints(spark, anchor, starts, ends, want):
    rows = [("e", "start", s, e, anchor) for s, e in starts] + [("e", "end", s, e, anchor) for s, e in ends]
    df = spark.createDataFrame(rows, "event string, endpoint string, s double, error double, anchor double")
    r = events.endpoint_pairs(df, "event", "s", "error", "anchor", 1000.0).first()
    assert (r["start"], r["length"], r["end_error"], r["reordered"], r["wraps"]) == want


def test_interval_audit(spark):
    rows = [(100.0, 0.0, 30.0), (980.0, 0.0, 40.0), (300.0, 0.0, 990.0)]
    out = events.interval_audit(spark.createDataFrame(rows, "anchor_s_m double, feature_start_rel_m double, feature_end_rel_m double"), 1000.0)
    flags = {r["anchor_s_m"]: r["interval_flags"] for r in out.collect()}
    assert flags[100.0] == [] and flags[980.0] == ["interval_wraps_start_finish"] and "near_full_lap" in flags[300.0]


def test_distinct_candidates(spark):
    rows = [("e", s, d) for s, d in [(10.0, 1.0), (20.0, 2.0), (990.0, 3.0), (500.0, 4.0)]]
    out = events.distinct_candidates(spark.createDataFrame(rows, "event string, s double, error double"), "event", "s", "error", 1000.0)
    assert [r["s"] for r in out.orderBy("candidate").collect()] == [10.0, 990.0, 500.0]
