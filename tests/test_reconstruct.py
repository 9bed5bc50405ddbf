"""A recorded run from its file to a published track."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsight.operators import consensus, reconstruct as rc
from lapsight.sources import fit, publish

LAT0, LON0, LENGTH = 43.47, -80.54, 600.0
T0 = dt.datetime(2026, 5, 1, 12, tzinfo=dt.UTC)


def run(laps=9, speed=8.0, seed=1):
    """(time, lat, lon) every second around a course of two straights and two half circles, 600 m long, with some metres of noise."""
    r, rng = 60.0, np.random.default_rng(seed)
    straight = (LENGTH - 2 * math.pi * r) / 2
    out = []
    for i in range(int(laps * LENGTH / speed) + 12):
        s = (i * speed - 20) % LENGTH
        if s < straight:
            x, y = s, -r
        elif s < straight + math.pi * r:
            a = (s - straight) / r
            x, y = straight + r * math.sin(a), -r * math.cos(a)
        elif s < 2 * straight + math.pi * r:
            x, y = straight - (s - straight - math.pi * r), r
        else:
            a = (s - 2 * straight - math.pi * r) / r
            x, y = -r * math.sin(a), r * math.cos(a)
        x, y = x + rng.normal(0, 0.4), y + rng.normal(0, 0.4)
        if i == 200:
            x, y = x + 900, y + 900  # an excursion
        m = 6_371_008.8 * math.pi / 180
        out.append((T0 + dt.timedelta(seconds=i), LAT0 + y / m, LON0 + x / m / math.cos(math.radians(LAT0))))
    return out


def gpx(points):
    body = "".join(f'<trkpt lat="{a:.8f}" lon="{b:.8f}"><ele>300</ele><time>{t:%Y-%m-%dT%H:%M:%SZ}</time></trkpt>' for t, a, b in points)
    return f'<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>r</name><trkseg>{body}</trkseg></trk></gpx>'


@pytest.fixture(scope="module")
def gate():
    return rc.Gate(LAT0 - 60 / (6_371_008.8 * math.pi / 180), LON0)


def prepared(points):
    return points.withColumn("derived_speed_mps", F.lit(None).cast("double"))


def test_gpx_to_published_track(spark, tmp_path, gate):
    (tmp_path / "r.gpx").write_text(gpx(run()))
    found = fit.ingest(spark, str(tmp_path / "r.gpx"), "r1")
    track = rc.reconstruct(prepared(found.points), gate, consensus.Rules(rounds=3))
    assert 590 < track.length_m < 610
    laps = track.laps.collect()
    assert len(laps) >= 8 and all(r["valid"] and r["included"] for r in laps) and sum(r["reference"] for r in laps) == 1
    assert [r["point_index"] for r in track.rejected.collect()] == [200]
    assert track.matched.agg(F.max("map_error_m")).first()[0] < 5
    profile = track.profile.orderBy("s").collect()
    assert len(profile) > 60 and all(6 < r["p50"] < 10 for r in profile)
    root = f"file://{tmp_path}/track"
    assert rc.publish_track(spark, root, track, {"run": "r1"}) == 1
    bundle = rc.read_bundle(spark, root)
    assert abs(bundle["length_m"] - track.length_m) < 1e-9 and bundle["about"] == {"run": "r1"} and bundle["included_laps"] == len(laps)
    assert publish.read_table(spark, root, "profile").count() == len(profile)
    publish.publish(spark, root, {"line": track.line.limit(3)}, {"bundle": bundle})
    with pytest.raises(ValueError, match="nodes"):
        rc.read_bundle(spark, root)
    assert rc.read_bundle(spark, root, 1) == bundle


def test_the_same_run_as_fit(spark, tmp_path, gate):
    rows = [{"timestamp": int(t.timestamp()) - fit.EPOCH, "position_lat": a * 2**31 / 180, "position_long": b * 2**31 / 180, "enhanced_speed": 8.0} for t, a, b in run(5)]
    (tmp_path / "r.fit").write_bytes(fit.encode(rows, ["timestamp", "position_lat", "position_long", "enhanced_speed"]))
    found = fit.ingest(spark, str(tmp_path / "r.fit"), "r1")
    track = rc.reconstruct(prepared(found.points), gate, consensus.Rules(rounds=2))
    assert 590 < track.length_m < 610 and track.laps.where("valid").count() >= 4
    assert {r["analysis_speed_source"] for r in track.points.select("analysis_speed_source").distinct().collect()} == {"device"}


def test_nothing_to_build_from(spark, gate):
    one = spark.createDataFrame([("r", 0, 0, 0, T0, None, None, None, None, None, None)], "run_id string, track_index int, segment_index int, point_index int, timestamp_utc timestamp, latitude_deg double, longitude_deg double, device_distance_m double, device_speed_mps double, reported_speed_mps double, derived_speed_mps double")
    with pytest.raises(ValueError, match="position"):
        rc.reconstruct(one, gate)
