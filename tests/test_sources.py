"""Headers, fixes, extensions and TOML."""

import datetime as dt
import math
import tomllib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lapsight.sources import results, tracks


def test_migrated_anchors(spark):
    rows = spark.createDataFrame(
        [("1", "43.0", "-79", "a"), ("2", "95", "-79", "b"), ("3", "", "-79", "c"), (None, "43", "-79", "d"), ("5", "x", "-79", "e"), ("6", " 44 ", "10", None)],
        "`Event-ID` string, LAT string, `Lon` string, note string",
    )
    aliases = {"id": ["event_id"], "latitude_deg": ["latitude", "lat"], "longitude_deg": ["lng", "lon"], "name": ["title"], "notes": ["note"]}
    kept, rejected = tracks.migrated_anchors(rows, aliases, ["id", "latitude_deg", "longitude_deg"])
    assert [tuple(r) for r in kept.orderBy("id").collect()] == [("1", 43.0, -79.0, "a"), ("6", 44.0, 10.0, None)]
    assert {r["notes"]: r["reason"] for r in rejected.collect()} == {"b": "invalid_position", "c": "no latitude_deg", "d": "no id", "e": "invalid_position"}
    with pytest.raises(ValueError, match="no column for id"):
        tracks.migrated_anchors(rows.drop("Event-ID"), aliases, ["id"])


def test_clean_fixes(spark):
    t = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", t, 1.0), ("a", t, 3.0), ("a", None, 2.0), ("a", t, -5.0), ("b", t, None), (None, t, 4.0)], "k string, t timestamp, v double")
    kept, counts = tracks.clean_fixes(rows, ["k"], "t", ["v"], F.col("v") >= 0)
    assert {(r["k"], r["fixes"], r["v"]) for r in kept.collect()} == {("a", 2, 2.0), (None, 1, 4.0)}
    assert {r["k"]: (r["rows"], r["invalid"], r["repeated"]) for r in counts.collect()} == {"a": (4, 2, 1), "b": (1, 1, 0), None: (1, 0, 0)}


def test_extension_values(spark):
    texts = ["<x:hr>120</x:hr><y><y:hr>7</y:hr><x:hr>9</x:hr></y>", "plain", "", None, "<a><b/></a><c u='1'>\n ok </c>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(tracks.extension_values(F.col("t"))).collect()] == [{"x:hr": "120", "y:hr": "7"}, {}, {}, None, {"c": "ok"}]


VALUES = st.recursive(
    st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=8) | st.dates(),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), inner, max_size=3),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), VALUES, max_size=5))
def test_toml_round_trip(document):
    assert tomllib.loads(results.toml_text(document)) == document


def test_toml_of_odd_values():
    assert math.isnan(tomllib.loads(results.toml_text({"x": float("nan")}))["x"])
    with pytest.raises(TypeError, match="NoneType"):
        results.toml_text({"x": None})
