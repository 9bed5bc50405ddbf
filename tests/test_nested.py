"""JSON-safe values of random schemas, documents without a schema, and far tails."""

import base64
import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsight.functions import distributions, nested


def made(r, kind):
    """A random value of a type and what JSON should hold."""
    if r.random() < 0.15:
        return None, None
    if isinstance(kind, T.DoubleType):
        v = r.choice([1.5, -2.0, float("nan"), float("inf"), float("-inf"), 0.0])
        return v, (v if math.isfinite(v) else None)
    if isinstance(kind, T.LongType):
        return (v := r.randint(-9, 9)), v
    if isinstance(kind, T.StringType):
        return (v := r.choice(["", "ä", 'q"'])), v
    if isinstance(kind, T.BooleanType):
        return (v := r.random() < 0.5), v
    if isinstance(kind, T.BinaryType):
        return (v := r.choice([b"", b"\xff\x00"])), base64.b64encode(v).decode()
    if isinstance(kind, T.DateType):
        v = dt.date(2026, r.randint(1, 12), 3)
        return v, v.isoformat()
    if isinstance(kind, T.TimestampType):
        v = dt.datetime(2026, 1, r.randint(1, 28), 5, 6, 7, 80, tzinfo=dt.UTC)
        return v, v.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    if isinstance(kind, T.ArrayType):
        pairs = [made(r, kind.elementType) for _ in range(r.randint(0, 3))]
        return [a for a, _ in pairs], [b for _, b in pairs]
    if isinstance(kind, T.MapType):
        pairs = {i: made(r, kind.valueType) for i in range(r.randint(0, 3))}
        return {i: a for i, (a, _) in pairs.items()}, {str(i): b for i, (_, b) in pairs.items()}
    pairs = {f.name: made(r, f.dataType) for f in kind.fields}
    return tuple(a for a, _ in pairs.values()), {n: b for n, (_, b) in pairs.items()}


def random_type(r, depth=0):
    plain = [T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType(), T.BinaryType(), T.DateType(), T.TimestampType()]
    pick = r.random()
    if depth >= 3 or pick < 0.4:
        return r.choice(plain)
    if pick < 0.6:
        return T.ArrayType(random_type(r, depth + 1))
    if pick < 0.75:
        return T.MapType(T.LongType(), random_type(r, depth + 1))
    return T.StructType([T.StructField(f"f{i}", random_type(r, depth + 1)) for i in range(r.randint(1, 3))])


@pytest.mark.parametrize("seed", range(6))
def test_random_schemas(spark, seed):
    r = random.Random(seed)
    kind = T.StructType([T.StructField(n, random_type(r)) for n in ("a", "b c", "d.e")])
    pairs = [made(r, kind) for _ in range(12)]
    pairs = [p for p in pairs if p[0] is not None]
    got = [json.loads(x[0]) for x in nested.as_json(spark.createDataFrame([p[0] for p in pairs], kind).coalesce(1)).collect()]
    assert got == [p[1] for p in pairs]


def test_documents_without_a_schema(spark):
    texts = ['{"gates": [{"active": true, "n": 2}, {"active": false}, {"n": "x"}, 5], "length": 12.5}', '{"gates": {"not": "a list"}, "length": "long"}', "[1, 2]", '{"gates": [', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [tuple(r)[2:] for r in nested.inventory(df, "text", {"all": ("$.gates", {}), "on": ("$.gates", {"active": True}), "two": ("$.gates", {"active": True, "n": 2})}, {"length": ("$.length", "double")}).orderBy("i").collect()]
    assert got == [(False, 4, 1, 1, 12.5), (False, 0, 0, 0, None), (False, 0, 0, 0, None), (True, None, None, None, None), (True, None, None, None, None), (False, None, None, None, None)]


def test_evidence(spark):
    texts = ['{"s": [{"run": "a", "lap": 1, "ok": true}, {"run": "a", "lap": 1, "ok": false}, {"run": "b", "lap": 1}, {"run": "c"}]}', "{", '{"s": []}']
    df = spark.createDataFrame([("k", t) for t in texts] + [(None, '{"s": [{"run": "a", "lap": 1}]}'), ("m", "{}")], "k string, text string")
    got = {r["k"]: tuple(r)[1:] for r in nested.evidence(df, ["k"], "text", "$.s", {"run": ("$.run", "string"), "lap": ("$.lap", "int")}, {"ok": ("$.ok", "boolean", True)}).collect()}
    assert got["k"] == (3, 1, 4, 2, 1) and got["m"] == (1, 0, 0, 0, 0) and got[None][:2] == (1, 0)


def test_normal_tail(spark):
    zs = [i / 8 for i in range(-240, 241)] + [3.9999999, 4.0, 4.753424308822899, 37.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", distributions.normal_tail(F.col("z")).alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(r["z"] / math.sqrt(2))
        assert abs(r["p"] - want) <= 1e-9 * want
    odd = spark.createDataFrame([(None,), (float("nan"),)], "z double").select(distributions.normal_tail(F.col("z"))).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0])


def test_impossible_tails(spark):
    rows = [(5.0, 1.0, 0.0, None), (4.0, 1.0, 0.0, None), (1.0, 0.0, 2.0, None), (3.0, 0.0, 2.0, None), (0.0, 1.0, None, 5.0), (0.0, 1.0, -1.0, 1.0)]
    df = spark.createDataFrame(rows, "m double, s double, a double, b double")
    got = [r[0] for r in df.coalesce(1).select(distributions.impossible_tail(F.col("m"), F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert [x > 1e-6 for x in got] == [False, True, True, False, False, True] and abs(got[5] - math.erfc(1 / math.sqrt(2))) < 1e-12
