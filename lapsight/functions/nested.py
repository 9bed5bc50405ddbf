"""Values for JSON of any schema, and counts over JSON documents without one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_value(column: Column, kind: T.DataType) -> Column:
    """A value that JSON can hold: no NaN or infinity (null instead), times and dates as ISO text, binary as base64, keys as text.

    Structs, arrays and maps are rewritten all the way down and stay null where they are.
    """
    if isinstance(kind, T.DoubleType | T.FloatType):
        wide = column.cast("double")
        return F.when(~F.isnan(wide) & (F.abs(wide) != float("inf")), column)
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    if isinstance(kind, T.StructType):
        fields = [json_value(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: json_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.struct(_key(e["key"], kind.keyType).alias("key"), json_value(e["value"], kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(F.map_entries(column), pair))
    return column


def _key(key: Column, kind: T.DataType) -> Column:
    """A map's key as text; NaN and infinities keep their names, as a key cannot be null."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return key.cast("string")
    value = json_value(key, kind)
    return F.to_json(value) if isinstance(kind, T.StructType | T.ArrayType) else value.cast("string")


def json_safe(rows: DataFrame) -> DataFrame:
    return rows.select(*[json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def as_json(rows: DataFrame, to: str = "json") -> DataFrame:
    """One JSON document per row, with nulls written out."""
    safe = json_safe(rows)
    return safe.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]), {"ignoreNullFields": "false"}).alias(to))


def _matching(wanted: Mapping[str, Any]) -> Callable[[Column], Column]:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}

    def holds(item: Column) -> Column:
        out = F.lit(True)
        for field, v in wanted.items():
            out = out & F.coalesce(F.try_variant_get(item, f"$.{field}", kinds[type(v)]) == F.lit(v), F.lit(False))
        return out

    return holds


def inventory(documents: DataFrame, document: str, counts: Mapping[str, tuple[str, Mapping[str, Any]]], values: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """``documents`` with, per entry of ``counts``, the items of the array at a path whose fields have the wanted values.

    ``values`` (name: path and type) reads single values. Documents need no
    schema: a path that is missing counts 0, a value of another type is null. A
    text that is no JSON has ``malformed`` true and nulls.
    """
    parsed = documents.withColumn("__v", F.try_parse_json(document)).withColumn("malformed", F.col(document).isNotNull() & F.col("__v").isNull())
    made = {}
    for name, (path, wanted) in counts.items():
        items = F.coalesce(F.try_variant_get("__v", path, "array<variant>"), F.array().cast("array<variant>"))
        made[name] = F.when(F.col("__v").isNotNull(), F.size(F.filter(items, _matching(wanted))).cast("long"))
    for name, (path, kind) in (values or {}).items():
        made[name] = F.try_variant_get("__v", path, kind)
    return parsed.withColumns(made).drop("__v")


def items(documents: DataFrame, keep: Sequence[str], document: str, path: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(keep, at, fields): a row per item of the array at a path, its fields by name (path in the item, type); malformed documents have none."""
    listed = documents.select(*keep, F.try_variant_get(F.try_parse_json(document), path, "array<variant>").alias("__i"))
    rows = listed.select(*keep, F.posexplode("__i").alias("at", "__x"))
    return rows.select(*keep, "at", *[F.try_variant_get("__x", p, kind).alias(n) for n, (p, kind) in fields.items()])


def evidence(documents: DataFrame, keys: Sequence[str], document: str, path: str, identity: Mapping[str, tuple[str, str]], tests: Mapping[str, tuple[str, str, Any]]) -> DataFrame:
    """Per group: documents, malformed ones, items at a path, distinct identities among them, and how many items pass each test (path, type, value)."""
    own = documents.withColumn("__v", F.try_parse_json(document))
    whole = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col(document).isNotNull() & F.col("__v").isNull()).alias("malformed"))
    fields = {f"__i{i}": f for i, f in enumerate(identity.values())} | {f"__t{i}": (p, kind) for i, (p, kind, _) in enumerate(tests.values())}
    rows = items(documents, keys, document, path, fields)
    who = F.struct(*[F.col(f"__i{i}") for i in range(len(identity))])
    known = F.lit(True)
    for i in range(len(identity)):
        known = known & F.col(f"__i{i}").isNotNull()
    passed = [F.count_if(F.col(f"__t{i}") == F.lit(value)).alias(name) for i, (name, (_, _, value)) in enumerate(tests.items())]
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.count_distinct(F.when(known, who)).alias("identities"), *passed)
    joined = whole.withColumn("__k", F.struct(*keys)).join(found.select(F.struct(*keys).alias("__k"), "items", "identities", *tests), "__k", "left")
    return joined.select(*keys, "documents", "malformed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "identities", *tests)])
