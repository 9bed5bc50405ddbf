"""Result folders: manifests, tables, fingerprints, and writing that can be resumed."""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file under an explicit schema; no rows where the path does not exist."""
    try:
        return spark.read.schema(schema).option("header", "true").csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def discover(spark: SparkSession, root: str, schema: str, pattern: str = "manifest.json") -> DataFrame:
    """Manifests below ``root``, newest first, without unfinished folders."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", "true")
    found = reader.json(root).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    return found.where(~F.col("path").contains(".incomplete")).orderBy(F.desc("modified"), "path")


def latest(found: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("modified"), F.desc("path"))
    return found.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def toml_rows(spark: SparkSession, text: str) -> DataFrame:
    """Leaves of a TOML document as (path, value as JSON); configuration is small and read on the driver."""

    def leaves(node: Any, path: str) -> Iterable[tuple[str, str]]:
        if isinstance(node, Mapping):
            for k, v in node.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        else:
            yield path, json.dumps(node, default=str)

    return spark.createDataFrame(list(leaves(tomllib.loads(text), "")), "path string, value string")


def merge_layers(layers: DataFrame, path: str = "path", order: str = "layer_order") -> DataFrame:
    """Per leaf path, the value of the last layer that sets it, and the layers in order."""
    step = F.struct(F.col(order).alias("order"), F.col("layer").alias("layer"), F.col("value").alias("value"))
    return layers.groupBy(path).agg(F.max_by("value", order).alias("value"), F.array_sort(F.collect_list(step)).alias("provenance"))


def fingerprint(document: Mapping[str, Any], fields: Iterable[str]) -> str:
    """SHA-256 of the named fields in canonical JSON."""
    chosen = {f: document[f] for f in sorted(fields)}
    return hashlib.sha256(json.dumps(chosen, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def row_fingerprint(rows: DataFrame, columns: list[str], to: str = "fingerprint") -> DataFrame:
    return rows.withColumn(to, F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def unfinished(cases: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Cases that a resumed run still has to do."""
    return cases.join(finished.select(*keys).distinct(), keys, "left_anti")


def flatten(rows: DataFrame, separator: str = ".") -> DataFrame:
    """Structs as columns of their own, all the way down."""

    def leaves(schema: T.StructType, prefix: str = "") -> Iterable[str]:
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, f"{name}.")
            else:
                yield name

    return rows.select(*[F.col(n).alias(n.replace(".", separator if separator != "." else "_")) for n in leaves(rows.schema)])


def _toml_text(text: str) -> str:
    return json.dumps(text, ensure_ascii=False).replace("\x7f", "\\u007f")


def _toml_value(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return "nan" if value != value else ("inf" if value > 0 else "-inf") if value in (float("inf"), float("-inf")) else repr(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return _toml_text(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, Mapping):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(_toml_value, value)) + "]"
    raise TypeError(f"TOML has no value for {type(value).__name__}")


def _toml_key(key: str) -> str:
    return key if key and all(c.isascii() and (c.isalnum() or c in "-_") for c in key) else _toml_text(key)


def toml_text(document: Mapping[str, Any]) -> str:
    """A TOML document: values of a table first, then its tables; tables within arrays are written inline. None is an error."""
    out: list[str] = []

    def table(node: Mapping[str, Any], path: tuple[str, ...]) -> None:
        plain = {k: v for k, v in node.items() if not isinstance(v, Mapping)}
        if path and (plain or not node):
            out.append(f"[{'.'.join(map(_toml_key, path))}]")
        out.extend(f"{_toml_key(k)} = {_toml_value(v)}" for k, v in plain.items())
        for k, v in node.items():
            if isinstance(v, Mapping):
                table(v, (*path, k))

    table(document, ())
    return "\n".join(out) + "\n"
