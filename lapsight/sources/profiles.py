"""Profiles that extend others: the order in which they apply, and the settings they give."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leaves of a resolved document that are brought to the driver.
MOST_LEAVES = 100_000

PROFILES = "id string, scope string, extends array<string>, config string"


def is_complete(node: Mapping[str, Any]) -> bool:
    """Whether a table is a whole quantity or choice, which is one value: a later one replaces it whole."""
    described = all(k in node for k in ("nominal", "source", "uncertainty"))
    return described and ("unit" in node or isinstance(node["nominal"], str))


def application_order(profiles: DataFrame, requested: Sequence[str], scope: str) -> tuple[DataFrame, DataFrame]:
    """Profiles in the order they apply (layer_order, id), and the problems (problem, id, trail).

    Each profile applies after all that it extends, in their order and depth
    first, and once only. A profile that is not there, has another scope (but
    ``mixed``) or extends itself through others is a problem; it is passed over
    there, with what it extends. A profile id that is defined twice is a
    problem too, and its first definition (in order of its text) counts. The
    walk is a recursive query, as deep as Spark's limit of recursion.
    """
    spark = profiles.sparkSession
    w = Window.partitionBy("id")
    named = profiles.select("id", "scope", F.coalesce("extends", F.array().cast("array<string>")).alias("extends"), "config")
    counted = named.withColumn("i", F.row_number().over(w.orderBy("config", F.to_json("extends"), "scope"))).withColumn("n", F.count(F.lit(1)).over(w))
    known = counted.where("i = 1").select("id", "scope", "extends", F.lit(True).alias("there"))
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(requested)], "place int, id string")
    walk = spark.sql(
        """
WITH RECURSIVE walk(id, place, trail, problem, extends) AS (
    SELECT a.id, array(a.place), array(a.id),
           CASE WHEN p.there IS NULL THEN 'not_found' WHEN p.scope NOT IN (:scope, 'mixed') OR p.scope IS NULL THEN 'scope_mismatch' END, p.extends
    FROM {asked} a LEFT JOIN {known} p ON p.id = a.id
    UNION ALL
    SELECT s.parent, concat(s.place, array(s.at)), concat(s.trail, array(s.parent)),
           CASE WHEN p.there IS NULL THEN 'not_found' WHEN array_contains(s.trail, s.parent) THEN 'cycle' WHEN p.scope NOT IN (:scope, 'mixed') OR p.scope IS NULL THEN 'scope_mismatch' END, p.extends
    FROM (SELECT place, trail, posexplode(extends) AS (at, parent) FROM walk WHERE problem IS NULL) s LEFT JOIN {known} p ON p.id = s.parent
)
SELECT id, place, trail, problem FROM walk""",
        args={"scope": scope}, asked=asked, known=known,
    )
    done = F.concat("place", F.array(F.lit(2**31 - 1)))  # after all that lies below
    first = walk.where("problem IS NULL").groupBy("id").agg(F.min(done).alias("done"))
    order = first.select((F.row_number().over(Window.orderBy("done")) - 1).alias("layer_order"), "id")  # a row per profile that applies
    twice = counted.where("i = 1 AND n > 1").select(F.lit("defined_twice").alias("problem"), "id", F.array("id").alias("trail"))
    problems = walk.where("problem IS NOT NULL").groupBy("problem", "id").agg(F.min_by("trail", "place").alias("trail"))
    return order, problems.unionByName(twice)


def leaves(documents: DataFrame, keep: Sequence[str], document: str = "config") -> DataFrame:
    """(keep, path array, value JSON, whole array): the leaves of JSON objects; ``whole`` is the path of the quantity or choice that holds a leaf.

    Arrays are leaves. An object without entries has none, and a document that
    is no object is an error.
    """

    def of(node: Mapping[str, Any], path: tuple[str, ...], whole: tuple[str, ...] | None) -> Iterator[tuple]:
        if whole is None and path and is_complete(node):
            whole = path
        for k, v in node.items():
            if isinstance(v, Mapping):
                yield from of(v, (*path, k), whole)
            else:
                yield list((*path, k)), json.dumps(v, sort_keys=True), None if whole is None else list(whole)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, text in zip(batch[list(keep)].itertuples(index=False, name=None), batch[document], strict=True):
                found = json.loads(text) if text else {}
                if not isinstance(found, Mapping):
                    raise ValueError("a configuration is a JSON object")
                rows += [(*own, *leaf) for leaf in of(found, (), None)]
            yield pd.DataFrame(rows, columns=[*keep, "path", "value", "whole"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, document).mapInPandas(run, f"{kinds}, path array<string>, value string, whole array<string>")


def merged(layers: DataFrame, order: str = "layer_order", name: str = "id") -> DataFrame:
    """(path, value, provenance) after all layers of leaves(): tables merge, everything else replaces.

    A later leaf replaces the same leaf, a table in its place or a value above
    it; a later quantity or choice that is complete replaces all of an earlier
    one. Each leaf of each layer looks its path and the paths above it up among
    what later layers set, which is a join by path. ``provenance`` has the
    layers that set the leaf since it was last removed, in order.
    """
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))
    table = F.transform(F.filter(above, lambda q: F.size(q) < F.size("path")), lambda q: F.struct(q.alias("at"), F.lit("table").alias("kind")))
    own = F.array(F.struct(F.col("path").alias("at"), F.lit("leaf").alias("kind")))
    whole = F.when(F.col("whole").isNotNull(), F.array(F.struct(F.col("whole").alias("at"), F.lit("whole").alias("kind")))).otherwise(F.array().cast("array<struct<at:array<string>,kind:string>>"))
    marks = layers.select(F.col(order).alias("later"), F.inline(F.concat(own, table, whole))).distinct()
    looked = layers.select(order, name, "path", "value", F.explode(above).alias("at")).join(marks, "at")
    here, later = F.col("at") == F.col("path"), F.col("later") > F.col(order)
    cut = later & ((~here & (F.col("kind") == "leaf")) | (here & (F.col("kind") == "table")))
    replaced = later & (F.col("kind") == "whole")
    again = later & here & (F.col("kind") == "leaf")
    steps = looked.groupBy(order, name, "path", "value").agg(
        F.max(F.coalesce(cut, F.lit(False))).alias("cut"),
        F.min(F.when(replaced, F.col("later"))).alias("replaced"),
        F.collect_set(F.when(again, F.col("later"))).alias("again"),
    )
    kept = steps.where(~F.col("cut") & (F.col("replaced").isNull() | F.array_contains("again", F.col("replaced"))))
    step = F.struct(F.col(order).alias("order"), F.col(name).alias("layer"), F.col("value").alias("value"))
    return kept.groupBy("path").agg(F.max_by("value", order).alias("value"), F.array_sort(F.collect_list(step)).alias("provenance"))


def resolve(profiles: DataFrame, requested: Sequence[str], scope: str) -> tuple[DataFrame, DataFrame]:
    """merged() settings of the requested profiles and the problems of application_order()."""
    order, problems = application_order(profiles, requested, scope)
    w = Window.partitionBy("id").orderBy("config", F.to_json("extends"), "scope")
    first = profiles.withColumn("extends", F.coalesce("extends", F.array().cast("array<string>"))).withColumn("__i", F.row_number().over(w)).where("__i = 1")
    layers = leaves(order.join(first.select("id", "config"), "id"), ["layer_order", "id"])
    return merged(layers), problems


def set_path(document: dict[str, Any], path: Sequence[str], value: Any) -> None:
    """Set a value in nested tables, making those that are missing; a value in the way is replaced by a table."""
    for k in path[:-1]:
        if not isinstance(document.get(k), dict):
            document[k] = {}
        document = document[k]
    document[path[-1]] = value


def get_path(document: Mapping[str, Any], path: str, default: Any = None) -> Any:
    """The value at a dotted path, or ``default`` where a part is missing."""
    found: Any = document
    for k in path.split("."):
        if not isinstance(found, Mapping) or k not in found:
            return default
        found = found[k]
    return found


def document_of(settings: DataFrame) -> dict[str, Any]:
    """The nested document of merged() settings, MOST_LEAVES at most."""
    rows = settings.select("path", "value").limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} settings")
    out: dict[str, Any] = {}
    for r in rows:
        set_path(out, r["path"], json.loads(r["value"]))
    return out
