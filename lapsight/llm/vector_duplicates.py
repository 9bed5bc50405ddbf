"""Near copies among vectors: p-stable hashing of normalised vectors, then exact cosines.

Vectors that are equal in label and entries are one class. A class's normalised
vector is projected on Gaussian directions, shifted by a uniform offset and cut
into cells of WIDTH; a table's bucket is the cells of several directions. Two
unit vectors of cosine c are sqrt(2 - 2c) apart, so the chance to share a cell
is known: the number of directions is the least with which one class meets less
than one unrelated one (at a right angle) of the largest label in a table, and
the number of tables gives pairs at the threshold the target recall.

Classes of a bucket are compared by their cosines, all with all, inside tasks; a
bucket of more than BLOCK classes is dealt out in pairs of blocks. A pair counts
in the first table where it meets only, so links add up exactly, and a block
hands on each class's number of links and one way to its group's first class,
never its pairs. Work on a bucket grows with the square of its different
vectors; copies cost nothing.

Vectors that are null, zero or hold null or non-finite entries, and rows without
a label, link with nothing; neither do vectors of different lengths. Every row
has its own row in the result, repeated ones too. A null id is no component_id
where the component has another; a row is kept if its id is its component's, so
rows with a null id are kept only where no other id is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsight.llm.linked import components
from lapsight.llm.staging import drop, shuffles_removed, spread_join, stage

THRESHOLD = 0.93
RECALL = 0.999
WIDTH = 2.0
BLOCK = 512
SEED = 20
#: Rows that a task compares at a time, but for a larger bucket.
ROWS = 4096


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The chance that a projection puts two points so far apart into one cell."""
    r = width / max(distance, 1e-12)
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_and_directions(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Number of tables and directions of a table, for the classes of the largest label."""
    near, far = same_cell(math.sqrt(max(0.0, 2 - 2 * threshold))), same_cell(math.sqrt(2))
    directions = max(4, math.ceil(math.log(max(2, largest)) / -math.log(far)))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**directions)))), directions


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class _Tables:
    """Random directions and offsets for vectors of one length, the same in each task."""

    def __init__(self, length: int, tables: int, directions: int) -> None:
        r = np.random.default_rng([SEED, length, tables, directions])
        self.ways = r.normal(size=(length, tables * directions))
        self.offsets = r.uniform(0, WIDTH, tables * directions)
        self.mix = r.integers(1, 1 << 63, directions, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = r.integers(1, 1 << 63, dtype=np.uint64)
        self.tables, self.directions = tables, directions

    def buckets(self, units: np.ndarray) -> np.ndarray:
        """A number of 32 bits per vector and table."""
        cells = np.floor((units @ self.ways + self.offsets) / WIDTH).astype(np.int64).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (cells.reshape(len(units), self.tables, self.directions) * self.mix).sum(axis=2, dtype=np.uint64) + self.salt
            mixed = (mixed ^ (mixed >> np.uint64(31))) * self.mix[0]
        return (mixed >> np.uint64(32)).astype("<u4")


def _vectors(rows: DataFrame, vector: str, keep: list[str], dtype: str) -> DataFrame:
    """``keep``, ``__vector`` as bytes and ``__key``, a hash of them and of the label; null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, labels = batch.column(len(keep)), batch.column(len(keep) + 1).to_pylist()
            flat = column.values.to_numpy(zero_copy_only=False).astype(dtype)
            at, none = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            own = [None if none[i] else flat[at[i] : at[i + 1]].tobytes() for i in range(len(column))]
            keys = [None if v is None else hashlib.sha256(v + b"\0" + label.encode()).digest() for v, label in zip(own, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(own, pa.binary()), pa.array(keys, pa.binary())], names=[*keep, "__vector", "__key"])

    v, infinite = F.col(vector), float("inf")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != infinite)) & F.exists(v, lambda c: c != 0)
    usable = F.when(F.col("__label").isNotNull() & F.coalesce(fine, F.lit(False)), v)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("__vector", T.BinaryType()), T.StructField("__key", T.BinaryType())])
    return rows.select(*keep, usable.alias("__v"), F.col("__label").cast("string").alias("__l")).mapInArrow(run, schema)


def _with_buckets(classes: DataFrame, tables: int, directions: int, dtype: str) -> DataFrame:
    """``classes`` with ``buckets``, four bytes for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, _Tables] = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            out = [b""] * len(column)
            sizes = np.array([len(v) for v in column])
            for size in np.unique(sizes):
                length = int(size) // np.dtype(dtype).itemsize
                use = made.setdefault(length, _Tables(length, tables, directions))
                which = np.flatnonzero(sizes == size)
                for i in range(0, len(which), 256):
                    some = which[i : i + 256]
                    found = use.buckets(unit(np.stack([np.frombuffer(column[j], dtype) for j in some])))
                    for j, row in zip(some, found, strict=True):
                        out[j] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "buckets"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("buckets", T.BinaryType())]))


def _found(first: np.ndarray, second: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row with a link: its class, the class its group of links leads to, and how many vectors it links with."""
    n = len(ids)
    links = np.bincount(first, sizes[second], n) + np.bincount(second, sizes[first], n)
    lead = np.arange(n)
    while True:
        before = lead.copy()
        np.minimum.at(lead, first, lead[second])
        np.minimum.at(lead, second, lead[first])
        lead = np.minimum(lead, lead[lead])
        if (lead == before).all():
            break
    has = np.flatnonzero(links)
    return ids[has], ids[lead[has]], links[has].astype(np.int64)


def _compare(rows: dict[str, np.ndarray], threshold: float, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links of whole groups of rows, which are in order of ``group``; groups of equal size are compared together."""
    starts = np.flatnonzero(np.concatenate([[True], rows["group"][1:] != rows["group"][:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(rows["group"])]]))
    first, second = [], []
    for size in np.unique(sizes[sizes > 1]):
        of = starts[sizes == size]
        step = max(1, ROWS // int(size))
        for i in range(0, len(of), step):
            at = of[i : i + step, None] + np.arange(size)
            lengths = np.array([len(v) for v in rows["vector"][at.ravel()]]).reshape(at.shape)
            kinds = np.unique(lengths)
            blocks = [at[(lengths == k).all(axis=1)] for k in kinds]  # one length to a group, as lengths are in its hash
            for block in blocks:
                u = unit(np.stack([np.frombuffer(v, dtype) for v in rows["vector"][block.ravel()]])).reshape(*block.shape, -1)
                g, a, b = np.nonzero(np.triu(u @ u.transpose(0, 2, 1) >= threshold, 1))
                first.append(block[g, a])
                second.append(block[g, b])
    if not first:
        return None
    a, b = np.concatenate(first), np.concatenate(second)
    same = (rows["label"][a] == rows["label"][b]) & ((rows["crossed"][a] == 0) | (rows["own"][a] != rows["own"][b]))
    a, b = a[same], b[same]
    if len(a):
        keep = []
        for i in range(0, len(a), 1 << 16):  # the first table where the two meet must be this one
            x, y = (np.stack([np.frombuffer(v, "<u4") for v in rows["buckets"][c[i : i + (1 << 16)]]]) for c in (a, b))
            meet = (x == y).argmax(axis=1)
            keep.append((meet == rows["at"][a[i : i + (1 << 16)]]) & (meet == rows["at"][b[i : i + (1 << 16)]]))
        keep = np.concatenate(keep)
        a, b = a[keep], b[keep]
    return _found(a, b, rows["class"], rows["size"]) if len(a) else None


def links(classes: DataFrame, tables: int, threshold: float, dtype: str) -> DataFrame:
    """(class, lead, links) for each block of a bucket where a class has links; ``classes`` is a table of _with_buckets()."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("at"), F.substring(F.col("buckets"), 4 * t + 1, F.lit(4)).alias("cell")))
    light = classes.select("class", "label", F.length("vector").alias("bytes"), F.inline(cells))
    light = light.select("class", "at", F.xxhash64("label", "bytes", "at", "cell").alias("bucket"))
    shared = stage(light.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "vector-buckets")
    # both sides of this join are plain shuffles, so Spark splits the rows of a large bucket
    met = light.join(shared, "bucket").join(classes.select("class", "label", "size", "vector", "buckets"), "class")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    group = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    met = met.select(group.alias("group"), "class", "at", "own", (F.col("own") != F.col("other")).cast("int").alias("crossed"), "label", "size", "vector", "buckets")
    names = met.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def flush(table: pa.Table):
            rows = {c: table.column(c).to_numpy() for c in names}
            found = _compare(rows, threshold, dtype)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["class", "lead", "links"])

        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in waiting) >= ROWS:
                table = pa.concat_tables(waiting)
                of = table.column("group").to_numpy()
                whole = int(np.searchsorted(of, of[-1]))  # the last group may go on
                if whole:
                    yield from flush(table.slice(0, whole))
                waiting = [table.slice(whole)]
        if waiting:
            table = pa.concat_tables(waiting)
            if table.num_rows:
                yield from flush(table)

    dealt = met.repartition("group").sortWithinPartitions("group")
    out = stage(dealt.mapInArrow(run, "class long, lead long, links long"), "vector-links")
    drop(shared)
    return out


def vector_duplicates(rows: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row, linked within labels at a cosine of ``threshold`` or more."""
    spark = rows.sparkSession
    dtype = "<f4" if rows.schema[vector].dataType.elementType == T.FloatType() else "<f8"
    own = rows.select(F.col(vec_id).alias("__id"), F.col(label).alias("__label"), F.col(vector).cast("array<float>" if dtype == "<f4" else "array<double>").alias("__v"))
    read = stage(_vectors(own, "__v", ["__id", "__label"], dtype), "vectors")
    same = read.where("__key is not null").groupBy("__key").agg(
        F.first("__label").alias("label"), F.first("__vector").alias("vector"), F.count(F.lit(1)).alias("size"), F.min("__id").alias("least")
    )
    plain = stage(same.withColumn("class", F.monotonically_increasing_id()), "vector-classes")  # numbered where it is written, so only once
    largest = plain.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tables, directions = tables_and_directions(largest, threshold, recall)
    classes = stage(_with_buckets(plain.select("class", F.col("label").cast("string").alias("label"), "size", "vector"), tables, directions, dtype), "vector-tables")
    found = links(classes, tables, threshold, dtype)
    drop(classes)
    labels = components(found.where("class != lead").select(F.col("class").alias("a"), F.col("lead").alias("b")))
    leasts = labels.select(F.col("key").alias("class"), F.col("label").alias("root")).join(plain.select("class", "least"), "class")
    leasts = leasts.groupBy("root").agg(F.min("least").alias("component"))
    named = spread_join(labels.select(F.col("key").alias("class"), F.col("label").alias("root")), leasts, "root", F.col("class")).drop("root")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    result = plain.select("__key", "class", "size", "least").join(counts, "class", "left").join(named, "class", "left")
    result = result.select(
        "__key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id")
    )
    result = stage(result, "vector-result")
    drop(found, labels, plain)
    out = spread_join(read.select("__id", "__key"), result, "__key", F.coalesce(F.col("__id").cast("string"), F.lit("")), "left")
    component = F.when(F.col("__key").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    with shuffles_removed(spark):
        return out.select(
            F.col("__id").alias(vec_id), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept")
        )


def op13_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
    SELECT r, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
        AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
    SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reached(a, b) AS (
    SELECT r, r FROM v UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
), smallest AS (SELECT reached.a, min(v.vec_id) AS component_id FROM reached JOIN v ON v.r = reached.b GROUP BY reached.a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN smallest ON smallest.a = v.r LEFT JOIN counts ON counts.a = v.r
"""
