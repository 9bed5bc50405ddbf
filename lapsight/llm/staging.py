"""Tables written between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark 4.1: remove a query's shuffle files as soon as the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SPARK = {
    pa.int32(): T.IntegerType(),
    pa.int64(): T.LongType(),
    pa.float64(): T.DoubleType(),
    pa.bool_(): T.BooleanType(),
    pa.string(): T.StringType(),
    pa.binary(): T.BinaryType(),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one, but only if driver and executors are
    one process; on a cluster others could not see it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lapsight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, queries remove their shuffle files when they end, and hand rows to Python in small batches."""
    own = {CLEAN_SHUFFLES: "true", BATCH_ROWS: "1000"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        pass


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with the writer's ``options``, and read it again.

    This cuts the lineage: a lost executor costs only the tasks since the last
    table, and the written rows are never computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of stage() whose last reader has written its rows."""
    for table in tables:
        _remove(table.sparkSession, table.staged_at)


def group_key(column: Column) -> Column:
    """A join key of a nullable string: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_join(rows: DataFrame, found: DataFrame, key: str, by: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` joined to ``found`` (one row per ``key``) where a key may hold a third of the rows.

    Rows are dealt by key and salt, from the hash of ``by``; ``found`` is first
    joined to the distinct pairs of key and salt, at most ``salts`` of a key.
    """
    salt = fresh("salt", rows, found)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    spread = salted.select(key, salt).distinct().join(found, key)
    return salted.join(spread, [key, salt], how).drop(salt)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_slices(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of up to ``most_bytes`` bytes (or list items), or one larger row."""
    length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    upto = np.cumsum(pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(upto):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + most_bytes, side="right")))
        yield first, last - first
        first = last


def map_rows(
    docs: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    outputs: Mapping[str, pa.DataType],
    start: Callable[[], Callable[..., Sequence]],
    most_bytes: int = 2 << 20,
) -> DataFrame:
    """Columns of ``keep`` as they are, and ``outputs`` computed from ``inputs``, batch by batch.

    ``start`` is called once per task and gives a function from lists of the
    inputs' values to lists or arrays of the outputs'. The first input is a
    text or list; it sees rows of up to ``most_bytes`` bytes or items of it at
    a time, or one larger row. Kept columns stay in Arrow, so nulls and large integers are safe.
    """
    names = [*keep, *outputs]
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            for first, n in byte_slices(batch.column(kept), most_bytes):
                part = batch.slice(first, n)
                made = compute(*(c.to_pylist() for c in part.columns[kept:]))
                arrays = [pa.array(x, type=t) for x, t in zip(made, outputs.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *arrays], names=names)

    rows = docs.select(*[F.col(c) for c in keep], *[c.alias(f"__in_{i}") for i, c in enumerate(inputs)])
    made = [T.StructField(n, _SPARK[t] if t in _SPARK else T.ArrayType(_SPARK[t.value_type])) for n, t in outputs.items()]
    schema = T.StructType([*rows.schema.fields[:kept], *made])
    return rows.mapInArrow(run, schema)
