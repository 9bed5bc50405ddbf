"""Tables written between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a temporary one, if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lapsight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again.

    Plans that name it several times read its rows instead of computing them,
    all readers see the same rows, and a lost executor costs the tasks since
    then only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    remove = partial(_remove, spark, path)
    atexit.register(remove)
    out = spark.read.schema(df.schema).parquet(path)
    out.removed_by = remove
    return out


#: Rows of a task that orders or joins them.
ROWS = 500_000


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as they need, where the session's number is too small for them.

    So a task's memory does not grow with the input. The rows are counted,
    which costs a table's files next to nothing.
    """
    tasks = 1 + rows.count() // ROWS
    return rows if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(tasks, *keys)


def drop(*tables: DataFrame) -> None:
    """Remove tables of stage() that no plan reads any more."""
    for table in tables:
        table.removed_by()
        atexit.unregister(table.removed_by)
