"""Cases that ask how far a result depends on its data and settings, run one by one; a case that fails is a row."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

CASES = "case_id string, category string, excluded array<string>, overrides map<string,string>"
STATUS = "case_id string, category string, fingerprint string, success boolean, error string, folder string"

#: Kinds of change: how a nominal setting and an amount give the case's setting.
CHANGES: dict[str, Callable[[float, float], float]] = {"set": lambda v, a: a, "times": lambda v, a: v * a, "plus": lambda v, a: v + a}


def leave_out_cases(runs: DataFrame, run: str, groups: Sequence[str], needed: Sequence[str] = ()) -> DataFrame:
    """A case for each run, and for each value of ``groups`` where there are several, that leaves out its runs.

    Only cases are kept that leave a run, and for each boolean column of
    ``needed`` one where it is true. Null groups are left out of none.
    """
    uses = [F.count_if(F.col(c)).alias(f"__{i}") for i, c in enumerate(needed)]
    totals = runs.agg(F.count_distinct(run).alias("__runs"), *uses)
    out = None
    for kind in [run, *groups]:
        own = runs.where(F.col(kind).isNotNull()).groupBy(F.col(kind).cast("string").alias("__value"))
        own = own.agg(F.array_sort(F.collect_set(F.col(run).cast("string"))).alias("excluded"), *[u.alias(f"__own{i}") for i, u in enumerate(uses)])  # a group's runs are declared, not measured
        several = runs.agg(F.count_distinct(kind).alias("__kinds"))
        left = own.join(F.broadcast(totals)).join(F.broadcast(several)).where((F.size("excluded") < F.col("__runs")) & (F.col("__kinds") > 1))  # one row each
        for i in range(len(needed)):
            left = left.where(F.col(f"__{i}") > F.col(f"__own{i}"))
        some = left.select(
            F.concat(F.lit(f"leave_out_{kind}__"), "__value").alias("case_id"),
            F.lit("data_support").alias("category"),
            "excluded",
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("overrides"),
        )
        out = some if out is None else out.unionByName(some)
    return out


def setting_cases(spark: SparkSession, nominal: Mapping[str, float], changes: Iterable[tuple[str, str, str, str, float, float | None, float | None]]) -> DataFrame:
    """Cases from rows (case, category, setting, kind of change, amount, least, most); rows of one case are one case.

    A setting that is not in ``nominal`` is an error.
    """
    found: dict[tuple[str, str], dict[str, str]] = {}
    for case, category, setting, kind, amount, least, most in changes:
        if setting not in nominal:
            raise KeyError(f"case {case}: no setting {setting}")
        value = CHANGES[kind](nominal[setting], amount)
        value = value if least is None else max(least, value)
        value = value if most is None else min(most, value)
        found.setdefault((case, category), {})[setting] = json.dumps(int(value) if isinstance(nominal[setting], int) and float(value).is_integer() else value)
    return spark.createDataFrame([(case, category, [], overrides) for (case, category), overrides in found.items()], CASES)


def limited(cases: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` cases by category and name; two cases of one name are an error."""
    named = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("category", "excluded", "overrides")])
    once = named.withColumn("case_id", F.when(F.col("n") == 1, F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("two cases are named "), "case_id"))))
    return once.drop("n").orderBy("category", "case_id").limit(most)


def _written(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(STATUS).option("recursiveFileLookup", "true").json(f"{root}/status")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], STATUS)


def run_cases(cases: DataFrame, root: str, compute: Callable[[Row], DataFrame], most: int = 40, workers: int = 1, version: str = "1") -> DataFrame:
    """A status row per case; its result, if any, is written below ``root``.

    ``compute`` gives the case's result as a DataFrame, so the work of a case is
    Spark's; the list of cases, ``most`` at most, is the driver's. An error in
    planning or running a case becomes its row's ``error`` and stops no other.
    A case whose definition, and ``version`` of the computation, has a
    successful row below ``root`` is not computed again; failed ones are.
    """
    spark = cases.sparkSession
    columns = F.to_json(F.struct(F.lit(version), "case_id", "category", F.array_sort("excluded"), F.array_sort(F.map_entries("overrides"))))
    todo = limited(cases, most).withColumn("fingerprint", F.sha2(columns, 256))
    done = _written(spark, root).where("success").select("fingerprint").distinct()
    left = todo.join(done, "fingerprint", "left_anti").orderBy("category", "case_id").collect()

    def one(case: Row) -> None:
        folder = f"results/{case['fingerprint'][:32]}"
        try:
            compute(case).write.mode("overwrite").parquet(f"{root}/{folder}")
            row = (case["case_id"], case["category"], case["fingerprint"], True, None, folder)
        except Exception as error:  # the failure of a case is a result
            text = str(error).strip().splitlines()
            row = (case["case_id"], case["category"], case["fingerprint"], False, f"{type(error).__name__}: {text[0] if text else ''}"[:500], None)
        spark.createDataFrame([row], STATUS).coalesce(1).write.json(f"{root}/status/{uuid.uuid4().hex}")  # writers of one folder would remove each other's drafts

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(one, left))
    known = _written(spark, root)
    best = known.groupBy("fingerprint").agg(F.max_by(F.struct("success", "error", "folder"), F.struct(F.col("success"), F.col("error"))).alias("s"))
    return todo.join(best, "fingerprint", "left").select("case_id", "category", "excluded", "overrides", "fingerprint", "s.*")


def case_results(status: DataFrame, root: str) -> DataFrame:
    """The results of all successful cases, with case_id and category; those of failed ones have no rows."""
    spark = status.sparkSession
    rows = status.where("success").select("case_id", "category", "folder").collect()  # a row per case
    if not rows:
        raise LookupError("no case has succeeded")
    out = None
    for r in rows:
        one = spark.read.parquet(f"{root}/{r['folder']}").select(F.lit(r["case_id"]).alias("case_id"), F.lit(r["category"]).alias("category"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def setting(case: Row, name: str, nominal: Any) -> Any:
    """The case's own value of a setting, or the nominal one."""
    return json.loads(case["overrides"][name]) if name in case["overrides"] else nominal
