"""Sets, roles, neighbours and rules between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Centres that one row holds.
CENTRES_AT_ONCE = 4096


def has_all(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with a row for every distinct member (relational division)."""
    every = F.broadcast(rows.agg(F.count_distinct(member).alias("__all")))  # one row
    own = rows.groupBy(key).agg(F.count_distinct(member).alias("members"))
    return own.join(every).where("members = __all").select(key, "members")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def roles(rows: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Per key, the rows with the least, middle (position n // 2) and greatest value, ties by ``tie``."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__i", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    named = F.filter(
        F.array(
            F.when(F.col("__i") == 0, F.lit("least")),
            F.when(F.col("__i") == F.floor(F.col("__n") / 2), F.lit("middle")),
            F.when(F.col("__i") == F.col("__n") - 1, F.lit("greatest")),
        ),
        lambda x: x.isNotNull(),
    )
    return ranked.select(*keys, F.explode(named).alias("role"), tie, value)


def neighbours_around(rows: DataFrame, keys: Sequence[str], at: str, item: str, length: float) -> DataFrame:
    """Each row with the next one on a closed axis and the gap to it; the last row's next is the first, one length on."""
    w = Window.partitionBy(*keys).orderBy(at, item)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead(at).over(w), F.first(at).over(whole) + length)
    return rows.select(
        *keys, item, at, F.coalesce(F.lead(item).over(w), F.first(item).over(whole)).alias("next_item"), (following - F.col(at)).alias("gap")
    )


def outer_with_missing(left: DataFrame, right: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Full outer join on ``key``; the named text columns say 'missing' where their side has no row."""
    joined = left.join(right, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(c), F.lit("missing")).alias(n) for n, c in columns.items()])


def nearest_centre(vectors: DataFrame, key: str, vector: str, centres: DataFrame, centre_id: str, centre: str) -> DataFrame:
    """Per vector, the nearest centre by squared distance, the smaller id on ties.

    Up to CENTRES_AT_ONCE centres are one broadcast row, and each vector finds
    its nearest without a shuffle. More are dealt to blocks of that size; a
    vector then meets each block as one row, and the best of them are compared.
    """
    n = centres.count()
    blocks = max(1, -(-n // CENTRES_AT_ONCE))
    dealt = centres.select(F.struct(F.col(centre_id).alias("id"), F.col(centre).alias("c")).alias("x"), F.pmod(F.xxhash64(centre_id), F.lit(blocks)).alias("block"))
    lists = dealt.groupBy("block").agg(F.collect_list("x").alias("centres"))
    square = lambda v, c: F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("centres", lambda x: F.struct(square(F.col("v"), x["c"]).alias("d"), x["id"].alias("id"))))
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    if blocks == 1:
        found = rows.join(F.broadcast(lists.drop("block"))).select(F.col("k").alias(key), best.alias("b"))  # one row of bounded size
    else:
        every = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(lists, "block")
        found = every.select(F.col("k").alias(key), best.alias("b")).groupBy(key).agg(F.min("b").alias("b"))
    return found.select(key, F.col("b.id").alias("nearest"), F.col("b.d").alias("distance"))


def mean_vectors(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, one place at a time so that sums are taken before the shuffle."""
    parts = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(label, F.transform("p", lambda q: q["x"]).alias("centre"))


class Rules:
    """Violations of named rules, as rows (code, severity, path, message)."""

    def __init__(self) -> None:
        self.found: list[DataFrame] = []

    def _add(self, bad: DataFrame, code: str, severity: str, path: str, key: str, message: str) -> None:
        self.found.append(
            bad.select(
                F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat(F.lit(f"{path}/"), F.col(key).cast("string")).alias("path"), F.lit(message).alias("message")
            )
        )

    def not_null(self, rows: DataFrame, path: str, key: str, column: str, severity: str = "error") -> Rules:
        self._add(rows.where(F.col(column).isNull()), f"{column}_missing", severity, path, key, f"{column} is required")
        return self

    def unique(self, rows: DataFrame, path: str, key: str, severity: str = "error") -> Rules:
        twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        self._add(twice, f"{key}_repeated", severity, path, key, f"{key} must be unique")
        return self

    def refers_to(self, rows: DataFrame, path: str, key: str, column: str, parents: DataFrame, parent: str, severity: str = "error") -> Rules:
        known = parents.select(F.col(parent).alias("__p")).distinct()
        lost = rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__p"), "left_anti")
        self._add(lost, f"{column}_unknown", severity, path, key, f"{column} must exist")
        return self

    def holds(self, rows: DataFrame, path: str, key: str, rule: Column, code: str, message: str, severity: str = "error") -> Rules:
        """A rule that is unknown (null) is not violated."""
        self._add(rows.where(~rule), code, severity, path, key, message)
        return self

    def increasing(self, rows: DataFrame, path: str, group: str, order: str, value: str, severity: str = "error") -> Rules:
        w = Window.partitionBy(group).orderBy(order)
        back = rows.withColumn("__d", F.col(value) - F.lag(value).over(w)).where("__d <= 0").select(group).distinct()
        self._add(back, f"{value}_not_increasing", severity, path, group, f"{value} must increase")
        return self

    def violations(self) -> DataFrame:
        out = self.found[0]
        for more in self.found[1:]:
            out = out.unionByName(more)
        return out
