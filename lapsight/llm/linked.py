"""Components of links between numbers, where one node may hold a third of all links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsight.llm.staging import drop, spread_join, stage


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key that the links (a, b) lead to; a staged table.

    Each round takes the smallest label of the neighbours and the label of the
    own label, until none changes. A hub's links, and the rows of a large
    component, are joined in parts. Rounds are written and the one before
    removed, so a lost executor repeats one round at most.
    """
    ways = stage(links.select(F.col("a").alias("key"), F.col("b").alias("to")).union(links.select("b", "a")).where("key != to").distinct(), "ways")
    labels = stage(ways.groupBy("key").agg(F.least("key", F.min("to")).alias("label")), "labels")
    while True:
        near = spread_join(ways, labels.withColumnRenamed("key", "to"), "to", F.col("key")).groupBy("key").agg(F.min("label").alias("near"))
        hops = labels.select(F.col("key").alias("label"), F.col("label").alias("hop"))
        moved = spread_join(labels.join(near, "key"), hops, "label", F.col("key"))
        new = stage(moved.select("key", F.least("near", "hop", "label").alias("label"), F.col("label").alias("old")), "labels")
        drop(labels)
        if new.where(F.col("label") != F.col("old")).isEmpty():
            drop(ways)
            return new
        labels = new
