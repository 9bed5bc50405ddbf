"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Each source's documents are shuffled by hash and cut into blocks of equal word
counts. Slot i of the schedule goes to the source in whose share of the unit
interval the i-th golden-ratio point falls; the k-th slot of a source takes its
k-th block, beginning anew after the last. Nothing depends on partitioning, so
reruns agree.

Ranks and running sums of a source are taken in chunks of bounded size whose
totals are summed first, so a source with a third of all rows is no larger task
than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, fresh, group_key, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 512
#: Small sources get blocks of fewer words, so that their slots are at least so many.
MIN_BLOCKS = 400
CHUNK = 4096
GOLDEN = 0.6180339887498949
SEED = 20240229


def words(text: Column) -> Column:
    """Whitespace-separated words; null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, share: float = 1.0) -> DataFrame:
    """Targets of sources (key, source, source_size), as far as MAX_REPEATS allows.

    Weights go round WEIGHTS in order of the source, null last. Where a share is
    above MAX_REPEATS times the source's size it stops there, and the excess is
    shared by weight among the others, until none is above. The sources that
    stop are those with the least size for their weight, so one running sum over
    the list of sources, sorted by that ratio, finds the level for the rest.
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), turn + 1))
    most = F.col("source_size") * float(MAX_REPEATS)
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(most / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (
        share * F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        weighed.withColumn("__level", level)
        .withColumn("__free", F.when(F.col("__level") * F.col("weight") <= most, F.col("__level")))
        .withColumn("__at", F.max("__free").over(everything))
        .withColumn("target", F.least(F.coalesce(F.col("__at") * F.col("weight"), most), most))
        .drop("__level", "__free", "__at")
    )


def plan_blocks(sources: DataFrame) -> DataFrame:
    """Blocks of each source, and its part of the unit interval in which slots fall."""
    size = F.col("source_size")
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    upto = by_name.rowsBetween(Window.unboundedPreceding, 0)
    return (
        sources.withColumn("block_words", F.greatest(F.least(F.floor(size / MIN_BLOCKS), F.lit(BLOCK_WORDS)), F.lit(1)))
        .withColumn("blocks", F.ceil(size / F.col("block_words")))
        .withColumn("wanted", F.when(size > 0, F.col("target") * F.col("blocks") / size).otherwise(0.0))
        .withColumn("slots", F.ceil(F.sum("wanted").over(everything)))
        .withColumn("upto", F.coalesce(F.try_divide(F.sum("wanted").over(upto), F.sum("wanted").over(everything)), F.lit(0.0)))
        .withColumn("since", F.lag("upto", 1, 0.0).over(by_name))
        .withColumn("upto", F.when(F.lead("since").over(by_name).isNull(), 1.0).otherwise(F.col("upto")))
    )


def schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """Slots (slot, key, rank, block, epoch), at most MAX_REPEATS epochs of a source's blocks.

    Points and the sources' parts meet in cells of the interval, about CHUNK
    points to a cell.
    """
    cells = max(64, slots // CHUNK)
    cell = lambda x: F.floor(F.col(x) * cells)
    where = (
        plan.where("wanted > 0")
        .select("key", "blocks", "since", "upto")
        .withColumn("cell", F.explode(F.sequence(cell("since"), cell("upto"))))
    )
    turn = (F.col("slot") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", turn - F.floor(turn)).withColumn("cell", cell("u"))
    dealt = points.join(where, "cell").where((F.col("u") >= F.col("since")) & (F.col("u") < F.col("upto")))
    dealt = dealt.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    totals = dealt.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "chunk").orderBy("slot")
    ranked = (
        dealt.withColumn("__r", F.row_number().over(inside) - 1)
        .join(starts, ["key", "chunk"])
        .withColumn("rank", F.col("base") + F.col("__r"))
    )
    return ranked.select(
        "slot", "key", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("epoch")
    ).where(F.col("epoch") < MAX_REPEATS)


def pieces(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Where each document (row, key, h, size) falls in its source's shuffled blocks: (row, key, block, words)."""
    shuffled = sized.where("size > 0").join(plan.select("key", "source_docs", "block_words"), "key")
    parts = F.greatest(F.ceil(F.col("source_docs") / CHUNK), F.lit(1))
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * parts / F.lit(2.0**32))
    shuffled = shuffled.withColumn("part", part)
    totals = shuffled.groupBy("key", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "part").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        shuffled.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["key", "part"])
        .withColumn("start", F.col("base") + F.col("__before"))
        .withColumn("end", F.col("start") + F.col("size"))
    )
    first, last = F.expr("start div block_words"), F.expr("(end - 1) div block_words")
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    opens = F.col("block") * F.col("block_words")
    inside_block = F.least(F.col("end"), opens + F.col("block_words")) - F.greatest(F.col("start"), opens)
    return cut.select("row", "key", "block", inside_block.alias("words"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: columns of ``keep``, size, source_size, target and taken.

    ``taken`` counts the words that the scheduled blocks take from the document,
    repeats included, at most MAX_REPEATS times its size. Documents without
    words are taken 0 times; a null source is a source of its own. Texts are
    read once, for their sizes.
    """
    spark = docs.sparkSession
    sized = stage(
        docs.select(
            *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)],
            group_key(F.col(source)).alias("key"),
            F.col(source).cast("string").alias("source"),
            words(F.col(text)).alias("size"),
            F.md5(F.concat_ws(":", F.lit(str(SEED)), *[F.col(c).cast("string") for c in keep])).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("key").agg(
        F.max("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")
    )
    plan = stage(plan_blocks(targets(sources)), "mix-plan")
    slots = int(plan.agg(F.max("slots")).first()[0] or 0)
    taken_blocks = schedule(spark, plan, slots).groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    took = (
        pieces(sized.select("row", "key", "h", "size"), plan)
        .join(taken_blocks, ["key", "block"])
        .groupBy("row")
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    return (
        sized.join(plan.select("key", "source_size", "target"), "key")
        .join(took, "row", "left")
        .select(
            *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)],
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def take(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it.

    A document of which the mix takes x words per word of its own is written
    floor(x) times, and once more with probability x - floor(x), decided by the
    hash of its id; so the written words of a source come near its target. Rows
    of equal id are told apart by their texts; rows of equal id and text are
    written equally often, as the most taken of them. A table without words
    gives no rows.
    """
    of = fresh("of", docs)
    hashed = docs.withColumn(of, F.xxhash64("text"))
    took = mix(hashed, keep=("doc_id", of)).select(F.col("doc_id").alias("id"), F.col(of).alias("hash"), (F.col("taken") / F.greatest("size", F.lit(1))).alias("x"))
    took = took.groupBy("id", "hash").agg(F.max("x").alias("x"))
    u = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(1 << 20)) / float(1 << 20)
    times = took.withColumn("times", F.floor(F.col("x") + u).cast("int")).where("times > 0")
    joined = hashed.join(times, hashed["doc_id"].eqNullSafe(times["id"]) & (hashed[of] == times["hash"]))
    again = F.explode(F.sequence(F.lit(1), times["times"]))
    return joined.select(*[hashed[c] for c in docs.columns], again.alias(of)).drop(of)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('20240229:' || doc_id::VARCHAR) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 3.0 * source_size AS most, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3.0 * source_size) OVER r, 0)::DOUBLE AS most_before, coalesce(sum(weight) OVER r, 0) AS weight_before
  FROM s WINDOW r AS (ORDER BY 3.0 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (total - most_before) / (weights - weight_before) AS level FROM l
), t AS (
  SELECT source, source_size, least(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most)::DOUBLE AS target FROM f
), b AS (
  SELECT *, greatest(least(source_size // 400, 512), 1)::BIGINT AS bw FROM t
), c AS (
  SELECT *, ceil(source_size / bw)::BIGINT AS blocks FROM b
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0.0 END::DOUBLE AS wanted FROM c
), u AS (
  SELECT *, ceil(sum(wanted) OVER ())::BIGINT AS slots,
         sum(wanted) OVER (ORDER BY source ASC NULLS LAST) / sum(wanted) OVER () AS upto0 FROM w
), v AS (
  SELECT *, coalesce(lag(upto0) OVER (ORDER BY source ASC NULLS LAST), 0.0) AS since,
         CASE WHEN lead(source_size) OVER (ORDER BY source ASC NULLS LAST) IS NULL THEN 1.0 ELSE upto0 END AS upto FROM u
), p AS (
  SELECT i AS slot, (i + 1) * 0.6180339887498949::DOUBLE - floor((i + 1) * 0.6180339887498949::DOUBLE) AS x
  FROM (SELECT unnest(range((SELECT max(slots) FROM v))) AS i)
), k AS (
  SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM p JOIN v ON x >= since AND x < upto WHERE wanted > 0
), n AS (
  SELECT source, rank % blocks AS block, count(*) AS times FROM k WHERE rank // blocks < 3 GROUP BY ALL
), o AS (
  SELECT doc_id, d.source, size, bw, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source WHERE size > 0
), q AS (
  SELECT *, unnest(range(start // bw, (start + size - 1) // bw + 1)) AS block FROM o
), g AS (
  SELECT doc_id, sum((least(start + size, (q.block + 1) * bw) - greatest(start, q.block * bw)) * times)::BIGINT AS taken
  FROM q JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.block = n.block GROUP BY doc_id
)
SELECT d.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (doc_id)
"""
