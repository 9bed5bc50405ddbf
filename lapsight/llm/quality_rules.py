"""Quality rules with verdicts on hosts (only DataFrame functions).

Every document is measured on its whole text, failures of the document rules
are counted by host, the hosts' failure rates are shrunk with a beta prior
fitted to all hosts, and the hosts' verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, fresh, group_key, spread_join, stage

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUP_LINES_PERCENT = 30
HOST_LIMIT = 0.5
HOST_DEVIATIONS = 2.0


def _windows(words: Column) -> Column:
    """A 64-bit hash of each 3-word window."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda word, i: F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)),
    )


def _placed(hashes: Column) -> Column:
    """Hash and place, sorted; empty for texts whose windows all differ, which skip the sort."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def _covered(placed: Column) -> Column:
    """Words in windows whose hash stands twice or more in ``placed``."""
    twice = F.filter(
        placed, lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"])
    )
    return F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows of three words are compared by 64-bit hash, sorted with their places,
    so the cost is n log n in the words of a text. A null text has no words. Equal to an earlier line means equal to the last
    character; lines without a word never count.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    return (
        docs.withColumn("__words", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(whole, SPACE, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(whole, F.lit(SYMBOL)).cast("long"))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("__windows", _windows(F.col("__words")))
        .withColumn("__placed", _placed(F.col("__windows")))
        .withColumn("n_repeat_words", F.coalesce(_covered(F.col("__placed")), F.lit(0)).cast("long"))
        .drop("__words", "__windows", "__placed")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    """Too many symbols for the words, or too many lines said twice."""
    return (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * F.col("n_words")) | (
        100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines")
    )


def host_verdicts(failures: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """Per host: documents, failures, shrunken rate and verdict.

    The prior is a beta distribution fitted by moments to the rates of all
    hosts. A host is rejected if the rate is above HOST_LIMIT by
    HOST_DEVIATIONS posterior standard deviations, so small hosts, whose rates
    say little, are left alone. No rows in, no rows out.
    """
    hosts = failures.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v")).select(
        F.lit(1).alias("__one"),
        F.greatest(F.col("m"), F.lit(1e-6)).alias("m"),
        F.least(
            F.greatest(F.col("m") * (1 - F.col("m")) / F.greatest(F.col("v"), F.lit(1e-12)) - 1, F.lit(1.0)),
            F.lit(1e6),
        ).alias("strength"),
    )
    a = F.col("n_failed") + F.col("m") * F.col("strength")
    total = F.col("n_docs") + F.col("strength")
    posterior = F.col("host_rate")
    return (
        hosts.withColumn("__one", F.lit(1))
        .join(F.broadcast(prior), "__one")  # one row
        .withColumn("host_rate", a / total)
        .withColumn(
            "host_rejected",
            posterior - HOST_DEVIATIONS * F.sqrt(F.greatest(posterior * (1 - posterior), F.lit(0.0)) / (total + 1)) > HOST_LIMIT,
        )
        .select(host, "n_docs", "n_failed", "host_rate", "host_rejected")
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns of ``keep``, the measures and the verdicts.

    A null host is a host of its own. A document is kept if neither a rule nor
    its host rejects it. Only the measures are written and shuffled, never
    texts; a host with a third of all documents is counted before the shuffle
    and its verdict is joined to parts of its documents.
    """
    rows = docs.select(
        *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], group_key(F.col(host)).alias("host"), F.col(text).alias("__text")
    )
    measured = stage(
        measures(rows, "__text")
        .drop("__text")
        .withColumn("base_failed", base_failed())
        .withColumn("failed", base_failed() | soft_failed()),
        "quality",
    )
    verdicts = host_verdicts(measured).select("host", "host_rejected")
    return spread_join(measured, verdicts, "host", F.col("__keep_0")).select(
        *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("failed") & ~F.col("host_rejected")).alias("kept"),
        "host_rejected",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep.

    Rows of equal id are judged by their own text; where two of them have the
    same text and different sources, both stay if one does.
    """
    of = fresh("of", docs)
    hashed = docs.withColumn(of, F.xxhash64("text"))
    kept = judge(hashed, keep=("doc_id", of)).where("kept").select(F.col("doc_id").alias("id"), F.col(of).alias("hash")).distinct()
    return hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["id"]) & (hashed[of] == kept["hash"]), "left_semi").drop(of)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS host FROM documents
), w AS (
  SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2)
  GROUP BY doc_id
), m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
          OR 100 * n_dup_lines > 30 * n_lines) AS failed FROM m
), h AS (
  SELECT host, count(*) AS n, sum(failed::BIGINT)::DOUBLE AS k FROM f GROUP BY host
), p AS (
  SELECT greatest(avg(k / n), 1e-6) AS m,
         least(greatest(avg(k / n) * (1 - avg(k / n)) / greatest(var_pop(k / n), 1e-12) - 1, 1.0), 1e6) AS s FROM h
), v AS (
  SELECT host, (k + m * s) / (n + s) AS q, n + s AS total FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT failed AND NOT (q - 2.0 * sqrt(greatest(q * (1 - q), 0.0) / (total + 1)) > 0.5)) AS kept,
       (q - 2.0 * sqrt(greatest(q * (1 - q), 0.0) / (total + 1)) > 0.5) AS host_rejected
FROM f JOIN v USING (host)
"""
