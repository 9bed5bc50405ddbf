"""Token counts by source, language and tokenizer version, maintained by deltas.

A batch of changes becomes signed counts: an insert adds a document and its
tokens, a delete takes them away, a revision adds the difference. A commit adds
a batch's sums to the last totals and publishes both the new totals and the
batch's id as one version, so a reader sees a batch whole or not at all, and
reading costs the same after any number of batches.
"""

from __future__ import annotations

import atexit
import base64
import uuid

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import _remove, documents, drop, map_rows, shared_dir, shuffles_removed, spread_join, stage
from lapsight.sources.publish import Conflict, clean, publish, read_table, versions

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = r"[^\x20\x09-\x0D]+"
KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
APPLIED = "batch_id string, content string"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (op, source, lang, tokenizer, tokens, old_tokens) as signed counts.

    op is insert, delete or revise; a revision moves the count from old_tokens
    to tokens, under the same keys (a document that moves to another source is a
    deletion and an insertion). Any other op, or none, is an error of the whole
    batch, which is then not committed. Null counts are 0, null keys are keys
    of their own.
    """
    known = F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False))
    op, n = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null"))))), F.coalesce("tokens", F.lit(0))
    return changes.withColumn("op", op).select(
        *KEYS,
        F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long").alias("docs"),
        F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens"),
    )


def summed(counts: DataFrame) -> DataFrame:
    """One row per key that has documents or tokens; sums are taken before the shuffle."""
    sums = counts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))


def content_hash(sums: DataFrame) -> str:
    """A hash of the rows as a set; nulls are told from other columns' values."""
    row = F.to_json(F.struct(*KEYS, "docs", "tokens"))
    total = F.coalesce(F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.lit(0))
    return sums.select(F.format_string("%d:%s", F.count(F.lit(1)), total.cast("string"))).first()[0]


class Ledger:
    """Totals and the ids of the batches in them, published together as versions below ``path``.

    Of two writers that start from one version the second is told so by the log
    and adds its batch to the other's totals instead. The last two versions
    stay for readers; older ones are removed once they are a day old.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str, schema: str, version: int) -> DataFrame:
        return read_table(self.spark, self.path, name, version) if version else self.spark.createDataFrame([], schema)

    def _last(self) -> int:
        return max(versions(self.spark, self.path), default=0)

    def _add(self, version: int, batch_id: str, content: str, sums: DataFrame) -> None:
        """Publish the totals of ``version`` with ``sums``, if no other version has come since."""
        ids = self._at("applied", APPLIED, version).unionByName(self.spark.createDataFrame([(batch_id, content)], APPLIED))
        totals = summed(self._at("totals", SCHEMA, version).unionByName(sums))
        with shuffles_removed(self.spark):
            number = publish(self.spark, self.path, {"totals": totals, "applied": ids.coalesce(1)}, expected=version)
        if number > 1 and number - 1 not in versions(self.spark, self.path):  # an entry that old writers took after it was cleaned away
            raise Conflict(f"{self.path}: version {version} is long past")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before.

        A batch counts once however often it comes. One that comes again with
        other sums is an error, as is an id that is null or empty.
        """
        if not batch_id:
            raise ValueError("a batch needs an id")
        sums = stage(summed(signed(changes)), "ledger-batch")
        try:
            content = content_hash(sums)
            while True:
                version = self._last()
                known = self._at("applied", APPLIED, version).where(F.col("batch_id") == batch_id).first()
                if known and known["content"] != content:
                    raise ValueError(f"batch {batch_id} was committed with other content")
                if known:
                    return False
                try:
                    self._add(version, batch_id, content, sums)
                    break
                except Conflict:
                    continue
        finally:
            drop(sums)
        clean(self.spark, self.path)
        return True

    def totals(self) -> DataFrame:
        """One row per key that still has documents or tokens, as of the last version."""
        return self._at("totals", SCHEMA, self._last())


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def bpe_tokens(docs: DataFrame, text: str = "text", ranks_path: str = RANKS, to: str = "bpe_tokens") -> DataFrame:
    """``docs`` without ``text`` but with its number of byte-pair tokens; null text has none."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def start():
        encoding = tiktoken.Encoding("ledger", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        return lambda texts: [[len(encoding.encode_ordinary(t)) if t else 0 for t in texts]]

    return map_rows(docs, [c for c in docs.columns if c != text], [F.col(text)], {to: pa.int64()}, start)


def op4_token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four deliveries, over all documents.

    Inserted: every document under two tokenizer versions, words-1 and bpe-50k.
    Deleted: of equal texts, all but the one with the smallest id. Revised: what
    is left under bpe-50k counts an end token. Then the deletions come again,
    which changes nothing.
    """
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", "lang", word_tokens(F.col("text")).alias("words"), F.sha2("text", 256).alias("copy"), "text"
    )
    counted = stage(bpe_tokens(docs), "ledger-counts")
    first = counted.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marked = spread_join(counted.withColumn("copy", F.coalesce("copy", F.lit(""))), first, "copy", F.col("doc_id"), "left").withColumn("gone", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))

    def versions(rows: DataFrame, op: str) -> DataFrame:
        both = F.array(
            F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens")),
            F.struct(F.lit("bpe-50k").alias("tokenizer"), F.col("bpe_tokens").alias("tokens")),
        )
        return rows.select("source", "lang", F.inline(both)).withColumns({"op": F.lit(op), "old_tokens": F.lit(0)})

    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex[:12]}")
    atexit.register(_remove, spark, ledger.path)
    gone = versions(marked.where("gone"), "delete")
    ledger.commit("1-insert", versions(counted, "insert"))
    ledger.commit("2-delete", gone)
    ledger.commit(
        "3-revise",
        marked.where(~F.col("gone")).select(
            "source", "lang", F.lit("bpe-50k").alias("tokenizer"), (F.col("bpe_tokens") + 1).alias("tokens"),
            F.lit("revise").alias("op"), F.col("bpe_tokens").alias("old_tokens"),
        ),
    )
    ledger.commit("2-delete", gone)
    return ledger.totals()
