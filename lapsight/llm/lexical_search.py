"""Ranked lexical search: an inverted index in shards, and Block-Max MaxScore over it.

Index. A task reads its documents once and closes a shard after SHARD_BYTES of
text or SHARD_DOCS documents. In a shard, documents are numbered by rising
length, so the documents of a block are alike in length and the block's bound,
from its largest frequency and its shortest document, is tight. A term's list
is cut into blocks of BLOCK postings, packed as variable-length integers; the
block's first and last number, largest frequency and length in bytes stand
beside the bytes, so a block can be judged before it is unpacked. One row holds
a term's list in a shard; the row of the empty term holds the shard's
documents. Every document and every term is indexed.

Search. Queries are put into groups of QUERIES; a group's lists meet by shard.
Global bounds of the lists, in rising order, split them: lists whose bounds
together stay below the tenth score so far are non-essential, as they alone
cannot lift a document into the result. Only documents of the essential lists
are candidates. For each non-essential list, largest bound first, a candidate is
rejected when its score so far, the maximum of the block where it would stand
and the bounds of the lists still to come stay below the tenth score; only
blocks with a candidate left are unpacked. Each shard hands on its best K, which
are merged in two steps. Bounds hold and ties are kept, so the result is exact.

A null text has no term. A null id ranks after other ids of equal score. Equal
rows of documents are documents of their own; equal rows of queries are one
query, and a query that has no term, or none that any document holds, has no
row. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, drop, shuffles_removed, stage

SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
BLOCK = 64
QUERIES = 256
K = 10
#: Documents of one window; the tenth score is taken anew after each.
WINDOW = 2048
#: The queries' terms are sent to all tasks up to these numbers of terms and bytes; beyond, they are joined by term.
SENT_TERMS, SENT_BYTES = 200_000, 8 << 20

#: ASCII letters in lower case, digits as they are, all other ASCII to spaces; bytes from 128 up are letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "shard long, term string, docs long, occurrences long, top long, first long, heads binary, packed binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values from 0 up as bytes of seven bits each, lowest first, the last below 128; and the end of each value."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 63, 7):
        size += v >= np.uint64(1 << bits)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        part = (v[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[end[has] - size[has] + i] = part + np.where(size[has] > i + 1, np.uint64(128), np.uint64(0))
    return out, end


def unpack(packed: np.ndarray) -> np.ndarray:
    last = packed < 128
    ends = np.flatnonzero(last)
    of = np.cumsum(last) - last
    place = np.arange(len(packed)) - np.concatenate([[0], ends[:-1] + 1])[of] if len(ends) else np.zeros(0, int)
    out = np.zeros(len(ends), np.int64)
    np.add.at(out, of, (packed & 127).astype(np.int64) << (7 * place))
    return out


class _Shard:
    """Documents of a shard while they are read."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.freqs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, text: bytes | None) -> None:
        found = Counter(terms_of(text))
        self.ids.append(doc_id)
        self.lengths.append(found.total())
        self.terms.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.freqs.append(np.fromiter(found.values(), np.int64, len(found)))
        self.bytes += len(text or b"") + 64

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = np.concatenate(self.terms)
        doc = np.repeat(place, [len(x) for x in self.terms])
        freq = np.concatenate(self.freqs)
        by = np.lexsort((doc, term))
        term, doc, freq = term[by], doc[by], freq[by]
        held = np.bincount(term, minlength=len(self.number))
        start = np.cumsum(held) - held
        within = np.arange(len(term)) - start[term]
        begins = within % BLOCK == 0  # of blocks
        gap = np.where(begins, 0, doc - np.concatenate([[0], doc[:-1]]))
        packed, end = pack(np.stack([gap, freq], axis=1).ravel())
        upto = end[1::2]
        at = np.flatnonzero(begins)
        until = np.concatenate([at[1:], [len(term)]]) if len(at) else at
        heads = np.empty((len(at), 4), np.int64)
        heads[:, 0], heads[:, 1] = doc[at], doc[until - 1]
        heads[:, 2] = np.maximum.reduceat(freq, at) if len(at) else 0
        heads[:, 3] = upto[until - 1] - np.concatenate([[0], upto[until - 1][:-1]]) if len(at) else 0
        n_blocks = -(-held // BLOCK)
        last = start + held - 1
        names = np.array([None] * len(held), object)
        for name, i in self.number.items():
            names[i] = name
        top = np.maximum.reduceat(freq, start) if len(held) else held
        bytes_end = upto[last] if len(held) else held
        one = n_blocks == 1  # needs no heads: its first document and largest frequency say all
        sizes = np.where(one, 0, n_blocks * 32)
        flat = heads[np.repeat(~one, n_blocks)].astype("<i8").ravel().view(np.uint8)

        known = np.array([x is not None for x in self.ids], bool)[order]
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)[order]
        own = np.stack([ids, lengths[order], known.astype(np.int64)]).astype("<i8").tobytes()
        yield _batch([shard], [b""], [int((lengths > 0).sum())], [int(lengths.sum())], [0], [0], [b""], [own])
        step = 1 << 15
        ends, head_ends = np.concatenate([[0], bytes_end]), np.concatenate([[0], np.cumsum(sizes)])
        for a in range(0, len(held), step):
            b = min(a + step, len(held))
            yield _batch(
                np.full(b - a, shard), names[a:b], held[a:b], np.zeros(b - a, np.int64), top[a:b], doc[start[a:b]],
                _parts(flat, head_ends[a : b + 1]), _parts(packed, ends[a : b + 1]),
            )


def _parts(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the bytes between ``ends``."""
    own = data[ends[0] : ends[-1]].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(own)])


def _batch(shard, term, docs, occurrences, top, first, heads, packed) -> pa.RecordBatch:
    whole = [pa.array(x, pa.int64()) for x in (shard, docs, occurrences, top, first)]
    words = pa.array([t.decode("utf-8", "replace") for t in term], pa.string())
    both = [x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in (heads, packed)]
    return pa.RecordBatch.from_arrays([whole[0], words, *whole[1:], *both], names=["shard", "term", "docs", "occurrences", "top", "first", "heads", "packed"])


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index of all ``docs``, written; see the module's text for its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids):
                shard.add(doc, texts[i].as_py())
                if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                    yield from shard.rows((part << 24) + number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows((part << 24) + number)

    with shuffles_removed(docs.sparkSession):
        return stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, INDEX), "search-index")


def query_terms(queries: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(asked, item_id, term): the distinct terms of each different query, numbered by ``asked``; written."""
    numbered = stage(queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct().withColumn("asked", F.monotonically_increasing_id()), "search-queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            words = pa.array([t.decode("utf-8", "replace") for f in found for t in f], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), words], names=["asked", "item_id", "term"])

    kind = numbered.schema["item_id"].dataType.simpleString()
    out = stage(numbered.select("asked", "item_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"asked long, item_id {kind}, term string"), "search-terms")
    drop(numbered)
    return out


def _impact(freq: np.ndarray, length: np.ndarray, n: int, all_terms: int) -> np.ndarray:
    """What a term of weight 1 adds to a document's score."""
    most = int(length.max(initial=0))
    if 90 * n * most < 1 << 62:
        m = 10 + 90 * n * length // all_terms
    else:
        m = np.array([10 + 90 * n * int(x) // all_terms for x in length], np.int64)
    return 1_000_000_000 * freq // (1000 * freq + 8 * m)


class _List:
    """One term's list in a shard, unpacked block by block and once only."""

    def __init__(self, weight: int, docs: int, top: int, first: int, heads: bytes, packed: bytes, lengths: np.ndarray, n: int, all_terms: int) -> None:
        self.weight, self.docs, self.packed = weight, docs, np.frombuffer(packed, np.uint8)
        if heads:
            h = np.frombuffer(heads, "<i8").reshape(-1, 4)
            self.first, self.last, tops, size = h.T
        else:
            self.first, self.last, tops, size = np.array([first]), np.array([len(lengths) - 1]), np.array([top]), np.array([len(packed)])
        self.end = np.cumsum(size)
        self.most = weight * _impact(tops, lengths[self.first], n, all_terms)  # of each block
        self.bound = int(self.most.max())
        self.lengths, self.n, self.all_terms = lengths, n, all_terms
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        if i not in self.unpacked:
            pairs = unpack(self.packed[self.end[i - 1] if i else 0 : self.end[i]]).reshape(-1, 2)
            docs = self.first[i] + np.cumsum(pairs[:, 0])
            self.unpacked[i] = docs, self.weight * _impact(pairs[:, 1], self.lengths[docs], self.n, self.all_terms)
        return self.unpacked[i]

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(int(i)) for i in which]
        return (found[0] if len(found) == 1 else (np.concatenate([d for d, _ in found]), np.concatenate([s for _, s in found]))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        docs, scores = self.blocks(np.arange(np.searchsorted(self.last, a), np.searchsorted(self.first, b)))
        lo, hi = np.searchsorted(docs, (a, b))
        return docs[lo:hi], scores[lo:hi]


def best_of_shard(lists: list[_List], rank_of: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents and scores, equal scores by ``rank_of``; Block-Max MaxScore, window by window."""
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: x.bound)
    upto = np.cumsum([x.bound for x in lists])
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for a in range(0, len(rank_of), WINDOW):
        b = min(a + WINDOW, len(rank_of))
        first = int(np.searchsorted(upto, least))  # lists before it together stay below the k-th score
        if first == len(lists):
            break
        sums, met = np.zeros(b - a, np.int64), np.zeros(b - a, bool)
        for x in lists[first:]:
            d, s = x.between(a, b)
            sums[d - a] += s
            met[d - a] = True
        left = np.flatnonzero(met)
        for i in range(first - 1, -1, -1):
            x, rest = lists[i], int(upto[i - 1]) if i else 0
            left = left[sums[left] + x.bound + rest >= least]
            if not len(left):
                break
            at = np.searchsorted(x.last, left + a)
            there = np.minimum(at, len(x.last) - 1)
            inside = (at < len(x.last)) & (x.first[there] <= left + a)
            keep = sums[left] + np.where(inside, x.most[there], 0) + rest >= least
            left, there, inside = left[keep], there[keep], inside[keep]
            d, s = x.blocks(np.unique(there[inside]))
            where = np.searchsorted(d, left + a)
            hit = (where < len(d)) & (d[np.minimum(where, len(d) - 1)] == left + a) if len(d) else np.zeros(len(left), bool)
            sums[left[hit]] += s[where[hit]]
        left = left[sums[left] >= least]
        if len(left):
            docs, scores = np.concatenate([docs, left + a]), np.concatenate([scores, sums[left]])
            order = np.lexsort((rank_of[docs], -scores))[:k]
            docs, scores = docs[order], scores[order]
            least = int(scores[-1]) if len(scores) == k else 1
    return docs, scores


def search(index: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query of query_terms()."""
    spark = index.sparkSession
    totals = index.where("term = ''").agg(F.sum("docs"), F.sum("occurrences")).first()  # two numbers
    n, all_terms = totals[0] or 0, max(1, totals[1] or 0)
    terms = asked.select("term").distinct()
    size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    sent = F.broadcast if size[0] <= SENT_TERMS and size[1] <= SENT_BYTES else lambda df: df
    df = index.join(sent(terms), "term").groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * n + 2) / (2 * F.col("df") + 1)))
    groups = max(1, -(-asked.select("asked").distinct().count() // QUERIES))
    by_group = asked.withColumn("group", F.pmod(F.xxhash64("asked"), F.lit(groups)))
    wanted = by_group.groupBy("group", "term").agg(F.collect_list("asked").alias("asked"))  # at most the group's queries
    wanted = stage(wanted.join(df, "term").withColumn("weight", weight).where("weight > 0").select("group", "term", "weight", "asked"), "search-wanted")
    found = index.select("shard", "term", "docs", "top", "first", "heads", "packed").join(sent(wanted), "term")
    tables = index.where("term = ''").select("shard", "term", "docs", "top", "first", "heads", "packed")
    tables = tables.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    tables = tables.withColumn("weight", F.lit(0).cast("long")).withColumn("asked", F.array().cast("array<bigint>"))
    met = found.select(*tables.columns).unionByName(tables)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["term"] == ""].iloc[0]
        ids, lengths, known = np.frombuffer(own["packed"], "<i8").reshape(3, -1)
        rank_of = np.empty(len(ids), np.int64)
        rank_of[np.lexsort((ids, 1 - known))] = np.arange(len(ids))
        by_query = defaultdict(list)
        for r in rows[rows["term"] != ""].itertuples():
            x = _List(r.weight, r.docs, r.top, r.first, r.heads, r.packed, lengths, n, all_terms)
            for q in r.asked:
                by_query[q].append(x)
        out = []
        for q, lists in by_query.items():
            docs, scores = best_of_shard(lists, rank_of, k)
            out.append(pd.DataFrame({"asked": q, "doc_id": pd.array(ids[docs], "Int64"), "score": scores, "shard": own["shard"]}))
            out[-1].loc[known[docs] == 0, "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "doc_id": [], "score": [], "shard": []})

    heaps = met.groupBy("group", "shard").applyInPandas(run, "asked long, doc_id long, score long, shard long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]

    def best(rows: DataFrame, *keys) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)

    some = best(heaps.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(32))), "asked", "part").drop("rank")
    names = asked.select("asked", "item_id").distinct()
    with shuffles_removed(spark):
        return best(some, "asked").join(names, "asked").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(documents(spark, sf_dir))
    return search(index, query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH words AS (SELECT doc_id, unnest(terms) AS term, len(terms) AS n FROM (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL)),
postings AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM words GROUP BY ALL),
totals AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS all_terms FROM words),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // all_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
