"""N-gram Jaccard join by a MinHash forest, with exact verification.

A text's set is the hashes of its runs of five words. Texts of equal sets are
one class from the start. Each tree is a trie of its part of the signatures;
classes that share a prefix meet at a node. The walk starts at the full depth
and goes up to shorter prefixes until a pair at the threshold meets in some tree
with the target recall. At each depth the classes of a node that are not yet
connected to its leader are compared with it; a node whose classes are all
connected is closed and costs nothing further up, so only the prefixes of
classes that still lack a link are shortened. At the last depth, where a node
still has more than one component, all classes outside the leader's are
compared with all others of the node, in blocks of bounded size, of which only
the links that join components leave a task. So each two classes that meet are
compared or already connected. Links are verified on the whole sets, and
connected classes are one group.

Then the links of each class are counted: the sets of a group are dealt to
blocks of bounded size, and a task takes two blocks and counts, for each set,
the partners at the threshold. Only counts leave it, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, drop, map_rows, spread_join, stage

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
TARGET_RECALL = 0.999
#: Sets of a block, by bytes and by number, when links are counted.
BLOCK_BYTES = 4 << 20
BLOCK_SETS = 2048
_RANDOM = np.random.Generator(np.random.PCG64(17))
_TIMES = _RANDOM.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shortest_prefix(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in one of the trees with probability ``recall``."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def depths(threshold: float = THRESHOLD) -> list[int]:
    """Prefix lengths from the full depth up to the shortest that the target recall needs."""
    least = shortest_prefix(threshold)
    return [*range(DEPTH, least, -2), least]


def word_set(text: str, words: int = WORDS, cache: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted hashes of the runs of ``words`` words; fewer words are one run, none an empty set."""
    cache = {} if cache is None else cache
    if len(cache) > 300_000:
        cache.clear()
    hashes = []
    for w in text.encode().split():
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    x = np.array(hashes, np.uint64)
    n = max(1, len(x) - words + 1)
    out = np.full(n if len(x) else 0, np.uint64(min(len(x), words)))
    for k in range(min(words, len(x))):
        out = (out ^ (out >> np.uint64(29))) * _STEP + x[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(members: np.ndarray) -> bytes:
    """High halves of the smallest values under TREES * DEPTH hash functions, in big-endian order, so that bytes sort as numbers."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(members), 1024):
        least = np.minimum(least, (members[a : a + 1024, None] * _TIMES + _PLUS).min(axis=0))
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def set_key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    def start():
        cache: dict[bytes, int] = {}

        def compute(texts):
            sets = [word_set(t or "", cache=cache) for t in texts]
            return [set_key(s) for s in sets], [signature(s) if len(s) else None for s in sets]

        return compute

    return map_rows(docs, keep, [F.col(text)], {"key": pa.binary(), "signature": pa.binary()}, start)


def meetings(classes: DataFrame, prefix: int) -> DataFrame:
    """Rows (tree, prefix, label, key) of classes that meet others."""
    size = 4 * DEPTH
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring(F.col("signature"), t * size + 1, F.lit(size)).alias("label")),
    )
    rows = classes.where(F.col("signature").isNotNull()).select("key", F.inline(trees))
    rows = rows.withColumn("prefix", F.substring(F.col("label"), F.lit(1), F.lit(4 * prefix)))
    shared = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("leader")).where("n > 1")
    return rows.join(shared.select("tree", "prefix", "leader"), ["tree", "prefix"])


def with_labels(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``met`` without the leaders' own rows, with ``apart``: whether a class is in another component than its leader."""
    members = met.drop("label").where(F.col("key") != F.col("leader"))
    if labels is None:
        return members.withColumn("label", F.col("key")).withColumn("apart", F.lit(True))
    named = members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    heads = labels.select(F.col("key").alias("leader"), F.col("label").alias("head"))
    named = spread_join(named, heads, "leader", F.col("key"), "left")
    return named.withColumn("apart", F.col("label") != F.coalesce("head", "leader")).drop("head")


def verify(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``candidates`` (a, b) with ``linked``, by the Jaccard similarity of the whole sets (key, members)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    linked.append(False)
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(common >= threshold * (len(p) + len(q) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    with_b = candidates.join(sets.select(F.col("key").alias("b"), F.col("members").alias("__b")), "b")
    both = spread_join(with_b, sets.select(F.col("key").alias("a"), F.col("members").alias("__a")), "a", F.col("b"))
    return both.select("a", "b", "__a", "__b").mapInArrow(compare, "a binary, b binary, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key that links lead to.

    Labels go along links and from label to label until none changes; each
    round is written, so a lost executor repeats one round at most.
    """
    ways = links.select(F.col("a").alias("key"), F.col("b").alias("to")).union(links.select(F.col("b"), F.col("a")))
    labels = stage(ways.groupBy("key").agg(F.least("key", F.min("to")).alias("label")), "near-labels")
    while True:
        near = ways.join(labels.withColumnRenamed("key", "to"), "to").groupBy("key").agg(F.min("label").alias("near"))
        hops = labels.select(F.col("key").alias("label"), F.col("label").alias("hop"))
        new = (
            labels.join(near, "key")
            .join(hops, "label", "left")
            .select("key", F.least("label", "near", F.coalesce("hop", "label")).alias("label"), F.col("label").alias("old"))
        )
        new = stage(new, "near-labels")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return new.select("key", "label")
        labels = new.select("key", "label")


def shared_hashes(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set in turn, the sizes of its intersections with all sets.

    Postings of the hashes give them; of a hash that most sets hold, the sets
    without it are posted instead, so near copies have short postings.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    held_by = np.bincount(column)
    common = held_by > n / 2
    number = np.cumsum(common) - 1
    holds = np.zeros((n, int(common.sum())), bool)
    of_common = common[column]
    holds[row[of_common], number[column[of_common]]] = True
    without, lacked = np.nonzero(~holds)
    lacks = np.bincount(without, minlength=n)
    others = ~of_common & (held_by[column] > 1)
    row, column = np.concatenate([row[others], without]), np.concatenate([column[others], np.flatnonzero(common)[lacked]])
    posted = row[np.argsort(column, kind="stable")]
    length = np.bincount(column, minlength=len(held_by))
    start = np.cumsum(length) - length
    by_row = column[np.argsort(row, kind="stable")]
    bounds = np.searchsorted(np.sort(row), np.arange(n + 1))
    for a in range(n):
        own = by_row[bounds[a] : bounds[a + 1]]
        each = length[own]
        met = posted[np.repeat(start[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        yield np.bincount(met, minlength=n) + holds.shape[1] - lacks[a] - lacks


def links_in_block(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(key, n): how many rows of the same group each row (key, label, side, cross, members) is linked to.

    With ``cross`` only rows of the other side count.
    """
    sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
    sizes = np.array([len(x) for x in sets])
    label = pd.factorize(rows["label"])[0]
    side, cross = rows["side"].to_numpy(), bool(rows["cross"].iloc[0])
    links = np.zeros(len(sets), np.int64)
    for a, shared in enumerate(shared_hashes(sets)):
        linked = (label == label[a]) & (shared >= threshold * (sizes[a] + sizes - shared) - 1e-9)
        linked[a] = False
        links[a] = (linked & (side != side[a])).sum() if cross else linked.sum()
    return pd.DataFrame({"key": rows["key"], "n": links})


def joins_in_block(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(a, b): links that join different labels, of rows (key, bucket, label, seeks, members).

    Every row with ``seeks`` is compared with all rows of its bucket. A link
    is given only if those before it don't connect its two labels, so there
    are fewer than rows.
    """
    rows = rows.sort_values("seeks", ascending=False, kind="stable").drop_duplicates(["bucket", "key"])
    sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
    sizes = np.array([len(x) for x in sets])
    bucket, key, seeks = pd.factorize(rows["bucket"])[0], list(rows["key"]), rows["seeks"].to_numpy()
    label = pd.factorize(rows["label"])[0]
    out = []
    for a, shared in enumerate(shared_hashes(sets)):
        if not seeks[a]:
            break
        linked = (bucket == bucket[a]) & (label != label[a]) & (shared >= threshold * (sizes[a] + sizes - shared) - 1e-9)
        for b in np.flatnonzero(linked):
            if label[b] != label[a]:
                out.append((min(key[a], key[b]), max(key[a], key[b])))
                label[label == label[b]] = label[a]
    return pd.DataFrame(out, columns=["a", "b"])


def rest_of_buckets(met: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes that meet, that their leaders have not connected yet.

    ``met`` has the rows of meetings(), ``labels`` the components of the links
    to leaders. In each bucket the classes outside the leader's component are
    compared with all classes of the bucket, block by block; buckets of the
    same classes are one. The leader itself has been compared with all.
    """
    named = stage(with_labels(met, labels).select("tree", "prefix", "key", "label", "apart"), "near-named")
    of_bucket = (
        named.groupBy("tree", "prefix")
        .agg(
            F.count(F.lit(1)).alias("m"),
            F.count_if("apart").alias("q"),
            F.bit_xor(F.xxhash64("key")).alias("x"),
            F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
            F.bit_xor(F.when(F.col("apart"), F.xxhash64("key", F.lit(2))).otherwise(0)).alias("z"),
        )
        .where("m > 1 and q > 0")
    )
    once = of_bucket.groupBy("m", "q", "x", "y", "z").agg(F.min(F.struct("tree", "prefix")).alias("one"))
    once = once.select("one.tree", "one.prefix")
    held = named.join(once, ["tree", "prefix"]).withColumn("bucket", F.xxhash64("tree", "prefix")).drop("tree", "prefix")
    held = stage(held.join(sets, "key"), "near-rest")
    size = F.octet_length("members").cast("long")
    sums = held.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.sum(size).alias("bytes"), F.count_if("apart").alias("q"), F.sum(F.when(F.col("apart"), size).otherwise(0)).alias("q_bytes")
    )
    blocks = lambda n, of: F.greatest(F.ceil(F.col(of) / BLOCK_BYTES), F.ceil(F.col(n) / BLOCK_SETS), F.lit(1))
    sums = sums.select("bucket", "m", "bytes", blocks("q", "q_bytes").alias("seekers"), blocks("m", "bytes").alias("sought"))
    total = sums.agg(F.sum("bytes"), F.sum("m")).first()
    parts = max(8, (total[0] or 0) // BLOCK_BYTES, (total[1] or 0) // BLOCK_SETS)
    rows = spread_join(held, sums.select("bucket", "seekers", "sought"), "bucket", F.col("key"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    hashed = F.xxhash64("key")
    columns = ["key", "bucket", "label", "members", "seekers", "sought"]
    as_sought = rows.select(*columns, F.lit(False).alias("seeks"), F.explode(upto("seekers")).alias("i"), F.pmod(hashed, F.col("sought")).alias("j"))
    as_seeker = rows.where("apart").select(*columns, F.lit(True).alias("seeks"), F.pmod(hashed, F.col("seekers")).alias("i"), F.explode(upto("sought")).alias("j"))
    alone = (F.col("seekers") == 1) & (F.col("sought") == 1)
    part = F.when(alone, F.pmod(F.xxhash64("bucket"), F.lit(parts))).otherwise(F.col("bucket"))
    return (
        as_sought.unionByName(as_seeker)
        .select("key", "bucket", "label", "members", "seeks", part.alias("part"), F.when(alone, F.lit(-1).cast("long")).otherwise(F.col("i")).alias("i"), "j")
        .groupBy("part", "i", "j")
        .applyInPandas(lambda rows: joins_in_block(rows, threshold), "a binary, b binary")
    )


def count_links(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, n_links) of all ``groups`` (key, label): exact counts within each group.

    Groups up to a block are dealt out together. A larger one is split into
    blocks by hash, and each two of them are a task of their own.
    """
    held = stage(groups.join(sets, "key"), "near-members")
    of_group = held.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("members").cast("long")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("m") / BLOCK_SETS))
    of_group = of_group.where("m > 2").withColumn("blocks", blocks)
    total = of_group.agg(F.sum("bytes")).first()[0] or 0
    parts = max(8, int(total // BLOCK_BYTES))
    rows = spread_join(held, of_group.select("label", "blocks"), "label", F.col("key"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    counted = (
        dealt.select(
            "key",
            "label",
            "members",
            F.when(alone, F.pmod(F.xxhash64("label"), F.lit(parts))).otherwise(F.xxhash64("label")).alias("part"),
            F.when(alone, F.lit(-1).cast("long")).otherwise(F.least("own", "other")).alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            (F.col("own") != F.col("other")).alias("cross"),
        )
        .groupBy("part", "low", "high")
        .applyInPandas(lambda rows: links_in_block(rows, threshold), "key binary, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n_links"))
    )
    return held.select("key").join(counted, "key", "left").select("key", F.coalesce("n_links", F.lit(1)).alias("n_links"))  # two connected sets have one link each


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id and, with ``links``, n_links.

    The class id is the smallest doc_id of the group. Texts of equal word sets
    are one class; n_links counts all classes of other texts that are similar
    to that class. Null and wordless texts are a class of their own, without
    links; a null id is never a class id unless all ids of the group are null.
    """
    lengths = depths(threshold)
    ids = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("of", F.xxhash64("text"))
    signed = stage(signatures(ids, keep=("id", "of")), "near-signatures")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "of")).alias("one")
    classes = signed.groupBy("key").agg(one, F.first("signature").alias("signature"))
    classes = stage(classes.select("key", F.col("one.id").alias("first"), F.col("one.of").alias("of"), "signature"), "near-classes")
    met = stage(meetings(classes, lengths[-1]), "near-meetings")

    nodes = met.select("key").distinct().join(classes.select("key", "first", F.col("of").alias("expected_of")), "key").withColumnRenamed("key", "expected")

    def members_of():
        def compute(texts, keys):
            sets = [word_set(t or "") for t in texts]
            return [[s.tobytes() if set_key(s) == k else None for s, k in zip(sets, keys, strict=True)]]

        return compute

    # by id and text, so that rows without an id meet only their own class
    wanted = ids.join(nodes, ids["id"].eqNullSafe(nodes["first"]) & (ids["of"] == nodes["expected_of"])).select(F.col("expected").alias("key"), "text")
    sets = map_rows(wanted, ["key"], [F.col("text"), F.col("key")], {"members": pa.binary()}, members_of)
    sets = stage(sets.where(F.col("members").isNotNull()).dropDuplicates(["key"]), "near-sets")

    found, labels = None, None
    for length in lengths:
        at = met if length == lengths[-1] else meetings(classes, length)
        open_ = with_labels(at, labels).where("apart").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
        links_ = stage(verify(open_, sets, threshold).where("linked").select("a", "b"), "near-links")
        found = links_ if found is None else found.union(links_)
        labels = components(found)
    rest = stage(rest_of_buckets(met, labels, sets, threshold), "near-rest-links")
    if not rest.isEmpty():
        labels = components(found.union(rest))
    drop(met)
    groups = labels.join(classes.select("key", "first"), "key")
    least = groups.groupBy("label").agg(F.min("first").alias("class_id"))
    groups = spread_join(groups, least, "label", F.col("key")).select("key", "class_id")
    if links:
        groups = groups.join(count_links(labels, sets, threshold), "key")
    member = classes.select("key", "first").join(groups, "key", "left")
    return spread_join(signed.select("id", "key"), member, "key", F.col("id")).select(
        F.col("id").alias("doc_id"),
        F.coalesce("class_id", "first").alias("class_id"),
        *[F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] * links,
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group, the document with the smallest id.

    Rows of equal id are one document and stay together. A row without an id
    goes only if its group has a document with one.
    """
    found = near_duplicates(docs, links=False)
    gone = found.where(F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = gone.select(F.col("doc_id").alias("gone")).distinct()
    kept = found.join(gone, found["doc_id"].eqNullSafe(gone["gone"]), "left_anti")
    ids = kept.select(F.col("doc_id").alias("id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")
