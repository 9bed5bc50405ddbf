"""Removal of repeated byte strings by suffix arrays over shared neighbourhoods.

A byte goes if a WIDTH-byte string that covers it also starts in a document
with a smaller id. Each WIDTH-byte window is assigned to the smallest hash among
its GRAM-byte strings; equal windows have equal smallest hashes, so only pieces
(runs of windows with one assigned place) of the same hash need comparing:

1. documents of equal text are judged by the smallest id among them;
2. pieces are counted by hash, after equal pieces of a batch have become one;
   those that stand in one document only are done;
3. a piece that stands whole in a smaller document is repeated throughout; the
   first owners of different pieces with one hash, and with equal bytes beside
   it, are compared by text: their suffixes are sorted in two stages and
   adjacent common prefixes of WIDTH bytes give, for each window, the smallest
   document it starts in;
4. where more than CROWD such pieces have one hash, they are cut into single
   windows first, which are whole strings and compared as such, so no suffix
   array grows with the frequency of a passage;
5. the removed runs of each document are joined back to its text.

Only hashes and places are shuffled for all documents, texts for those with
repeats. Places are shuffled in ROUNDS parts of the hashes, one after the other,
and each table between jobs is removed after its last reader, so the disk holds
a part at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsight.llm.staging import byte_slices, documents, drop, stage

WIDTH = 50
GRAM = 16
#: Of WIDTH - GRAM bytes around a place, at least so many stand on one side of it.
SIDE = (WIDTH - GRAM) // 2
#: Bytes whose windows are assigned at once, and of the texts that one suffix array holds.
SLICE = 1 << 17
ARRAY_BYTES = 1 << 20
#: Pieces of one hash beyond which they are compared as single windows.
CROWD = 4096
#: Parts in which places are shuffled (a power of two).
ROUNDS = 2
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_LETTERS = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, 256, dtype=np.uint64)
_UP, _DOWN = _powers(_BASE, SLICE + 4096), _powers(_INVERSE, SLICE + 4096)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces_of(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Runs of windows of ``data`` with one assigned place: start, windows, hash of the place, hash of the run's bytes, offset of the place, sides.

    ``ends`` gives, for each byte, where its text ends; no window crosses it.
    The sides are two 32-bit hashes in one number, of the place with the bytes
    before it and of the place with those after it; 0 where the run has fewer.
    """
    n = len(data)
    if n < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * _DOWN[:n], dtype=np.uint64)])
    h = _mixed((sums[gram:] - sums[:-gram]) * _UP[: n - gram + 1])
    span = width - gram + 1
    order = (h >> np.uint64(32)).astype(np.uint32)  # ties go to the last of a window, as those of equal strings do
    low, size = order, 1
    while size * 2 <= span:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :]) if size < span else low
    starts = np.arange(n - width + 1)
    valid = starts + width <= ends[: len(starts)]
    newest = order[span - 1 :] == low
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (low[1:] != low[:-1]) | ~valid[:-1] | (ends[1 : len(starts)] != ends[: len(starts) - 1])
    place = np.zeros(len(starts), np.int64)
    place[newest] = starts[newest] + span - 1
    for part in np.array_split(np.flatnonzero(fresh & ~newest), 1 + len(starts) // 200_000):
        around = order[part[:, None] + np.arange(span - 1, -1, -1)]
        place[part] = part + span - 1 - around.argmin(axis=1)
    place = place[np.maximum.accumulate(np.where(newest | fresh, starts, 0))]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (ends[1 : len(starts)] != ends[: len(starts) - 1])
    first = np.flatnonzero(opens)
    bounds = np.cumsum(valid)
    count = np.diff(np.append(bounds[first] - 1, bounds[-1]))
    text = _mixed((sums[first + count + width - 1] - sums[first]) * _UP[first] + count.astype(np.uint64))
    at, side = place[first], (width - gram) // 2
    sides = np.zeros(len(first), np.uint64)
    for start, fits, shift in ((at - side, at - first >= side, 32), (at, at + gram + side <= first + count + width - 1, 0)):
        start = start[fits]
        hashed = _mixed((sums[start + gram + side] - sums[start]) * _UP[start]) >> np.uint64(32)
        sides[fits] |= np.maximum(hashed, np.uint64(1)) << np.uint64(shift)
    return first, count, h[at], text, at - first, sides


def _slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, text ends, and for each byte its text's number and offset; long texts in overlapping parts."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - WIDTH + 1), SLICE // 2):
            part = t[a : a + SLICE // 2 + WIDTH - 1]
            if len(part) < WIDTH:
                continue
            if size + len(part) > SLICE:
                yield _packed(held)
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield _packed(held)


def _packed(held):
    sizes = np.array([len(p) for _, _, p in held])
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    number = np.repeat([i for i, _, _ in held], sizes)
    offset = np.arange(len(data)) - np.repeat(stops - sizes, sizes) + np.repeat([a for _, a, _ in held], sizes)
    return data, np.repeat(stops, sizes), number, offset


def _all_pieces(batches: Iterator[pa.RecordBatch]):
    """Of rows (doc, tag, text): near, piece, doc, tag, place and sides of each piece, a slice at a time.

    ``place`` is one number: where the piece starts, its windows and the offset of its hash's place.
    """
    for batch in batches:
        for start, n in byte_slices(batch.column("text"), SLICE):
            part = batch.slice(start, n)
            texts = part.column("text").cast(pa.binary()).to_pylist()
            docs, tags = part.column("doc").to_numpy(), part.column("tag").to_numpy()
            for data, ends, number, offset in _slices(texts):
                first, count, place_hash, text_hash, inside, sides = pieces_of(data, ends)
                of = number[first]
                place = (offset[first].astype(np.int64) << 16) | (count << 8) | inside
                yield place_hash.view(np.int64), text_hash.view(np.int64), docs[of], tags[of], place, sides.view(np.int64)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal pieces of a slice as one, with the smallest and largest document."""
    for near, piece, doc, *_ in _all_pieces(batches):
        order = np.lexsort((doc, piece, near))
        near, piece, doc = near[order], piece[order], doc[order]
        opens = np.ones(len(piece), bool)
        opens[1:] = (piece[1:] != piece[:-1]) | (near[1:] != near[:-1])
        start = np.flatnonzero(opens)
        stop = np.append(start[1:], len(piece))[: len(start)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (near[start], piece[start], doc[start], doc[stop])], names=["near", "piece", "first", "last"])


def _places(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pieces whose hash falls into one part of ROUNDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _all_pieces(batches):
            own = (columns[0] & (ROUNDS - 1)) == part
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in columns], names=["near", "piece", "doc", "tag", "place", "sides"])

    return run


def two_stage_sort(text: np.ndarray) -> np.ndarray:
    """Suffix order of ``text`` (small non-negative integers), at least by the first WIDTH places.

    Suffixes smaller than their successors are sorted directly, by packed words
    of their first characters. The others are induced: a scan of the buckets of
    first characters from the smallest on places, for each suffix met, the one
    before it, which is larger, next in its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    t = text.astype(np.int64)
    change = np.flatnonzero(t[1:] != t[:-1])
    after = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    following = np.where(after + 1 < n, t[np.minimum(after + 1, n - 1)], -1)
    smaller = t < following  # at the end of its run of equal characters, the next one is larger
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([t + 1, np.zeros(WIDTH + 8, np.int64)]).astype(np.uint64)
    word = np.zeros(n + WIDTH + 2, np.uint64)
    for k in range(6):
        word |= padded[k : k + len(word)] << np.uint64(10 * (5 - k))
    direct = direct[np.argsort(word[direct], kind="stable")]
    tied = word[direct][1:] == word[direct][:-1]
    group = np.concatenate([[0], np.cumsum(~tied)])
    for k in range(6, WIDTH, 6):  # only suffixes that are still equal to a neighbour are sorted further
        open_ = np.flatnonzero(np.concatenate([tied, [False]]) | np.concatenate([[False], tied]))
        if not len(open_):
            break
        more = word[direct[open_] + k]
        by = np.lexsort((more, group[open_]))
        direct[open_], more = direct[open_[by]], more[by]
        same = (more[1:] == more[:-1]) & (group[open_][1:] == group[open_][:-1])
        tied[:] = False
        tied[open_[1:][same] - 1] = True
        group[open_] = np.concatenate([[0], np.cumsum(~same)]) + group[open_[0]]

    top = int(t.max()) + 1
    head = np.searchsorted(t[direct], np.arange(top + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(top)]
    out = []

    def hand_on(found: np.ndarray) -> np.ndarray:
        """Put the larger predecessors of sorted suffixes into their buckets; return those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        c = t[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else []
        same = np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(c)).astype(int) if len(c) else [], strict=True):
            if c[a] == bucket:
                same = before[a:b]
            else:
                induced[c[a]].append(before[a:b])
        return same

    for bucket in range(top):
        if bucket == t[n - 1]:
            induced[bucket].insert(0, np.array([n - 1]))
        wave = np.concatenate(induced[bucket]) if induced[bucket] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = hand_on(wave)
        mine = direct[head[bucket] : head[bucket + 1]]
        out.append(mine)
        hand_on(mine)
        induced[bucket] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Length, up to ``most``, that each suffix in ``order`` shares with the one before it."""
    padded = np.concatenate([text.astype(np.int64), -1 - np.arange(most)])
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(most):
        live = live[padded[order[live] + k] == padded[order[live - 1] + k]]
        if not len(live):
            break
        shared[live] += 1
    return shared


def earlier_windows(pieces: pd.DataFrame) -> pd.DataFrame:
    """Of pieces (near, doc, tag, at, bytes): the windows (doc, tag, at) that also start in a smaller document."""
    parts = pieces["bytes"].tolist()
    sizes = np.array([len(p) for p in parts]) + 1
    stops = np.cumsum(sizes)
    text = np.zeros(int(stops[-1]), np.int16)
    own = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(text)) - np.repeat(stops - sizes, sizes)
    text[inside < (sizes - 1)[own]] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    order = two_stage_sort(text)
    order = order[inside[order] + WIDTH <= (sizes - 1)[own[order]]]
    group = np.cumsum(common_prefixes(text, order) < WIDTH) - 1
    docs = pieces["doc"].to_numpy()[own[order]]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs)
    hit = order[docs > least[group]]
    return pd.DataFrame(
        {
            "doc": pieces["doc"].to_numpy()[own[hit]],
            "tag": pieces["tag"].to_numpy()[own[hit]],
            "at": (pieces["at"].to_numpy()[own[hit]] + inside[hit]).astype(np.int32),
            "windows": np.ones(len(hit), np.int16),
        }
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the pieces (places, nears, crowds) of each text; pieces of a crowd as single windows."""
    names = ["near", "doc", "tag", "at", "crowd", "bytes"]
    for batch in batches:
        for start, n in byte_slices(batch.column("text"), SLICE):
            part = batch.slice(start, n)
            lists = [part.column(c) for c in ("places", "nears", "crowds")]
            counts = np.diff(lists[0].offsets.to_numpy())
            place, near, crowd = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            at, windows = place >> 16, (place >> 8) & 255
            times = np.where(crowd, windows, 1)
            which = np.repeat(np.arange(len(place)), times)
            at = at[which] + (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times))
            stop = at + np.where(crowd, 1, windows)[which] + WIDTH - 1
            text = np.repeat(np.arange(n), counts)[which]
            texts = part.column("text").cast(pa.binary()).to_pylist()
            cut = [texts[i][a:b] for i, a, b in zip(text.tolist(), at.tolist(), stop.tolist(), strict=True)]
            doc, tag = (part.column(c).to_numpy()[text] for c in ("doc", "tag"))
            columns = [pa.array(near[which]), pa.array(doc), pa.array(tag), pa.array(at.astype(np.int32)), pa.array(crowd[which]), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _worth_comparing(owned: DataFrame) -> DataFrame:
    """Pieces that agree with one of another document on the side before or after their place.

    A window is at most as long as GRAM and two SIDEs, so two pieces that share
    one agree on a whole SIDE before or after.
    """
    out = owned
    for side, of in (("before", F.expr("sides >>> 32")), ("after", F.expr("sides & 4294967295"))):
        out = out.withColumn(side, of)
        shared = owned.withColumn(side, of).where(F.col(side) != 0).groupBy("near", side).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a != b")
        out = out.join(shared.select("near", side, F.lit(True).alias(f"met_{side}")), ["near", side], "left")
    return out.where("met_before or met_after").select("near", "doc", "tag", "place")


def _repeated_in_crowds(windows: DataFrame) -> DataFrame:
    """Of single windows (doc, tag, at, bytes): those that also start in a smaller document. Equal ones are counted before the shuffle."""
    firsts = windows.groupBy("bytes").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last")
    again = windows.join(firsts.select("bytes", "first"), "bytes").where("doc > first")
    return again.select("doc", "tag", "at", F.lit(1).cast("short").alias("windows"))


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, doc, tag, at, windows in batch[["text", "doc", "tag", "ats", "ns"]].itertuples(index=False):
            data = np.frombuffer(text.encode(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, np.asarray(at, np.int64) + np.asarray(windows, np.int64) + WIDTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((doc, tag, int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc", "tag", "n_removed", "n_spans", "kept_sha256"])


def repeated_strings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    A null text is empty. Rows with a null id come after all others; rows of
    equal id are never smaller than each other, so repeated rows are not
    removed for each other's sake. Texts under WIDTH bytes lose nothing.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("long"), last).alias("doc"), whole.alias("text"))
    known = stage(
        rows.select("id", "doc", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "repeats-docs"
    )
    repeated = not known.groupBy("doc").count().where("count > 1").isEmpty()
    # rows of equal id are told apart by their texts; where there are none, the tag is 0 and costs nothing to shuffle
    known_tag, text_tag = (F.xxhash64("sha"), F.xxhash64(F.sha2("text", 256))) if repeated else (F.lit(0).cast("long"),) * 2
    firsts = stage(known.groupBy("sha").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")), "repeats-firsts")
    copies = known.join(firsts.where("copies > 1"), "sha").where("doc > first").select("doc", known_tag.alias("tag"))
    long_enough = rows.where(F.octet_length("text") >= WIDTH).withColumn("tag", text_tag).select("doc", "tag", "text")
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(8, int(total // (16 << 20)))

    counted = long_enough.mapInArrow(_owners, "near long, piece long, first long, last long")
    by_near = Window.partitionBy("near")
    owners = (
        counted.repartition(parts, "near")
        .groupBy("near", "piece")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("variants", (F.min("piece").over(by_near) != F.max("piece").over(by_near)) & (F.min("first").over(by_near) != F.max("last").over(by_near)))
        .where("variants or first != last")
        .drop("last")
    )
    owners = stage(owners, "repeats-owners")

    mine = (F.col("doc") == F.col("first")) & F.col("variants")
    found = [
        stage(
            long_enough.mapInArrow(_places(part), "near long, piece long, doc long, tag long, place long, sides long")
            .join(owners, ["near", "piece"])
            .where("doc > first or variants")
            .select("doc", "tag", "place", F.when(mine, F.col("near")).alias("near"), F.when(mine, F.col("sides")).alias("sides")),
            "repeats-found",
        )
        for part in range(ROUNDS)
    ]
    drop(owners)
    every = functools.reduce(DataFrame.union, found)

    close = stage(_worth_comparing(every.where("near is not null")), "repeats-close")
    crowds = stage(close.groupBy("near").count().where(F.col("count") > CROWD).select("near", F.lit(True).alias("crowd")), "repeats-crowds")
    # an owner's piece stands in one document, so copies of that document hold none
    of_doc = close.join(crowds, "near", "left").groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "near", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("x"))
    texts = long_enough.join(of_doc, ["doc", "tag"]).select("doc", "tag", "text", F.col("x.place").alias("places"), F.col("x.near").alias("nears"), F.col("x.crowd").alias("crowds"))
    cut = stage(texts.mapInArrow(_cut, "near long, doc long, tag long, at int, crowd boolean, bytes binary"), "repeats-texts")
    drop(close, crowds)
    alone = cut.where(~F.col("crowd"))
    arrays = max(8, int((alone.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // ARRAY_BYTES))
    compared = (
        alone.withColumn("array", F.pmod("near", F.lit(arrays)))
        .repartition(max(8, arrays // 4), "array")
        .groupBy("array")
        .applyInPandas(earlier_windows, "doc long, tag long, at int, windows short")
    )
    windows = compared.union(_repeated_in_crowds(cut.where("crowd"))).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "windows")).alias("found"))
    windows = stage(windows, "repeats-windows")
    drop(cut)
    sure = (
        every.where("near is null")
        .select("doc", "tag", F.struct(F.expr("int(place >> 16)").alias("at"), F.expr("smallint((place >> 8) & 255)").alias("windows")).alias("x"))
        .groupBy("doc", "tag")
        .agg(F.collect_list("x").alias("found"))
    )
    removed = sure.union(windows).groupBy("doc", "tag").agg(F.flatten(F.collect_list("found")).alias("found")).join(copies, ["doc", "tag"], "left_anti")
    removed = stage(removed, "repeats-removed")
    drop(windows, *found)
    kept = (
        long_enough.join(removed, ["doc", "tag"])
        .select("text", "doc", "tag", F.col("found.at").alias("ats"), F.col("found.windows").alias("ns"))
        .mapInPandas(_kept, "doc long, tag long, n_removed long, n_spans long, kept_sha256 string")
    )
    kept = stage(kept.dropDuplicates(["doc", "tag"]), "repeats-kept")  # repeated rows
    drop(removed)

    again = F.col("doc") > F.col("first")
    gone: Column = again & (F.col("n_bytes") >= WIDTH)
    return (
        known.join(firsts.select("sha", "first"), "sha")
        .withColumn("tag", known_tag)
        .join(kept, ["doc", "tag"], "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(documents(spark, sf_dir))
