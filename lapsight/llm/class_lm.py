"""Language-model scoring with classes of words (Brown's class bigrams).

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Every training word gets a
class by the exchange criterion, the likelihood of the class bigrams: the most
frequent words, the core, in rounds of single exchanges over their own bigram
counts; then each other word, in one step in parallel, the class that gains
most, given the counts of the core's classes before and after all its
occurrences. Classes and core grow with the vocabulary (``sizes``). Transitions
and emissions are counted over the whole training text with the final classes.

Texts are numbered once, in batches of bounded size that hold each distinct
word once; later steps read numbers. Words go from the batches to buckets by
hash, where all occurrences of a word meet as one entry per batch, and their
classes and counts come back by batch.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, drop, stage

#: The core has so many words for each class; classes are half the cube root of the number of training words, or LEAST_CLASSES.
CORE_PER_CLASS = 16
LEAST_CLASSES = 8
ROUNDS = 6
ADD = 0.1
BATCH_BYTES = 4 << 20
#: Bytes of numbers, four to a word of the corpus, for each bucket.
BUCKET_BYTES = 4 << 20
#: Contexts seen up to so many times have their gains in a table.
TABLED = 8
WORDS_AT_ONCE = 2000
#: The end of a text; no word is empty. It has the number 0 in each batch.
END = b""

BATCHES = "batch long, id array<string>, held array<boolean>, length array<int>, words array<binary>, n array<int>, codes binary"
PARCELS = "bucket int, batch long, number binary, words array<binary>, n binary, entries binary, context binary, seen binary"
ANSWERS = "batch long, number binary, label binary, c binary, sums array<long>"
SCORED = "id string, held_out boolean, n_tokens long, n_known long, base_score double, emission double, path binary, cell array<long>, n array<long>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, without the end."""
    return text.encode().lower().split()


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def sizes(words: int) -> tuple[int, int]:
    """Number of classes and of core words for a vocabulary of ``words``; the driver holds the square of the core."""
    classes = max(LEAST_CLASSES, round(words ** (1 / 3) / 2))
    return classes, classes * CORE_PER_CLASS


def number_texts(rows: DataFrame) -> DataFrame:
    """Batches of rows (id, held_out, text): ids, distinct words with their training counts, and the words of all texts by number.

    Rows are taken as they come, so no batch grows with the frequency of a
    text. Each text is its words' numbers and the end.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = count(TaskContext.get().partitionId() << 32)
        held: list[tuple[str | None, bool, str]] = []
        size = 0
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("id", "held_out", "text")), strict=True):
                if held and size + len(row[2]) > BATCH_BYTES:
                    yield _numbered(next(made), held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield _numbered(next(made), held)

    return rows.select("id", "held_out", "text").mapInArrow(run, BATCHES)


def _numbered(batch: int, rows: list[tuple[str | None, bool, str]]) -> pa.RecordBatch:
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    number[END] = 0
    of = number.__getitem__
    texts = [np.fromiter(map(of, [*tokens(text), END]), np.int32) for _, _, text in rows]
    ids, held, _ = zip(*rows, strict=True)
    n = np.bincount(np.concatenate([x for x, h in zip(texts, held, strict=True) if not h] or [np.zeros(0, np.int32)]), minlength=len(number))
    one = lambda x, t: pa.array([x], t)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([batch]),
            one(ids, pa.list_(pa.string())),
            one(held, pa.list_(pa.bool_())),
            one([len(x) for x in texts], pa.list_(pa.int32())),
            one(list(number), pa.list_(pa.binary())),
            one(n.astype(np.int32), pa.list_(pa.int32())),
            one(_pack(np.concatenate(texts)), pa.binary()),
        ],
        names=["batch", "id", "held", "length", "words", "n", "codes"],
    )


def _training_codes(row: dict) -> np.ndarray:
    """The numbers of all training texts of a batch one after the other, an end before the first."""
    codes = _unpack(row["codes"], np.int32)
    own = np.repeat(~np.array(row["held"], bool), row["length"])
    return np.concatenate([np.zeros(1, np.int32), codes[own]])


def _each(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, so that one batch at a time is held as Python values."""
    for part in parts:
        for i in range(part.num_rows):
            yield part.slice(i, 1).to_pylist()[0]


def core_bigrams(batches: DataFrame, core: dict[bytes, int]) -> np.ndarray:
    """Counts of neighbours over all training texts: core words, all other words as one, and the end."""
    rest, edge = len(core), len(core) + 1
    n = edge + 1
    shared = batches.sparkSession.sparkContext.broadcast(core)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(n * n, np.int64)
        for row in _each(parts):
            unit = np.array([own.get(w, rest) for w in row["words"]], np.int64)
            unit[0] = edge
            x = unit[_training_codes(row)]
            total += np.bincount(x[:-1] * n + x[1:], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    sums = batches.select("words", "codes", "held", "length").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n * n, np.int64)
    counts[sums["pair"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return counts.reshape(n, n)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(counts: np.ndarray, classes: int, rounds: int = ROUNDS, fixed: int = 1) -> np.ndarray:
    """A class for each unit; the last ``fixed`` units stay alone, in classes of their own after the others.

    Units start in turn by frequency. Each in turn leaves its class and goes
    where the likelihood of the class bigrams is largest; ties go to the class
    with the smaller number. Ends when no unit moves.
    """
    n = len(counts)
    c = counts.astype(float)
    by_count = np.argsort(-(c.sum(axis=1) + c.sum(axis=0))[: n - fixed], kind="stable")
    label = np.zeros(n, np.int64)
    label[by_count] = np.arange(n - fixed) % classes
    label[n - fixed :] = classes + np.arange(fixed)
    k = classes + fixed
    member = np.zeros((n, k))
    member[np.arange(n), label] = 1
    table = member.T @ c @ member
    for _ in range(rounds):
        moved = 0
        for u in by_count:
            old, self_ = label[u], c[u, u]
            member[u, old] = 0
            out, into = c[u] @ member, c[:, u] @ member
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= self_
            if not (out.any() or into.any() or self_):
                new = old
            else:
                row, column = table.sum(axis=1) + into, table.sum(axis=0) + out
                before = _entropy(table)
                after, ahead = np.flatnonzero(out), np.flatnonzero(into)
                gain = (_entropy(table[:, after] + out[after]) - before[:, after]).sum(axis=1)
                gain += (_entropy(table[ahead] + into[ahead, None]) - before[ahead]).sum(axis=0)
                d = table.diagonal()
                gain += _entropy(d + out + into + self_) - _entropy(d + out) - _entropy(d + into) + _entropy(d)
                gain -= _entropy(row + out.sum() + self_) - _entropy(row) + _entropy(column + into.sum() + self_) - _entropy(column)
                new = int(np.argmax(gain[:classes]))
            label[u] = new
            member[u, new] = 1
            table[new] += out
            table[:, new] += into
            table[new, new] += self_
            moved += new != old
        if not moved:
            break
    return label


@dataclass
class Core:
    """Core words with their classes, and the bigram counts of classes; the class ``classes`` holds all other words, the next one the end."""

    label: dict[bytes, int]
    table: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.table) - 2


def fit_core(batches: DataFrame, vocabulary: DataFrame) -> Core:
    """``vocabulary`` has the training words and their counts (word, c). Ties of frequency go by the words' bytes."""
    words = vocabulary.where(F.octet_length("word") > 0)
    classes, most = sizes(words.count())
    top = [bytes(r[0]) for r in words.orderBy(F.desc("c"), "word").limit(most).select("word").collect()]
    counts = core_bigrams(batches, {w: i for i, w in enumerate(top)})
    label = exchange(counts, classes, fixed=2)
    member = np.eye(classes + 2)[label]
    return Core({w: int(label[i]) for i, w in enumerate(top)}, member.T @ counts @ member)


def parcels(batches: DataFrame, core: Core, buckets: int) -> DataFrame:
    """Each batch's words by bucket, with training counts; other words than the core's also with the classes before and after them."""
    shared = batches.sparkSession.sparkContext.broadcast(core)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = shared.value, shared.value.classes + 2
        for row in _each(parts):
            words = row["words"]
            label = np.array([own.label.get(w, k - 2) for w in words], np.int64)
            label[0] = k - 1
            codes = _training_codes(row)
            around, other = label[codes], np.flatnonzero(label[codes] == k - 2)  # neither the first nor the last, which are ends
            pairs = np.concatenate([codes[other] * (2 * k) + around[other + 1], codes[other] * (2 * k) + k + around[other - 1]])
            pairs, seen = np.unique(pairs, return_counts=True)
            of, context = pairs // (2 * k), pairs % (2 * k)
            entries = np.bincount(of, minlength=len(words))
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.cumsum(entries) - entries
            each = entries[order]
            at = np.repeat(starts[order] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            context, seen = context[at].astype(np.int32), seen[at].astype(np.int32)
            n = np.array(row["n"], np.int64)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            upto = np.concatenate([[0], np.cumsum(each)])
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                i = order[cuts[b] : cuts[b + 1]]
                span = slice(upto[cuts[b]], upto[cuts[b + 1]])
                blobs = (n[i], entries[i].astype(np.int32), context[span], seen[span])
                rows.append((int(b), row["batch"], _pack(i.astype(np.int32)), [words[j] for j in i], *map(_pack, blobs)))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "batch", "number", "words", "n", "entries", "context", "seen"])

    return batches.select("batch", "words", "n", "codes", "held", "length").mapInArrow(run, PARCELS)


def best_classes(core: Core, of: np.ndarray, context: np.ndarray, seen: np.ndarray, words: int) -> np.ndarray:
    """The class with the largest gain for each of ``words`` words; entries (of, context, seen) are sorted by word.

    A context is the class after the word or, from ``classes`` + 2 on, the class
    before it. A word without entries gets class 0.
    """
    classes, k = core.classes, core.classes + 2
    near = np.concatenate([core.table[:classes].T, core.table[:, :classes]])  # by context, then class
    row, column = core.table.sum(axis=1)[:classes], core.table.sum(axis=0)[:classes]
    base = _entropy(near)
    tabled = np.stack([np.zeros_like(near), *(_entropy(near + o) - base for o in range(1, TABLED + 1))])
    out = np.zeros(words, np.int64)
    bounds = np.searchsorted(of, np.arange(0, words + WORDS_AT_ONCE, WORDS_AT_ONCE))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a == b:
            continue
        w, x, o = of[a:b] - i * WORDS_AT_ONCE, context[a:b], seen[a:b]
        gain = tabled[np.minimum(o, TABLED), x]
        often = np.flatnonzero(o > TABLED)
        gain[often] = _entropy(near[x[often]] + o[often, None]) - base[x[often]]
        opens = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        total = np.add.reduceat(gain, opens)
        after = np.add.reduceat(np.where(x < k, o, 0), opens)[:, None]
        before = np.add.reduceat(np.where(x < k, 0, o), opens)[:, None]
        total -= _entropy(row + after) - _entropy(row) + _entropy(column + before) - _entropy(column)
        out[i * WORDS_AT_ONCE + w[opens]] = total.argmax(axis=1)
    return out


def _assigner(core_of: Callable[[], Core]) -> Callable[[pa.Table], pa.Table]:
    """All parcels of a bucket to each batch's answers (number, label, c), and the bucket's sums by class: tokens, words, words seen once."""

    def run(table: pa.Table) -> pa.Table:
        core = core_of()
        classes, k = core.classes, core.classes + 2
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        of = [np.fromiter(map(index.__getitem__, words.as_py()), np.int64) for words in table.column("words")]
        blobs = {c: [_unpack(x.as_py(), t) for x in table.column(c)] for c, t in (("number", np.int32), ("n", np.int64), ("entries", np.int32), ("context", np.int32), ("seen", np.int32))}
        words = len(index)
        c = np.zeros(words, np.int64)
        np.add.at(c, np.concatenate(of), np.concatenate(blobs["n"]))
        keys = np.repeat(np.concatenate(of), np.concatenate(blobs["entries"])) * (2 * k) + np.concatenate(blobs["context"])
        keys, at = np.unique(keys, return_inverse=True)
        seen = np.zeros(len(keys), np.int64)
        np.add.at(seen, at, np.concatenate(blobs["seen"]))
        label = best_classes(core, keys // (2 * k), keys % (2 * k), seen, words)
        for word, i in index.items():
            if word == END:
                label[i] = classes
            elif word in core.label:
                label[i] = core.label[word]
        label[c == 0] = -1
        sums = [np.bincount(label[keep], weights=x[keep], minlength=classes + 1) for x, keep in ((c, c > 0), (np.ones(words), c > 0), (np.ones(words), c == 1))]
        answers = [table.column("batch").to_pylist(), [_pack(x) for x in blobs["number"]], [_pack(label[x].astype(np.int32)) for x in of], [_pack(c[x]) for x in of]]
        columns = [[*x, end] for x, end in zip(answers, (-1, None, None, None), strict=True)]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        lists = [*[None] * len(of), np.concatenate(sums).astype(np.int64).tolist()]
        return pa.table([pa.array(x, t) for x, t in zip([*columns, lists], kinds, strict=True)], names=["batch", "number", "label", "c", "sums"])

    return run


@dataclass
class Model:
    """Sizes of the classes, the end's last; ``unknown`` is the class of words that training has not seen, which has one such word."""

    class_tokens: np.ndarray
    class_words: np.ndarray
    unknown: int

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def words(self) -> int:
        return int(self.class_words.sum())

    def emission(self, c: np.ndarray, label: np.ndarray) -> np.ndarray:
        slots = self.class_words + (np.arange(len(self.class_words)) == self.unknown)
        return np.log10((c + ADD) / (self.class_tokens + ADD * slots)[label])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.tokens + ADD * (self.words + 1)))


def _sums(rows: DataFrame, at: str, n: int) -> np.ndarray:
    """Sums by place of an array column, or of n by cell; ``n`` places at most come to the driver."""
    found = rows.groupBy(at).agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n, np.int64)
    for r in found:
        out[r[0]] = r[1]
    return out


def model_of(answers: DataFrame, classes: int) -> Model:
    """New words are taken to be of the class that holds most words seen once."""
    n = classes + 1
    sums = _sums(answers.where("batch = -1").select(F.posexplode("sums").alias("pos", "n")), "pos", 3 * n).reshape(3, n)
    return Model(sums[0], sums[1], int(sums[2, :classes].argmax()))


def walk(batches: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """Per document its token counts, base score, emissions and path of classes; per batch the training texts' transitions (cell, n)."""
    shared = batches.sparkSession.sparkContext.broadcast(model)
    k = len(model.class_tokens)
    kind = np.uint8 if k <= 256 else np.uint16 if k <= 65536 else np.uint32

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for row in _each(parts):
            number = np.concatenate([_unpack(x["number"], np.int32) for x in row["found"]])
            label, c = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            label[number] = np.concatenate([_unpack(x["label"], np.int32) for x in row["found"]])
            c[number] = np.concatenate([_unpack(x["c"], np.int64) for x in row["found"]])
            label[label < 0] = m.unknown
            label[0] = k - 1  # the end, though training may have no text
            codes, length = _unpack(row["codes"], np.int32), np.array(row["length"])
            starts = np.cumsum(length) - length
            path = label[codes]
            of_text = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            base, emission = of_text(m.base(c)[codes]), of_text(m.emission(c, label)[codes])
            cells = np.concatenate([[k - 1], path[:-1]]) * k + path  # every text ends with the end, which stands before the next
            cell, n = np.unique(cells[np.repeat(~np.array(row["held"], bool), length)], return_counts=True)
            steps = path.astype(kind)
            size = len(length)
            columns = [
                [*row["id"], None], [*row["held"], None], [*length.tolist(), None], [*of_text((c > 0)[codes].astype(np.int64)).tolist(), None], [*base.tolist(), None], [*emission.tolist(), None],
                [*(steps[a : a + b].tobytes() for a, b in zip(starts.tolist(), length.tolist(), strict=True)), None], [*[None] * size, cell.tolist()], [*[None] * size, n.tolist()],
            ]
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=SCORED.replace(",", "").split()[::2])

    found = answers.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("number", "label", "c")).alias("found"))
    return batches.select("batch", "id", "held", "length", "codes").join(found, "batch").drop("batch").mapInArrow(run, SCORED)


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), every count raised by ADD."""
    table = counts + ADD
    return np.log10(table / table.sum(axis=1, keepdims=True))


def add_transitions(walked: DataFrame, steps: np.ndarray) -> DataFrame:
    k = len(steps)
    kind = np.uint8 if k <= 256 else np.uint16 if k <= 65536 else np.uint32
    shared = walked.sparkSession.sparkContext.broadcast(steps)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in parts:
            sums = []
            for x in part.column("path"):
                path = np.frombuffer(x.as_buffer(), kind).astype(np.int64)
                sums.append(float(table[np.concatenate([[k - 1], path[:-1]]), path].sum()))
            score = np.array(sums, float) + part.column("emission").to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = walked.where("path is not null").select("id", "held_out", "n_tokens", "n_known", "base_score", "emission", "path")
    return rows.mapInArrow(run, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the contract's columns.

    A null text is empty and has one token, its end. A null id is a training
    row. An empty corpus gives no rows; with no training text every token is
    unknown.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), whole.alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    # small row groups: a row is a batch
    batches = stage(number_texts(rows), "lm-batches", **{"parquet.block.size": 4 * BATCH_BYTES})
    said = batches.select(F.inline(F.arrays_zip(F.col("words").alias("word"), "n"))).where("n > 0")
    vocabulary = stage(said.groupBy("word").agg(F.sum("n").alias("c")), "lm-vocabulary")
    core = fit_core(batches, vocabulary)
    drop(vocabulary)
    tokens_ = batches.agg(F.sum(F.expr("aggregate(length, 0L, (a, x) -> a + x)"))).first()[0] or 0
    buckets = max(8, int(4 * tokens_ // BUCKET_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(core)
    assign = _assigner(lambda: shared.value)
    answers = stage(parcels(batches, core, buckets).groupBy("bucket").applyInArrow(assign, ANSWERS), "lm-answers", **{"parquet.block.size": 4 * BATCH_BYTES})
    model = model_of(answers, core.classes)
    walked = stage(walk(batches, answers, model), "lm-walked")
    drop(batches, answers)
    k = core.classes + 1
    counts = _sums(walked.where("cell is not null").select(F.inline(F.arrays_zip("cell", "n"))), "cell", k * k).reshape(k, k)
    scored = add_transitions(walked, transitions(counts))
    return scored.select(
        F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
