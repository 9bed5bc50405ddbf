"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text's lattice has an edge for every piece of the vocabulary that spells a
substring. Forward filtering sums the probabilities of all ways to each place;
backward sampling draws one path from the end, so each segmentation comes with
its probability under the pieces. Pieces never cross into the next word, so the
lattice falls apart into words: forward sums are computed once for each
distinct word of a batch, and all words of a batch step through them together.
Random numbers depend on the row key, the word's place and the step only.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, map_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A merge rank r becomes a weight (r + ZIPF_OFFSET) ** -ZIPF_POWER; the vocabulary's scores are ranks, not probabilities.
ZIPF_OFFSET = 3.0
ZIPF_POWER = 1.0
#: Weight of spelling one character in bytes, used only where no piece spells it.
BYTES_WEIGHT = 1e-6
BLANK = 0x2581
#: Stands for a character 0x2581 of the text itself, which is spelled in bytes.
LITERAL_BLANK = 0x110000
#: Words up to here step together; longer ones are sampled one by one.
SHORT = 40
#: Characters that step together.
SLICE = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """The pieces of one vocabulary, as tables for looking up substrings."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int32)
        pieces: dict[str, int] = {}
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(text[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(text[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[text] = i
                self.bytes_of[i] = text.replace("▁", " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary needs all 256 byte pieces")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece crosses into the next word")
        by_score = sorted(pieces.values(), key=lambda i: (-sp.get_score(i), i))
        self.weight = np.zeros(n)
        self.weight[by_score] = (np.arange(len(by_score)) + ZIPF_OFFSET) ** -ZIPF_POWER
        self.weight /= self.weight.sum()
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.joins = np.zeros(LITERAL_BLANK + 1, bool)  # characters that stand in pieces of two or more
        for p in pieces:
            if len(p) > 1:
                self.joins[[ord(c) for c in p]] = True
        self.prefixes: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            starts = sorted({p[:size] for p in pieces if len(p) >= size})
            codes = np.array([[ord(c) for c in p] for p in starts], np.uint64)
            h = np.zeros(len(starts), np.uint64)
            for k in range(size):
                h = h * _ODD + codes[:, k] + np.uint64(1)
            ids = np.array([pieces.get(p, -1) for p in starts], np.int32)
            order = np.argsort(h)
            self.prefixes.append((h[order], ids[order]))

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none, -2: in bytes) and weights of the pieces from each place, by length; left: characters to the word's end."""
        ids = np.full((self.longest, len(codes)), -1, np.int32)
        weight = np.zeros((self.longest, len(codes)))
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for size in range(1, self.longest + 1):
            fits = left[at] >= size
            at, h = at[fits], h[fits] * _ODD + codes[at[fits] + size - 1].astype(np.uint64) + np.uint64(1)
            table, of = self.prefixes[size - 1]
            k = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[k] == h
            at, h, found = at[hit], h[hit], of[k[hit]]
            whole = found >= 0
            ids[size - 1, at[whole]] = found[whole]
            weight[size - 1, at[whole]] = self.weight[found[whole]]
        none = ids[0] < 0
        ids[0, none], weight[0, none] = -2, BYTES_WEIGHT
        return ids, weight

    def sample_long(self, word: np.ndarray, key: np.uint64) -> list[tuple[int, int]]:
        """(start, id) from the end, of one long word; only the forward sums are kept."""
        text = "".join("￾" if c == LITERAL_BLANK else chr(c) for c in word.tolist())
        n, get, weight = len(text), self.pieces.get, self.weight
        logs = np.full(n + 1, -np.inf)
        logs[0] = 0.0

        def into(end: int) -> tuple[list[int], list[float]]:
            sizes, values = [], []
            for size in range(1, min(self.longest, end) + 1):
                i = get(text[end - size : end])
                if i is not None or size == 1:
                    sizes.append(size)
                    values.append(logs[end - size] + float(np.log(BYTES_WEIGHT if i is None else weight[i])))
            return sizes, values

        for end in range(1, n + 1):
            logs[end] = np.logaddexp.reduce(into(end)[1])
        out, end, step = [], n, 0
        while end:
            sizes, values = into(end)
            upto = np.cumsum(np.exp(np.array(values) - logs[end]))
            r = uniform(np.array([key]), step)[0] * upto[-1]
            size = sizes[min(int(np.searchsorted(upto, r, side="right")), len(sizes) - 1)]
            i = get(text[end - size : end])
            out.append((end - size, -2 if i is None else i))
            end, step = end - size, step + 1
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """In [0, 1), with 24 bits, from a word's key and the step."""
    draw = mixed(keys + np.uint64((step + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    return ((draw >> np.uint64(40)).astype(np.float64) / (1 << 24)).astype(np.float32)


@lru_cache(maxsize=2)
def lattice(model: bytes) -> Lattice:
    return Lattice(model)


def encode(texts: list[str], keys: np.ndarray, tables: Lattice) -> list[np.ndarray]:
    """Ids of each text, sampled under its key."""
    whole = "".join(" " + t for t in texts if t)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
    codes[codes == BLANK] = LITERAL_BLANK
    codes[codes == 0x20] = BLANK
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    if not len(codes):
        return [np.zeros(0, np.int32) for _ in texts]
    blank, alone = codes == BLANK, ~tables.joins[codes]
    opens = np.ones(len(codes), bool)
    opens[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
    opens[starts[lengths > 0]] = True
    word_start = np.flatnonzero(opens)
    word_size = np.diff(np.append(word_start, len(codes)))
    of_text = np.searchsorted(starts[lengths > 0], word_start, side="right") - 1
    first_word = np.searchsorted(word_start, starts[lengths > 0])
    place = (np.arange(len(word_start)) - first_word[of_text]).astype(np.uint64)
    word_key = mixed(keys[lengths > 0].astype(np.int64).view(np.uint64)[of_text] + mixed(place * _ODD))

    out = np.full(len(codes), -1, np.int32)
    cuts = np.searchsorted(word_start, np.arange(0, len(codes), SLICE)).tolist() + [len(word_start)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        short = np.arange(a, b)[word_size[a:b] <= SHORT]
        if len(short):
            _sample_short(codes, word_start[short], word_size[short], word_key[short], tables, out)
    for w in np.flatnonzero(word_size > SHORT):
        s = word_start[w]
        for at, i in tables.sample_long(codes[s : s + word_size[w]], word_key[w]):
            out[s + at] = i

    spelled = np.flatnonzero(out == -2)
    utf8 = [("▁" if c == LITERAL_BLANK else chr(c)).encode() for c in codes[spelled].tolist()]
    times = (out != -1).astype(np.int64)
    times[spelled] = [len(x) for x in utf8]
    flat = np.repeat(out, times)
    flat[flat == -2] = tables.byte_id[np.frombuffer(b"".join(utf8), np.uint8)]
    ends = np.concatenate([[0], np.cumsum(times)])
    return [flat[ends[s] : ends[s + n]] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _sample_short(codes, start, size, key, tables: Lattice, out) -> None:
    """Draw a path through each word and put its ids at their places in ``out``."""
    pad = np.arange(int(size.max()))
    salt = mixed(pad.astype(np.uint64) + _ODD) | np.uint64(1)
    offset = np.cumsum(size) - size
    flat = np.arange(int(size.sum())) - np.repeat(offset, size)
    chars = codes[np.repeat(start, size) + flat]
    h = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * salt[flat], offset)
    word, _ = pd.factorize(mixed(h + size.astype(np.uint64) * _ODD))
    first = np.full(word.max() + 1, -1)
    first[word[::-1]] = np.arange(len(word))[::-1]
    same = codes[np.repeat(start[first[word]], size) + np.minimum(flat, np.repeat(size[first[word]] - 1, size))] == chars
    wrong = ~np.logical_and.reduceat(same, offset) | (size != size[first[word]])
    if wrong.any():  # words of equal hash
        word[wrong] = len(first) + np.arange(int(wrong.sum()))
        first = np.concatenate([first, np.flatnonzero(wrong)])
    order = np.argsort(-size[first], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word, first = rank[word], first[order]

    n = size[first]
    at = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(at, n)
    ids, weight = tables.edges(codes[np.repeat(start[first], n) + inside], np.repeat(n, n) - inside)
    sums = np.zeros(len(inside) + len(n))
    zero = at + np.arange(len(n))
    sums[zero] = 1.0
    upto = np.zeros((len(inside), tables.longest), np.float32)
    for t in range(1, int(n.max()) + 1):
        k = int(np.searchsorted(-n, -t, side="right"))
        s, z = at[:k], zero[:k]
        part = np.zeros((k, tables.longest))
        for size_ in range(1, min(t, tables.longest) + 1):
            part[:, size_ - 1] = sums[z + t - size_] * weight[size_ - 1, s + t - size_]
        np.cumsum(part, axis=1, out=part)
        sums[z + t] = part[:, -1]
        upto[s + t - 1] = part / part[:, -1:]

    left, step, active = size.copy(), 0, np.arange(len(word))
    while len(active):
        s = at[word[active]]
        r = uniform(key[active], step)
        took = (upto[s + left[active] - 1] <= r[:, None]).sum(axis=1) + 1
        left[active] -= took
        out[start[active] + left[active]] = ids[took - 1, s + left[active]]
        active, step = active[left[active] > 0], step + 1


def decode(ids: Iterable[int], tables: Lattice) -> str:
    """The text that was encoded: pieces and bytes joined, without the blank put before it."""
    of = tables.bytes_of
    return b"".join([of[i] for i in ids])[1:].decode()


def encode_column(
    docs: DataFrame, model_path: str = MODEL, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns of ``keep`` and ``piece_ids``.

    A null text has null ids, an empty one none. Rows of equal key and text get
    equal ids; a null key is a key like any other. Map only. The vocabulary's
    file is read on the driver and sent along (its size does not depend on the
    data).
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        tables = lattice(shared.value)

        def sample(texts, keys):
            ids = encode([t or "" for t in texts], np.array(keys, np.int64), tables)
            return [[None if t is None else x for t, x in zip(texts, ids, strict=True)]]

        return sample

    inputs = [F.col(text), F.xxhash64(F.col(key).cast("string"))]
    return map_rows(docs, keep, inputs, {"piece_ids": pa.list_(pa.int32())}, start, most_bytes=1 << 20)


def decode_column(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``encoded`` with ``text``, decoded from ``piece_ids``; null ids give null."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def start():
        tables = lattice(shared.value)
        return lambda ids: [[None if x is None else decode(x, tables) for x in ids]]

    return map_rows(encoded, encoded.columns, [F.col("piece_ids")], {"text": pa.string()}, start, most_bytes=1 << 18)


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its sampled piece ids, their number, and the hashes of the text before and after the round trip."""
    docs = documents(spark, sf_dir).withColumn("text_sha256", F.sha2("text", 256))
    back = decode_column(encode_column(docs, keep=("doc_id", "text_sha256")))
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        "text_sha256",
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' ids, without their texts."""
    return encode_column(docs, keep=("doc_id", "lang", "source"))
