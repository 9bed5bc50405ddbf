"""Block-Max MaxScore against plain scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lapsight.llm import lexical_search as ls
from tests.llm.conftest import prose, row, SCHEMA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, queries, k=10):
    """(item, rank, id, score) by scoring every document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, all_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(queries):
        scored = []
        for i, b in bags:
            m = 100 - 90 + 90 * b.total() * n // all_terms
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, queries, k=10):
    q = spark.createDataFrame(queries, "item_id long, text string, rank int, term string")
    found = ls.search(ls.build_index(docs), ls.query_terms(q), k)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_packing():
    values = np.array([0, 1, 127, 128, 16383, 16384, 5, 2**40, 0])
    data, end = ls.pack(values)
    assert (ls.unpack(data) == values).all() and end[-1] == len(data)
    assert len(ls.unpack(np.zeros(0, np.uint8))) == 0


def test_terms_are_those_of_the_pattern():
    for text in ["", "a_B-C\x00d 'é'É ß9", "\x7f\x80日本 A1bİİ", "x" * 50_000 + " y"]:
        assert [t.decode() for t in ls.terms_of(text.encode())] == terms(text)


def test_equals_scores_of_all_documents(spark, docs, rows):
    queries = [(1, prose(1, 30)), (2, "one two ONE"), (3, None), (4, ""), (5, "日本語 é"), (6, prose(8, 400)), (7, "nowhere"), (None, prose(3, 10)), (2, "one two ONE"), (8, "a b")]
    got = run(spark, docs, [(*q, 0, "x") for q in queries])
    assert got == plain([(r[0], r[1]) for r in rows], queries)


def test_many_blocks_windows_and_shards(spark, monkeypatch):
    """Lists of many blocks, many shards and more documents than a window, with ties and repeated rows."""
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    many = [(i, " ".join(r.choices(vocabulary, weight, k=r.randint(1, 60)))) for i in range(3000)]
    many += [(i, "w7 w9 w250") for i in range(3000, 3040)] + [many[5], many[5]]
    queries = [(q, " ".join(r.choices(vocabulary, k=r.randint(1, 25)))) for q in range(12)] + [(99, "w7 w9 w250"), (100, "w0")]
    want = plain(many, queries)
    docs = spark.createDataFrame([row(*x) for x in many], SCHEMA)
    asked = [(*q, 0, "x") for q in queries]
    assert run(spark, docs.coalesce(1), asked) == want
    monkeypatch.setattr(ls, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(ls, "QUERIES", 5)
    assert run(spark, docs.repartition(3), asked) == want


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    """A common term's list is hardly unpacked where a rare term decides."""
    n = 40_000
    lengths = np.full(n, 20)
    packed = lambda docs, freqs: ls.pack(np.stack([np.where(np.arange(len(docs)) % ls.BLOCK == 0, 0, np.diff(docs, prepend=0)), freqs], axis=1).ravel())

    def of(docs, freqs, weight):
        data, end = packed(docs, freqs)
        at = np.arange(0, len(docs), ls.BLOCK)
        until = np.minimum(at + ls.BLOCK, len(docs))
        upto = end[1::2][until - 1]
        heads = np.stack([docs[at], docs[until - 1], np.maximum.reduceat(freqs, at), np.diff(upto, prepend=0)], axis=1).astype("<i8").tobytes()
        return ls._List(weight, len(docs), int(freqs.max()), int(docs[0]), heads, data.tobytes(), lengths, n, 20 * n)

    r = np.random.default_rng(2)
    common = of(np.arange(n), np.where(np.arange(n) % 5000 == 0, 9, 1), 100)
    rare = of(np.sort(r.choice(n, 400, replace=False)), np.ones(400, int), 5000)
    docs, scores = ls.best_of_shard([common, rare], np.arange(n))
    assert len(docs) == 10 and len(common.unpacked) < len(common.last) / 2
    every = np.zeros(n, int)
    for x in (common, rare):
        d, s = x.between(0, n)
        every[d] += s
    want = np.lexsort((np.arange(n), -every))[:10]
    assert (docs == want).all() and (scores == every[want]).all()


@pytest.mark.parametrize("which", ["documents", "queries"])
def test_empty_tables(spark, docs, empty, which):
    queries = [(1, "one two", 0, "x")]
    assert run(spark, empty if which == "documents" else docs, queries if which == "documents" else []) == []
