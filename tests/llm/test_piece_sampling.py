from collections import Counter

import numpy as np
import pytest
import sentencepiece

from lapsight.llm import piece_sampling as p
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def tables():
    with open(p.MODEL, "rb") as f:
        return p.Lattice(f.read())


def test_round_trip_and_library(tables):
    texts = ["", "a", " a  b\nc ▁d é", "x" * 300, "日本語 \U0001f600", "   ", "\t\n", "the " + "ab" * 60 + " end", prose(1, 500), "￾▁￾"]
    sp = sentencepiece.SentencePieceProcessor(model_file=p.MODEL)
    for text, ids in zip(texts, p.encode(texts, np.arange(len(texts)), tables), strict=True):
        assert p.decode(ids, tables) == text
        if "▁" not in text and text and not text.startswith(" "):
            assert sp.decode([int(i) for i in ids]) == text


def segmentations(text, tables):
    if not text:
        yield (), 1.0
    for k in range(1, len(text) + 1):
        i = tables.pieces.get(text[:k])
        if i is not None:
            for rest, weight in segmentations(text[k:], tables):
                yield (i, *rest), weight * tables.weight[i]


@pytest.mark.parametrize("word", ["there", "on"])
def test_distribution(tables, word):
    n = 20000
    drawn = Counter(tuple(x.tolist()) for x in p.encode([word] * n, np.arange(n), tables))
    every = dict(segmentations("▁" + word, tables))
    total = sum(every.values())
    assert set(drawn) <= set(every)
    assert max(abs(drawn[s] / n - w / total) for s, w in every.items()) < 0.015


def test_long_words_have_the_same_distribution(tables, monkeypatch):
    n = 3000
    short = Counter(tuple(x.tolist()) for x in p.encode(["there"] * n, np.arange(n), tables))
    monkeypatch.setattr(p, "SHORT", 2)
    long = Counter(tuple(x.tolist()) for x in p.encode(["there"] * n, np.arange(n), tables))
    assert max(abs(short[s] - long[s]) / n for s in short | long) < 0.04


def test_reproducible_and_independent_of_batches(tables):
    texts = [prose(i, 40) for i in range(30)]
    keys = np.arange(30) * 7
    one = p.encode(texts, keys, tables)
    parts = p.encode(texts[:11], keys[:11], tables) + p.encode(texts[11:], keys[11:], tables)
    assert all((a == b).all() for a, b in zip(one, parts, strict=True))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(one, p.encode(texts, keys + 1, tables), strict=True))


def test_columns(spark, docs, empty, rows):
    out = p.decode_column(p.encode_column(docs, keep=("doc_id",))).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert [r["piece_ids"] for r in p.encode_column(docs).where("doc_id = 8").collect()] == [None]
    assert p.encode_documents(spark, empty, "").count() == 0
