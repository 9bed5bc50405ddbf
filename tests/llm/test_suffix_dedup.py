import hashlib

import numpy as np

from lapsight.llm import suffix_dedup as s
from tests.llm.conftest import prose


def brute(rows):
    rows = sorted(((float("inf") if i is None else i, k, (t or "").encode()) for k, (i, t) in enumerate(rows)), key=lambda r: r[0])
    seen = {}
    for i, _, b in rows:
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    out = []
    for i, k, b in rows:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 49):
            if seen[b[a : a + 50]] < i:
                gone[a : a + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((None if i == float("inf") else i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(map(str, out))


def test_two_stage_sort():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 300)).astype(np.int16)
        order = s.two_stage_sort(t)
        assert sorted(order.tolist()) == list(range(len(t)))
        right = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert [t[i : i + 50].tolist() for i in order] == [t[i : i + 50].tolist() for i in right]
        shared = s.common_prefixes(t, order)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :].tolist(), t[order[k] :].tolist()
            n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, s.WIDTH)


def test_pieces_cover_every_window_once():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 30):
        data = rng.integers(0, alphabet, 3000).astype(np.uint8)
        ends = np.repeat([900, 930, 3000], [900, 30, 2070])
        first, count, _, _, inside, _ = s.pieces_of(data, ends)
        assert (inside >= count - 1).all() and (inside <= s.WIDTH - s.GRAM).all()
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count, strict=True)])
        want = [i for i in range(2951) if i + 50 <= ends[i]]
        assert covered.tolist() == want


def test_equals_brute_force(spark, docs, rows, empty):
    out = s.repeated_strings(docs).collect()
    assert sorted(str(tuple(r)) for r in out) == brute([r[:2] for r in rows])
    assert s.repeated_strings(empty).count() == 0


def test_shared_and_nested_passages(spark):
    p = [prose(100 + i, 30) for i in range(4)]
    rows = [(10, p[0] + p[1]), (5, p[1] + p[2]), (7, p[0][10:] + "é" + p[2]), (1, "ab" * 400), (2, "ba" * 300 + p[3]), (3, p[3] * 3), (4, "x" * 49), (6, "x" * 50), (8, "x" * 120), (9, p[2][:60] * 2), (9, p[2][:60] * 2), (9, p[1])]
    out = s.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in out) == brute(rows)


def test_common_passage_in_many_contexts(spark, monkeypatch):
    """A line shorter than a window, between others in every document: its pieces are a crowd, compared as single windows."""
    line = "the same few words, forty bytes long ok"
    ends = [prose(50 + i, 3) for i in range(4)]
    rows = [(i, f"{prose(1000 + i, 20)} {ends[i % 4]} {line} {ends[i % 3]} {prose(2000 + i, 20)}") for i in range(120)]
    want = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(str(tuple(r)) for r in s.repeated_strings(frame).collect()) == want
    monkeypatch.setattr(s, "CROWD", 10)
    assert sorted(str(tuple(r)) for r in s.repeated_strings(frame).collect()) == want


def test_negative_and_null_ids(spark):
    p = prose(7, 40)
    rows = [(-(1 << 63), p + prose(8, 20)), (None, p), (None, prose(9, 20) + p), ((1 << 63) - 2, p + "x")]
    out = s.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in out) == brute(rows)


def test_long_text_in_slices(spark):
    """A text over SLICE, with a repeat across the place where it is cut."""
    import random

    big = "".join(random.Random(4).choices("abcdefghij ", k=s.SLICE + 200_000))
    got = list(s._slices([big.encode(), b""]))
    assert len(got) > 1
    cut = s.SLICE // 2
    rows = [(1, prose(3, 30) + big[cut - 400 : cut + 300]), (2, big), (3, big[cut - 60 : cut + 60])]
    out = s.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in out) == brute(rows)
