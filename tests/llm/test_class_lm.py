import math
import re
import zlib
from collections import Counter

import numpy as np

from lapsight.llm import class_lm as c


def words(text):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def likelihood(counts, label, k):
    member = np.eye(k)[label]
    table = member.T @ counts @ member
    return c._entropy(table).sum() - c._entropy(table.sum(0)).sum() - c._entropy(table.sum(1)).sum()


def test_exchange_reaches_a_local_optimum():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        counts = rng.integers(0, 6, (14, 14))
        label = c.exchange(counts, 3, 50)
        here = likelihood(counts, label, 4)
        for u in range(13):
            for k in range(3):
                other = label.copy()
                other[u] = k
                assert likelihood(counts, other, 4) <= here + 1e-9
        assert label[-1] == 3


def test_base_score(docs, rows, empty):
    out = c.score_documents(docs).collect()
    assert len(out) == len(rows)
    counts = Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        w = words(r[1])
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(r[0]), held(r[0]), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out]
    assert sorted(got) == sorted(want)
    assert all(r["score"] < 0 for r in out)
    assert c.score_documents(empty).count() == 0


def test_model_beats_single_words(spark):
    import random

    r = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(x for _ in range(40) for x in (r.choice(nouns), r.choice(verbs)))) for i in range(200)]
    out = [x for x in c.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["held_out"]]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out) + 5 * len(out)


def test_best_classes_have_the_largest_gain():
    rng = np.random.default_rng(3)
    core = c.Core({}, rng.integers(0, 50, (6, 6)).astype(float))
    rows = sorted({(int(w), int(x)) for w, x in zip(rng.integers(0, 30, 200), rng.integers(0, 12, 200), strict=True)} - {(7, x) for x in range(12)})
    of, context = (np.array(x) for x in zip(*rows, strict=True))
    seen = rng.integers(1, 20, len(of))
    got = c.best_classes(core, of, context, seen, 30)
    f = c._entropy
    for w in range(30):
        out, into = np.zeros(6), np.zeros(6)
        for x, n in zip(context[of == w], seen[of == w], strict=True):
            (out if x < 6 else into)[x % 6] += n
        t = core.table
        gain = [
            (f(t[k] + out) - f(t[k])).sum() + (f(t[:, k] + into) - f(t[:, k])).sum() - f(t[k].sum() + out.sum()) + f(t[k].sum()) - f(t[:, k].sum() + into.sum()) + f(t[:, k].sum())
            for k in range(4)
        ]
        assert gain[got[w]] >= max(gain) - 1e-9


def test_score_equals_brute_force_over_all_words(spark, docs, rows):
    """Classes of all training words, sums to one after each class, and scores word by word."""
    rows = [r[:2] for r in rows] + [(100 + i, f"{'red' if i % 2 else 'blue'} car {i} drives") for i in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    named = texts.selectExpr("cast(doc_id as string) id", "coalesce(text, '') text").withColumn("held_out", c.held_out(c.F.col("id")))
    batches = c.number_texts(named).cache()
    vocabulary = batches.selectExpr("inline(arrays_zip(words, n))").toDF("word", "n").where("n > 0").groupBy("word").agg(c.F.sum("n").alias("c"))
    core = c.fit_core(batches, vocabulary)
    assert len(core.label) < vocabulary.count()
    answers = c.parcels(batches, core, 4).groupBy("bucket").applyInArrow(c._assigner(lambda: core), c.ANSWERS).cache()
    model = c.model_of(answers, core.classes)
    of = {}
    names = {r["batch"]: r["words"] for r in batches.collect()}
    for r in answers.where("batch >= 0").collect():
        for i, k, n in zip(c._unpack(r["number"], np.int32), c._unpack(r["label"], np.int32), c._unpack(r["c"], np.int64), strict=True):
            assert of.setdefault(bytes(names[r["batch"]][i]), (int(k), int(n))) == (k, n)
    counts = Counter(w.encode() for i, t in rows if not held(i) for w in words(t))
    assert {w: n for w, (k, n) in of.items() if n} == dict(counts)
    assert {of[w][0] for w in counts} <= set(range(core.classes + 1)) and all(k == -1 for k, n in of.values() if not n)

    k = core.classes + 1
    path = lambda t: [max(of[w.encode()][0], -1) if of[w.encode()][1] else model.unknown for w in words(t)]
    table = np.full((k, k), c.ADD)
    for i, t in rows:
        if not held(i):
            p = [k - 1, *path(t)[:-1], k - 1]
            for x, y in zip(p[:-1], p[1:], strict=True):
                table[x, y] += 1
    table /= table.sum(axis=1, keepdims=True)
    slots = Counter(of[w][0] for w in counts)
    said = Counter()
    for w, n in counts.items():
        said[of[w][0]] += n
    slots[model.unknown] += 1
    emission = lambda n, x: (n + c.ADD) / (said[x] + c.ADD * slots[x])
    mass = np.zeros(k)
    for w, n in counts.items():
        mass[of[w][0]] += emission(n, of[w][0])
    mass[model.unknown] += emission(0, model.unknown)
    assert np.allclose(table @ mass, 1)
    want = []
    for i, t in rows:
        p = [k - 1, *path(t)]
        p[-1] = k - 1
        want.append((str(i), round(sum(math.log10(table[x, y] * emission(counts[w.encode()], y)) for x, y, w in zip(p[:-1], p[1:], words(t), strict=True)), 6)))
    got = [(str(r["doc_id"]), round(r["score"], 6)) for r in c.score_documents(texts).collect()]
    assert sorted(got) == sorted(want)


def test_all_held_out_and_repeated_rows(spark):
    held_id = next(i for i in range(100) if held(i))
    out = c.score_documents(spark.createDataFrame([(held_id, "a b"), (held_id, "a b"), (held_id, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
