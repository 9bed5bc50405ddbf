import random

from lapsight.llm import near_duplicates as n
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(class id, links) by id, over all pairs."""
    by = {}
    for i, t in rows:
        by.setdefault(shingles(t), []).append(i)
    sets = list(by)
    group, links = list(range(len(sets))), [0] * len(sets)

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                group[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for k, s in enumerate(sets):
        least[root(k)] = min([i for i in [*by[s], least.get(root(k))] if i is not None], default=None)
    return {i: (least[root(k)], links[k]) for k, s in enumerate(sets) for i in by[s]}


def test_groups_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for g in range(25):
        base = prose(g, r.randint(8, 200)).split()
        for _ in range(r.randint(1, 6)):
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = "edit" + str(r.random())
            rows.append((len(rows), " ".join(w)))
    out = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_SETS", 90)  # so that the group is split
    base = prose(99, 150).split()
    rows = []
    for i in range(400):
        w = base[:]
        w[i % 150] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(5000 + i, 150)) for i in range(50)]
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute(rows) and all(out[i] == (0, 399) for i in range(400))


def test_pairs_among_many_texts_that_share_a_passage(spark, monkeypatch):
    """All texts are similar at about 0.71; each has one partner above 0.8, which mostly is neither leader nor neighbour."""
    monkeypatch.setattr(n, "BLOCK_SETS", 150)  # so that buckets are split
    passage = prose(7, 150)
    rows = []
    for g in range(300):
        for k in range(2):
            rows.append((len(rows), f"{passage} {prose(1000 + g, 17)} {prose(90000 + 2 * g + k, 13)}"))
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert all(want[2 * g] == (2 * g, 1) for g in range(300)) and out == want


def test_prefix_length():
    assert n.shortest_prefix() == 4 and n.shortest_prefix(0.95) > n.shortest_prefix(0.8) >= n.shortest_prefix(0.5)


def test_edges(spark, docs, rows, empty):
    out = n.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    assert got[2]["class_id"] == 1 and got[3]["class_id"] == 1 and got[12]["class_id"] == 11 and got[13]["class_id"] == 13
    assert got[8]["class_id"] == 8 and got[9]["class_id"] == 8 and got[10]["class_id"] == 8
    kept = n.one_of_each(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    assert {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 6, 7, 8, 11, 13} and not kept.where("doc_id in (2, 3, 9, 10, 12)").count()
    assert n.near_duplicates(empty).count() == 0 and n.one_of_each(spark, empty, "").count() == 0


def test_null_ids_meet_their_own_class(spark):
    from tests.llm.conftest import prose

    base = prose(5, 200).split()
    other = [*base[:199], "end"]
    rows = [(None, " ".join(base)), (None, " ".join(other)), (None, prose(6, 100)), (None, prose(7, 100)), (3, prose(6, 100))]
    out = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in out) == [("3", "3", 0), ("None", "3", 0), ("None", "None", 0), ("None", "None", 1), ("None", "None", 1)]


def test_depths_end_at_the_target_recall():
    found = n.depths()
    assert found[0] == n.DEPTH and found == sorted(found, reverse=True)
    assert 1 - (1 - n.THRESHOLD ** found[-1]) ** n.TREES >= n.TARGET_RECALL
