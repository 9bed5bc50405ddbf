import re
from collections import Counter

from lapsight.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures(docs, rows):
    out = q.judge(docs, keep=("doc_id", "text")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_hosts_shrink_towards_the_prior(spark):
    rows = [("bad", True)] * 400 + [("good", False)] * 400 + [("tiny", True)] * 2 + [("fair", False)] * 300 + [("fair", True)] * 20
    out = {r["host"]: r for r in q.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert out["bad"]["host_rejected"] and not out["good"]["host_rejected"] and not out["tiny"]["host_rejected"]
    assert out["tiny"]["host_rate"] < 1.0 and out["bad"]["host_rate"] > 0.9


def test_rejected_host_takes_its_documents(spark):
    from tests.llm.conftest import prose

    clean = [(i, prose(i, 80), "junk" if i == 0 else "ok") for i in range(40)]
    junk = [(100 + i, "too short", "junk") for i in range(200)]
    out = {r["doc_id"]: r for r in q.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, source string")).collect()}
    assert not out[0]["kept"] and out[0]["host_rejected"] and all(out[i]["kept"] for i in range(1, 40))


def test_stage_and_empty(spark, docs, empty):
    kept = q.keep_good(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    assert {1, 2, 3, 4, 5, 6, 7, 13} <= {r["doc_id"] for r in kept.collect()}
    assert q.judge(empty).count() == 0 and q.keep_good(spark, empty, "").count() == 0


def test_rows_of_one_id_and_helper_names(spark):
    from tests.llm.conftest import prose

    schema = "doc_id long, text string, source string, of int, id int, hash int, host int"
    rows = spark.createDataFrame([(1, prose(1, 90), "s", 1, 2, 3, 4), (1, "bad", "s", 1, 2, 3, 4), (None, prose(2, 90), None, 1, 2, 3, 4)], schema)
    out = q.keep_good(spark, rows, "")
    assert out.dtypes == rows.dtypes
    assert sorted(len(r["text"]) > 10 for r in out.collect()) == [True, True]
