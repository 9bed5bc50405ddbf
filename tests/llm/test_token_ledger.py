from lapsight.llm import token_ledger as t

CHANGE = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def totals(ledger):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in ledger.totals().collect()}


def test_deltas_and_idempotence(spark, tmp_path):
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "fr", "v1", None, None)], CHANGE)
    assert ledger.commit("1", first) and not ledger.commit("1", first)
    assert totals(ledger) == {("a", "en", "v1"): (2, 15), (None, "fr", "v1"): (1, 0)}
    second = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10), ("delete", None, "fr", "v1", 0, None)], CHANGE)
    assert ledger.commit("2", second)
    assert totals(ledger) == {("a", "en", "v1"): (1, 12)}


def test_broken_commit_is_written_anew(spark, tmp_path):
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], CHANGE)
    ledger.commit("1", rows)
    [f.unlink() for f in (tmp_path / "ledger/_log").iterdir()]
    assert totals(ledger) == {}
    assert ledger.commit("1", rows) and totals(ledger) == {("a", "en", "v1"): (1, 10)}


def test_counts(docs, rows, empty):
    import re

    import tiktoken

    import base64

    with open(t.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = t.bpe_tokens(docs.select("doc_id", t.word_tokens(docs["text"]).alias("words"), "text")).collect()
    want = [(r[0], len(re.findall(t.WORD, r[1] or "")), len(plain.encode_ordinary(r[1] or ""))) for r in rows]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert t.bpe_tokens(empty.select("doc_id", "text")).count() == 0


def test_query_equals_brute_force(spark):
    out = t.op4_token_ledger(spark, "/root/testdata/sf0.001").where("tokenizer = 'words-1'").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    first = {}
    for d in docs:
        first[d["text"]] = min(d["doc_id"], first.get(d["text"], d["doc_id"]))
    want = {}
    for d in docs:
        if d["doc_id"] == first[d["text"]]:
            n, k = want.get((d["source"], d["lang"]), (0, 0))
            want[d["source"], d["lang"]] = (n + 1, k + len((d["text"] or "").encode().split()))
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in out} == want


def test_unknown_op_is_an_error(spark, tmp_path):
    import pytest

    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    for op in ("upsert", None):
        with pytest.raises(Exception, match="unknown op"):
            ledger.commit("1", spark.createDataFrame([(op, "a", "en", "v1", 10, 0)], CHANGE))
    assert totals(ledger) == {}


def test_bpe_totals_equal_brute_force(spark):
    """The query's bpe-50k totals, with an end token for every document that the deletions left."""
    import base64

    import tiktoken

    with open(t.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    first = {}
    for d in docs:
        first[d["text"]] = min(d["doc_id"], first.get(d["text"], d["doc_id"]))
    want = {}
    for d in docs:
        if d["text"] is None or d["doc_id"] == first[d["text"]]:
            n, k = want.get((d["source"], d["lang"]), (0, 0))
            want[d["source"], d["lang"]] = (n + 1, k + 1 + len(plain.encode_ordinary(d["text"] or "")))
    out = t.op4_token_ledger(spark, "/root/testdata/sf0.001").where("tokenizer = 'bpe-50k'").collect()
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in out} == want


def one(spark, tokens, source="a", op="insert"):
    return spark.createDataFrame([(op, source, "en", "v1", tokens, None)], CHANGE)


def test_a_batch_with_other_content_is_an_error(spark, tmp_path):
    import pytest

    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("insert", "a", None, "v1", 3, None), ("insert", None, "a", "v1", 4, None)], CHANGE)
    assert ledger.commit("1", rows) and not ledger.commit("1", rows.orderBy("tokens").repartition(3))
    with pytest.raises(ValueError, match="other content"):
        ledger.commit("1", rows.withColumns({"source": rows["lang"], "lang": rows["source"]}))
    for none in (None, ""):
        with pytest.raises(ValueError, match="an id"):
            ledger.commit(none, rows)
    assert totals(ledger) == {("a", None, "v1"): (1, 3), (None, "a", "v1"): (1, 4)}


def test_the_second_writer_adds_to_the_first(spark, tmp_path, monkeypatch):
    """Another writer publishes, the same batch or another, after this one has read the version."""
    for other, want in (("theirs", {("a", "en", "v1"): (2, 12)}), ("mine", {("a", "en", "v1"): (1, 5)})):
        ledger = t.Ledger(spark, str(tmp_path / other))
        plain = t.publish

        def late(*args, **options):
            monkeypatch.setattr(t, "publish", plain)
            assert t.Ledger(spark, ledger.path).commit(other, one(spark, 7 if other == "theirs" else 5))
            return plain(*args, **options)

        monkeypatch.setattr(t, "publish", late)
        assert ledger.commit("mine", one(spark, 5)) == (other == "theirs")
        assert totals(ledger) == want


def test_a_writer_of_long_ago_is_told(spark, tmp_path, monkeypatch):
    """Its number was taken and cleaned away since, so the log lets it in; it must start again."""
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    ledger.commit("0", one(spark, 1))
    plain, steps = t.publish, []

    def late(*args, **options):
        if not steps:
            steps.append(1)
            for i in range(4):
                ledger.commit(f"theirs-{i}", one(spark, 10))
            options.pop("expected")
            log = tmp_path / "ledger/_log"
            held = {f: f.read_bytes() for f in log.glob("0*.json")}
            [f.unlink() for f in log.iterdir()]
            (log / "000000000001.json").write_text("{}")
            number = plain(*args, **options)
            [f.unlink() for f in log.iterdir()]
            [f.write_bytes(b) for f, b in held.items()]
            return number
        return plain(*args, **options)

    monkeypatch.setattr(t, "publish", late)
    assert ledger.commit("mine", one(spark, 100))
    assert totals(ledger) == {("a", "en", "v1"): (6, 141)}


def test_a_failed_publication_leaves_the_totals(spark, tmp_path, monkeypatch):
    import pytest

    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    ledger.commit("1", one(spark, 1))

    def broken(*args, **options):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(t, "publish", broken)
        with pytest.raises(OSError):
            ledger.commit("2", one(spark, 2))
    assert totals(ledger) == {("a", "en", "v1"): (1, 1)}
    assert ledger.commit("2", one(spark, 2)) and totals(ledger) == {("a", "en", "v1"): (2, 3)}


def test_reading_does_not_grow_with_batches(spark, tmp_path):
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    files = []
    for i in range(10):
        ledger.commit(str(i), one(spark, i))
        files.append(len(ledger.totals().inputFiles()))
        assert len(list((tmp_path / "ledger/_log").glob("0*.json"))) <= 2
    assert files[1:] == files[:-1] and totals(ledger) == {("a", "en", "v1"): (10, 45)}
    assert ledger.commit("last", spark.createDataFrame([("delete", "a", "en", "v1", 45, None)] + [("delete", "a", "en", "v1", 0, None)] * 9, CHANGE))
    assert totals(ledger) == {}
