"""Each stage of the pipeline on its own input against SQL or a plain computation, and the whole on difficult rows."""

import math

import duckdb
import pytest

import corpus_pipeline
from lapsight.llm import near_duplicates, piece_sampling, quality_rules, secret_scan, source_mix
from tests.llm.test_near_duplicates import brute
from tests.llm.test_secret_scan import base_spans
from tests.llm.test_source_mix import water_fill

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Folder of every stage's input and output, as the pipeline writes them."""
    root = tmp_path_factory.mktemp("stages")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{root}/documents")
    before = "documents"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, spark.read.parquet(f"{root}/{before}"), SF).write.parquet(f"{root}/{name}")
        before = name
    return root


def read(spark, root, name):
    return [r.asDict() for r in spark.read.parquet(f"{root}/{name}").collect()]


def by_sql(root, name, sql):
    d = duckdb.connect()
    d.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/{name}/*.parquet'")
    found = d.execute(sql)
    names = [c[0] for c in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def test_quality_rules_keep_what_sql_keeps(spark, stages):
    kept = {r["doc_id"] for r in by_sql(stages, "documents", quality_rules.OP8_SQL) if r["kept"]}
    rows = [r for r in read(spark, stages, "documents") if r["doc_id"] in kept]
    assert sorted(map(str, read(spark, stages, "quality_rules"))) == sorted(map(str, rows)) and rows


def test_one_document_of_each_group_stays(spark, stages):
    rows = read(spark, stages, "quality_rules")
    first = brute([(r["doc_id"], r["text"]) for r in rows])
    want = [r for r in rows if first[r["doc_id"]][0] == r["doc_id"]]
    assert sorted(map(str, read(spark, stages, "near_duplicates"))) == sorted(map(str, want)) and len(want) < len(rows)


def test_secrets_are_cut_out_and_nothing_else(spark, docs, rows):
    """On rows that hold secrets; the small tables have none left at this stage."""
    found = {r["text"]: r["found"] for r in secret_scan.scan(docs, keep=("text",)).collect()}
    want, cut = [], 0
    for r in docs.collect():
        r = r.asDict()
        spans = sorted((x["s"], x["e"], x["kind"]) for x in found[r["text"]])
        assert set(base_spans(r["text"])) <= {f"{k}:{a}:{b}" for a, b, k in spans}
        text, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                text += r["text"][at:a] + f"[{kind}]"
            at = max(at, b)
        cut += bool(spans)
        want.append(r if not spans else {**r, "text": text + r["text"][at:], "n_chars": len(text + r["text"][at:])})
    out = [r.asDict() for r in secret_scan.redact(spark, docs, SF).collect()]
    assert sorted(map(str, out)) == sorted(map(str, want)) and cut and len(out) == len(rows)


def test_written_words_of_a_source_come_near_its_target(spark, stages):
    """Targets by the rule as told; each document's last copy is drawn, so a source's words have a deviation of at most half the root of its squared sizes."""
    size = lambda r: len((r["text"] or "").encode().split())
    rows = {r["doc_id"]: r for r in read(spark, stages, "secret_scan")}
    times = dict.fromkeys(rows, 0)
    for r in read(spark, stages, "source_mix"):
        assert r == rows[r["doc_id"]]
        times[r["doc_id"]] += 1
    sizes = {}
    for r in rows.values():
        sizes.setdefault(r["source"], []).append((size(r), times[r["doc_id"]]))
    target = water_fill({s: sum(n for n, _ in x) for s, x in sizes.items()})
    for s, x in sizes.items():
        assert abs(sum(n * t for n, t in x) - target[s]) <= 2 * math.sqrt(sum(n * n for n, _ in x)) + max(n for n, _ in x)
    assert max(times.values()) <= 3 and len(set(times.values())) > 1


def test_encoded_documents_decode_to_their_texts(spark, stages):
    out = piece_sampling.encode_documents(spark, spark.read.parquet(f"{stages}/source_mix"), SF)
    back = piece_sampling.decode_column(out).select("doc_id", "text").collect()
    assert sorted(map(tuple, back)) == sorted((r["doc_id"], r["text"]) for r in read(spark, stages, "source_mix"))


@pytest.mark.parametrize("table", ["docs", "empty"])
def test_difficult_rows_and_no_rows(spark, tmp_path, table, request):
    """Null ids and texts, repeated rows, helper columns' names, long texts; then none at all."""
    docs = request.getfixturevalue(table)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()
    assert {r[0] for r in out} <= {r[0] for r in docs.select("doc_id").collect()} and bool(out) == (table == "docs")


def test_stages_are_these():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        quality_rules.keep_good, near_duplicates.one_of_each, secret_scan.redact, source_mix.take, piece_sampling.encode_documents,
    ]
