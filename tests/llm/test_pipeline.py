import corpus_pipeline
from lapsight.llm import piece_sampling, registry


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        assert 0 < out.count() and {r[0] for r in out.select("doc_id").collect()} <= ids
        if name in ("quality_rules", "near_duplicates"):
            assert out.count() <= seen.count()
        last, seen = seen, out
    back = piece_sampling.decode_column(seen)
    assert sorted(r[0] for r in back.select("text").collect()) == sorted(r[0] for r in last.select("text").collect())
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == seen.count()


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
