import random
import zlib

from lapsight.llm import language_id as l


def corpus():
    r = random.Random(5)
    parts = {"xx": "thing er tion ou the st".split(), "yy": "lich ung sch keit der und".split(), "zz": "eaux ment ai que le é".split()}
    for i in range(600):
        lang = r.choice(list(parts))
        yield i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 80))), lang


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(list(corpus()), "doc_id long, text string, lang string")
    model = l.fit(docs.where(~l.held_out(docs["doc_id"])))
    assert sorted(model) == ["xx", "yy", "zz"]
    out = l.predict(docs, model, keep=("doc_id", "lang")).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edges(spark, docs, rows, empty):
    model = l.fit(docs)
    out = l.predict(docs, model, keep=("doc_id", "text")).collect()
    assert len(out) == len(rows)
    for r in out:
        blank = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == blank
    assert l.fit(empty) == {} and l.predict(empty, {}).count() == 0
    assert {r["lang_pred"] for r in l.predict(docs, {}).collect()} == {"und"}
    none = spark.createDataFrame([(None, "abc")], "doc_id long, text string")
    assert none.select(l.held_out(none["doc_id"])).first()[0] is False


def test_copies_of_few_texts_leave_a_dictionary(spark):
    """Each language has two texts, of 4000 rows each; a draw by share of rows leaves most dictionaries empty."""
    rows = [(f"l{k}", f"text{'abcdefghij'[k]} number{'xy'[j]} of this language") for k in range(10) for j in range(2) for _ in range(4000)]
    model = l.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert all(len(model[f"l{k}"][0].split(b"\n")) == 2 and model[f"l{k}"][1] == 8000 for k in range(10))


def test_whole_texts_and_no_names(spark):
    """Long texts are not cut, and a language of texts without letters gets neither its name nor wins a text."""
    long = "wort " * 30_000 + "ende"
    rows = [("de", long), ("es", "123 456"), ("fr", "mot " * 10)]
    model = l.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model["de"][0] == long.encode() and model["es"][0].strip() == b"" and model["fr"][0] == ("mot " * 10).strip().encode()
    out = l.predict(spark.createDataFrame([(1, "wort wort ende"), (2, "mot mot mot"), (3, "es es")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(out)][:2] == ["de", "fr"]


def test_prediction_equals_plain_compression(spark, docs, rows):
    import zstandard

    model = l.fit(docs)
    order = sorted(model, key=lambda k: (-model[k][1], k))
    for r in l.predict(docs, model, keep=("doc_id", "text")).collect():
        if r["lang_pred"] == "und":
            continue
        data = l.plain(r["text"])
        sizes = {}
        for k in order:
            d = zstandard.ZstdCompressionDict(model[k][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=l.LEVEL)
            z = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = sum(len(z.compress(data[i : i + l.BLOCK])) for i in range(0, len(data), l.BLOCK))
        assert r["lang_pred"] == min(order, key=lambda k: sizes[k])


def test_the_driver_gets_a_bounded_sample(spark, monkeypatch):
    """Few usual texts and many long ones: whole texts, shortest first, up to the bound; one of each language stays."""
    monkeypatch.setattr(l, "ALL_CHARS", 30_000)
    monkeypatch.setattr(l, "USUAL_CHARS", 1_000)
    texts = {"aa": ["ab " * 300] + [f"{'xyzuvw'[i]} " * (2_000 + 500 * i) for i in range(6)], "bb": ["q " * 40_000, "r " * 50_000], "cc": ["c d"]}
    model = l.fit(spark.createDataFrame([(k, v) for k, x in texts.items() for v in x], "lang string, text string"))
    assert {k: n for k, (_, n) in model.items()} == {"aa": 7, "bb": 2, "cc": 1}
    assert model["aa"][0] == b"\n".join(l.plain(x) for x in texts["aa"][:3]).strip()  # 900, 4000 and 5000 of 10,000 characters
    assert model["bb"][0] == texts["bb"][0].strip().encode() and model["cc"][0].strip() == b"c d"
