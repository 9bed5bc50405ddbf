"""Language ID by compression with one raw-content dictionary per language.

A language's dictionary is whole texts of its training documents. Every text, lower-cased
and with one blank for each run of other characters than letters, is compressed
with each dictionary, in blocks so that the dictionary and not the text's own
past is what helps; the language of the smallest sum wins, and a narrow margin
over the next one is marked as a rejection.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, map_rows

#: Bound of what is fitted: different training texts per language, whole; those of up to USUAL_CHARS characters go first.
SAMPLE_DOCS = 100
USUAL_CHARS = 20_000
#: Characters that a language's texts may have together, its shortest apart, and those of all languages together.
SAMPLE_CHARS = SAMPLE_DOCS * USUAL_CHARS
ALL_CHARS = 200_000_000
LEVEL = 6
#: Bytes that are compressed at once; all blocks of a text count.
BLOCK = 1000
#: Less than this share of the text's bytes between the best two languages is a rejection.
MARGIN = 0.02
UNKNOWN = "und"
OUTPUTS = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
LETTER = regex.compile(r"\p{L}")
OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).encode()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[bytes, int]]:
    """Per language, its dictionary and its count of training documents.

    ``docs`` are training documents only. The dictionary is the SAMPLE_DOCS
    different texts of a language with the smallest hashes, whole, or all where
    there are fewer; longer texts than USUAL_CHARS are drawn only where others
    are too few, the shortest first, and none that would bring the language
    over SAMPLE_CHARS or its equal share of ALL_CHARS; one text always stays.
    So what reaches the driver is bounded by drawing texts, not by cutting
    them. Counts cover all documents. A language whose texts have no letters
    gets blanks; its name is never part of the dictionary.
    """
    labelled = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    drawn = F.xxhash64(F.lit(7), text)
    texts = labelled.groupBy(F.col(lang).alias("lang"), drawn.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min(F.length(text)).alias("chars"))
    few = F.count_if(F.col("chars") <= USUAL_CHARS)
    sums = {r[0]: (r[1], r[2] if r[2] > 2 * SAMPLE_DOCS else r[3]) for r in texts.groupBy("lang").agg(F.sum("n"), few, F.count(F.lit(1))).collect()}
    counts = {k: n for k, (n, _) in sums.items()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, (_, n) in sums.items() for x in (k, min(1.0, 2 * SAMPLE_DOCS / n))])  # twice as many, so that none is short
    draw = (drawn / F.lit(2.0**64)) + 0.5
    usual = F.length(text) <= USUAL_CHARS
    longer = F.when(usual, 0).otherwise(F.length(text))  # usual ones by hash alone
    w = Window.partitionBy("lang").orderBy("longer", "drawn")
    most = min(SAMPLE_CHARS, ALL_CHARS // len(counts))
    sample = (
        labelled.where(draw <= F.element_at(share, F.col(lang)))
        .select(F.col(lang).alias("lang"), drawn.alias("drawn"), longer.alias("longer"), F.col(text).alias("part"))
        .dropDuplicates(["lang", "drawn"])
        .withColumns({"rank": F.row_number().over(w), "chars": F.sum(F.length("part")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
        .where((F.col("rank") == 1) | ((F.col("rank") <= SAMPLE_DOCS) & (F.col("chars") <= most)))
        .orderBy("lang", "rank")
        .collect()
    )
    parts: dict[str, list[bytes]] = {k: [] for k in counts}
    for row in sample:
        parts[row["lang"]].append(plain(row["part"]))
    return {k: (b"\n".join(parts[k]).strip() or b" " * 8, counts[k]) for k in sorted(counts)}


def predict(docs: DataFrame, model: dict[str, tuple[bytes, int]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``; lang_pred, score and rejected.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned. Equal sizes go to the language with more training
    documents, then the first by name. The score is the margin over the next
    language, as a share of the text's bytes that grows to 1.
    """
    order = sorted(model, key=lambda k: (-model[k][1], k))

    def start():
        tools = []
        for k in order:
            content = zstandard.ZstdCompressionDict(model[k][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

        def judge(value: str | None) -> tuple[str, float, bool]:
            if not tools or value is None or not LETTER.search(value):
                return UNKNOWN, 0.0, True
            data = plain(value)
            blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = [sum(len(t.compress(b)) for b in blocks) for t in tools]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            rest = [s for i, s in enumerate(sizes) if i != best]
            margin = (min(rest) - sizes[best]) / len(data) if rest else 1.0
            return order[best], min(1.0, margin / (margin + MARGIN) if margin > 0 else 0.0), margin < MARGIN

        return lambda texts: list(zip(*map(judge, texts), strict=True))

    return map_rows(docs, keep, [F.col(text)], OUTPUTS, start)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
