"""Secret scans: fixed patterns, and a battery of randomness tests (only DataFrame functions).

Candidates are runs of 20 or more characters of the usual encodings. Each gets
an inferred encoding and three tests against the hypothesis that its characters
are drawn uniformly from that encoding's alphabet: chi-squared uniformity, runs
about the middle of the alphabet, and correlation of neighbours. The p-values,
each fitted to short tokens and the last freed of what it shares with the
second, are combined by Fisher's method: near 0 for words, uniform for keys. Over
all candidates of one encoding and length class, the count above 0.5 and the
count near 0 tell how many are random; from that, and from classes of similar
length where there are few, follows the lowest p-value at which at most
MAX_FALSE of what is reported is not random, as estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, fresh, stage

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_MIN = 20
#: A run is taken whole, so one that is too short holds no match.
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

ALPHABETS = {
    "hex": "0123456789abcdef",
    "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BINS = 20
MAX_FALSE = 0.05
SPAN = "array<struct<s:int,e:int>>"
#: Matches whose places are added up in one fold.
CHUNK = 256
#: Length classes are half octaves; everything from 2^12 characters on is one class, so strata are few.
TOP_CLASS = 24
#: Length classes on each side that help to estimate, with the weight of so many words; deviations that count as shown.
NEAR, PRIOR_WORDS, DEVIATIONS = 4, 100, 2


def spans(text: Column, pattern: str) -> Column:
    """Start and end (code points, end exclusive) of each leftmost match, in order.

    The text between matches comes from ``split``, the matches from
    ``regexp_extract_all``; a fold adds up their lengths.
    """
    parts = F.struct(
        F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    return F.when(text.rlike(pattern), parts)


def _positions(parts: Column) -> Column:
    """Spans of what spans() found. Sums run within CHUNK matches and then over chunks, as each step of a fold copies what it has so far."""
    lengths = F.filter(
        F.arrays_zip(F.transform(parts["between"], lambda x: F.length(x)).alias("b"), F.transform(parts["found"], lambda x: F.length(x)).alias("m")),
        lambda x: x["m"].isNotNull(),
    )

    def within(chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("p"), F.array().cast(SPAN).alias("out")),
            lambda a, x: F.struct(
                (a["p"] + x["b"] + x["m"]).alias("p"),
                F.concat(a["out"], F.array(F.struct((a["p"] + x["b"]).alias("s"), (a["p"] + x["b"] + x["m"]).alias("e")))).alias("out"),
            ),
        )

    firsts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK)))
    chunks = F.transform(firsts, lambda i: within(F.slice(lengths, i, F.lit(CHUNK))))
    placed = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("p"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda a, x: F.struct(
            (a["p"] + x["p"]).alias("p"),
            F.concat(a["out"], F.array(F.transform(x["out"], lambda y: F.struct((y["s"] + a["p"]).alias("s"), (y["e"] + a["p"]).alias("e"))))).alias("out"),
        ),
    )
    return F.flatten(placed["out"])


def _normal_tail(z: Column) -> Column:
    """P(Z > z), to within 1e-7 (rational approximation of the error function)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _uneven(chi: Column, k: Column, n: Column) -> tuple[Column, Column]:
    """Two normal values whose mean tail is P of a chi-squared statistic of n characters of k at least this large, half of its own weight counted.

    Its mean is k - 1 and its variance 2 (k - 1) (n - 1) / n, so it stands for a
    scaled chi-squared of somewhat more degrees; it moves in steps of 2 k / n.
    """
    free, scale = (k - 1) * n / (n - 1), n / (n - 1)

    def value(x: Column) -> Column:
        wide = 2 / (9 * free)
        return (F.pow(F.greatest(x * scale, F.lit(1e-9)) / free, F.lit(1 / 3)) - (1 - wide)) / F.sqrt(wide)

    return value(chi - k / n), value(chi + k / n)


def _changed(changes: Column, n: Column) -> tuple[Column, Column]:
    """Two normal values whose tails add up to P, both sides, of a number of changes between halves of the alphabet as far from half of n - 1, half of its own weight counted."""
    off, deviation = F.abs(changes - (n - 1) / 2), F.sqrt((n - 1) / 4)
    return F.greatest(off - 0.5, F.lit(0.0)) / deviation, (off + 0.5) / deviation


def _own_correlation(changes: Column, products: Column, k: Column, n: Column) -> Column:
    """The normal value of the neighbours' correlation without what the changes already say.

    Each change makes a product negative: over uniform characters the two
    values correlate at -(mean distance from the middle) squared over the
    variance, -3/4 k^2 / (k^2 - 1). Two tests that say the same would count twice.
    """
    serial = products / (((k * k - 1) / 12) * F.sqrt(n - 1))
    common = 0.75 * k * k / (k * k - 1)
    return (serial + common * (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)) / F.sqrt(1 - common * common)


def encoding(token: Column) -> Column:
    """The narrowest alphabet that spells the token; null where it is only digits."""
    return (
        F.when(token.rlike(r"^[0-9]+=*$"), F.lit(None))
        .when(token.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(token.rlike(r"^[A-Z2-7]+=*$"), F.lit("b32"))
        .otherwise(F.lit("b64"))
    )


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with encoding, length class and p, the combined p-value.

    Tokens without an encoding, or with fewer than two characters, have no p.
    """
    c = F.col
    size = F.element_at(F.create_map(*[F.lit(x) for k, v in ALPHABETS.items() for x in (k, len(v))]), c("encoding"))
    letters = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), c("encoding"))
    plain = F.regexp_replace(F.translate(c(token), "-_", "+/"), "=", "")
    step1 = (
        tokens.withColumn("encoding", encoding(c(token)))
        .withColumn("__plain", F.when(c("encoding") == "hex", F.lower(plain)).otherwise(plain))
        .withColumn("__n", F.length("__plain"))
        .withColumn("__k", size)
        .withColumn("__letters", letters)
        .withColumn("__chars", F.split("__plain", ""))
    )
    step2 = step1.withColumn(
        "__codes", F.transform("__chars", lambda x: (F.position(x, c("__letters")) - 1).cast("double"))
    ).withColumn(
        "__squares",
        F.aggregate(
            F.array_distinct("__chars"),
            F.lit(0.0),
            lambda a, x: a + F.pow((c("__n") - F.length(F.replace(c("__plain"), x, F.lit("")))).cast("double"), F.lit(2.0)),
        ),
    )
    k, n = c("__k").cast("double"), c("__n").cast("double")
    middle = (k - 1) / 2
    fold = F.aggregate(
        F.slice("__codes", 2, F.greatest(c("__n") - 1, F.lit(0))),
        F.struct(F.get(c("__codes"), F.lit(0)).alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("products")),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["runs"] + F.when((x > middle) != (a["last"] > middle), 1.0).otherwise(0.0)).alias("runs"),
            (a["products"] + (x - middle) * (a["last"] - middle)).alias("products"),
        ),
    )
    step3 = step2.withColumn("__fold", fold)
    changes = c("__fold.runs") - 1
    values = F.array(
        *_uneven(c("__squares") * k / n - n, k, n),
        *_changed(changes, n),
        F.abs(_own_correlation(changes, c("__fold.products"), k, n)),
    )
    usable = c("encoding").isNotNull() & (c("__n") >= 2)
    # the tail stands once in the plan: spelled out for each value it made 20,000 lines of code, more than Java compiles
    step4 = step3.withColumn("__values", F.when(usable, values)).withColumn("__tails", F.transform("__values", _normal_tail))
    tail = lambda i: F.get(c("__tails"), F.lit(i))
    parts = (tail(0) + tail(1)) / 2, F.least(tail(2) + tail(3), F.lit(1.0)), F.least(2 * tail(4), F.lit(1.0))
    uneven, changed, correlated = (F.ln(F.greatest(p, F.lit(1e-300))) for p in parts)
    return (
        step4.withColumn("__f", F.when(usable, -(uneven + changed + correlated)))
        .withColumn("p", F.exp(-c("__f")) * (1 + c("__f") + c("__f") * c("__f") / 2))  # chi-squared, 6 degrees
        .withColumn("length_class", F.least(F.floor(2 * F.log2(n)), F.lit(TOP_CLASS)).cast("int"))
        .drop("__plain", "__n", "__k", "__letters", "__chars", "__codes", "__squares", "__fold", "__values", "__tails", "__f")
    )


def thresholds(scored: DataFrame) -> DataFrame:
    """Per encoding and length class, the lowest bin of p at which the false share is low enough.

    Of n random tokens n / BINS fall into the lowest bin; what it holds beyond
    that is words. How many words pass a bin for each word of the lowest one is
    estimated from the class itself and, as far as that has few words, from the
    classes within NEAR of it. So a class without words reports its keys,
    however few they are. Where the class alone shows more false reports than
    chance allows, that count holds. At most 3 encodings x 25 classes x 20 bins
    are counted.
    """
    c = F.col
    binned = scored.where(c("p").isNotNull()).groupBy(
        "encoding", "length_class", F.least(F.floor(c("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    )
    counts = binned.agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.lit(BINS - 1)))
    sums = counts.withColumn("from_bin", at).groupBy("encoding", "length_class", "from_bin").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(c("bin") == 0, c("n")).otherwise(0)).alias("lowest"),
        F.sum(F.when(c("bin") >= BINS // 2, c("n")).otherwise(0)).alias("upper"),
        F.sum(F.when(c("bin") >= c("from_bin"), c("n")).otherwise(0)).alias("reported"),
    )
    words = F.greatest((c("lowest") - c("n") / BINS) / (1 - 1 / BINS), F.lit(0.0))
    sums = sums.withColumn("words", words).withColumn("excess", c("reported") - 2 * c("upper") * (1 - c("from_bin") / BINS))
    near = sums.select("encoding", c("length_class").alias("__near"), "from_bin", c("words").alias("__words"), c("excess").alias("__excess"))
    pooled = (
        sums.join(near, ["encoding", "from_bin"])
        .where(F.abs(c("length_class") - c("__near")) <= NEAR)
        .groupBy("encoding", "length_class", "from_bin", "reported", "words", "excess")
        .agg((F.greatest(F.sum("__excess"), F.lit(0.0)) / F.greatest(F.sum("__words"), F.lit(1.0))).alias("passing"))
    )
    rate = (F.greatest(c("excess"), F.lit(0.0)) + PRIOR_WORDS * c("passing")) / (c("words") + PRIOR_WORDS)
    shown = c("excess") - DEVIATIONS * F.sqrt(c("reported").cast("double"))  # the excess of random tokens has a deviation of about this root
    return (
        pooled.where(c("reported") > 0)
        .where(F.greatest(c("words") * rate, shown) <= MAX_FALSE * c("reported"))
        .groupBy("encoding", "length_class")
        .agg(F.min("from_bin").alias("from_bin"))
    )


def _as_kind(found: Column, kind: str, order: int) -> Column:
    return F.transform(
        F.coalesce(found, F.array().cast(SPAN)),
        lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")),
    )


def _joined(all_spans: Column) -> Column:
    return F.array_join(
        F.transform(all_spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: columns of ``keep``, and ``found``, all spans by start, then kind.

    ``found`` holds structs (s, o, e, kind); the kinds are assign, access, hex
    and, from the battery, random. A random span that overlaps one of the
    patterns' is dropped; the patterns' always stay. A null or empty text has
    no spans. Texts are read once; what is written between the two passes is
    the spans and candidates only.
    """
    whole = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    raw = rows.select(
        *[f"__keep_{i}" for i in range(len(keep))],
        spans(whole, ASSIGN).alias("__assign"),
        F.when(whole.rlike(ASSIGN), F.regexp_extract_all(whole, F.lit(ASSIGN), F.lit(2))).alias("__values"),
        spans(whole, ACCESS).alias("__access"),
        spans(whole, HEX).alias("__hex"),
        spans(whole, CANDIDATE).alias("__candidates"),
    )
    placed = raw.select(
        *[f"__keep_{i}" for i in range(len(keep))],
        F.filter(
            _positions(F.col("__assign")), lambda x, i: F.length(F.get(F.col("__values"), i)) >= ASSIGN_MIN
        ).alias("__assign"),
        F.filter(_positions(F.col("__access")), lambda x: x["e"] - x["s"] >= ACCESS_MIN).alias("__access"),
        _positions(F.col("__hex")).alias("__hex"),
        F.arrays_zip(_positions(F.col("__candidates")).alias("at"), F.col("__candidates.found").alias("token")).alias(
            "__candidates"
        ),
    )
    table = stage(
        placed.withColumn("__row", F.monotonically_increasing_id()),
        "secrets",
    )
    scored = stage(
        battery(
            table.where(F.size("__candidates") > 0)
            .select("__row", F.explode("__candidates").alias("x"))
            .select("__row", F.col("x.at").alias("at"), F.col("x.token").alias("token"))
        ).select("__row", "at", "encoding", "length_class", "p"),
        "secret-tests",
    )
    limits = F.broadcast(thresholds(scored))  # at most 3 x 25 rows
    random = (
        scored.join(limits, ["encoding", "length_class"])
        .where(F.col("p") * BINS >= F.col("from_bin"))
        .groupBy("__row")
        .agg(F.array_sort(F.collect_list("at")).alias("__random"))
    )
    base = F.array_sort(
        F.concat(_as_kind(F.col("__assign"), "assign", 0), _as_kind(F.col("__access"), "access", 1), _as_kind(F.col("__hex"), "hex", 2))
    )
    added = F.filter(
        F.coalesce(F.col("__random"), F.array().cast(SPAN)),
        lambda r: ~F.exists(F.col("base"), lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])),
    )
    return (
        table.select("*", base.alias("base"))
        .join(random, "__row", "left")
        .withColumn("added", added)
        .select(
            *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)],
            "base",
            F.array_sort(F.concat("base", _as_kind(F.col("added"), "random", 3))).alias("found"),
        )
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and n_random, the spans that the battery adds."""
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        of("random").alias("n_random"),
    )


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; each secret in its text is replaced by its kind.

    Overlapping spans are one. ``n_chars`` follows the new text. Rows of equal
    id keep the spans of their own text.
    """
    of = fresh("of", docs)
    hashed = docs.withColumn(of, F.xxhash64("text"))
    spans_, new = fresh("spans", hashed), fresh("new", hashed)
    found = scan(hashed, keep=("doc_id", of)).where(F.size("found") > 0)
    one = found.groupBy(F.col("doc_id").alias("id"), F.col(of).alias("hash")).agg(F.first("found").alias(spans_))
    same = hashed["doc_id"].eqNullSafe(one["id"]) & (hashed[of] == one["hash"])
    joined = hashed.join(one, same, "left")
    cut = F.aggregate(
        spans_,
        F.struct(F.lit(0).alias("p"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["p"], x["e"]).alias("p"),
            F.when(x["s"] < a["p"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(hashed["text"], a["p"] + 1, x["s"] - a["p"]), F.lit("["), x["kind"], F.lit("]")))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["p"] + 1, F.length(F.col("text")))),
    )
    changed = F.when(F.col(spans_).isNotNull(), cut).otherwise(F.col("text"))
    out = joined.withColumn(new, changed)
    return out.select(
        *[
            F.col(new).alias("text")
            if c == "text"
            else F.when(F.col(spans_).isNotNull(), F.length(new).cast(t)).otherwise(F.col("n_chars")).alias("n_chars")
            if c == "n_chars"
            else hashed[c]
            for c, t in docs.dtypes
        ]
    )
