"""Quality rules: divergence of a document from its language's reference.

Two histograms of a text, of character classes and of its language's commonest
words, are compared with the same histograms of the whole language by
Jensen-Shannon distance (base 2, so 0 to 1). Before that come plain length and
repetition rules. Everything is DataFrame expressions: a first pass counts words,
a second writes each row's counts, from which the references are made and the
rows judged; no text is shuffled.

References: for each ``lang`` the class counts of all its documents, and the
counts of all its words in lower case, of which the ``COMMON_WORDS`` most frequent
(ties by word) are its common words. Counts are combined map-side; what is
shuffled are a task's different words. Tables by language have one row for each;
they are broadcast if they have at most ``BROADCAST_LANGUAGES`` rows and joined by
sort-merge otherwise.

Guards: a text of fewer than ``MIN_WORDS`` words fails the base rules; a language
with fewer than ``MIN_REFERENCE_WORDS`` words in all has no reference, and its
documents are judged by the base rules alone. A text without any common word is
at the distance ``absent`` of its language, which depends on the share ``s`` of
common words and is about 0.35 for s = 0.23. The limit of the common-word
distance is therefore ``absent`` times ``sqrt(NEAR + NOISE / (n_words * s))``, the
second term for the chance in a short text, at most ``ABSENT`` times it and never
above ``MAX_COMMON_DISTANCE``. Texts in which fewer than ``MIN_EXPECTED`` common
words are to be expected are held to ``MAX_COMMON_DISTANCE`` alone.

Defined cases: a null text has no words and fails; a null ``lang`` is a language
of its own; repeated rows give repeated results; an empty table gives an empty
result; extra columns do not matter. Repeated three-word windows are found by
the 64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.runtime import materialise

MIN_WORDS = 50
MIN_REFERENCE_WORDS = 2_000
COMMON_WORDS = 20
MAX_CLASS_DISTANCE = 0.33
MAX_COMMON_DISTANCE = 0.42
NEAR = 0.4
NOISE = 5.5
ABSENT = 0.9
MIN_EXPECTED = 10
BROADCAST_LANGUAGES = 10_000
_SALTS = 8

_SPACE = r"[\x20\x09-\x0D]+"
#: Character classes; what is in none of them is the last class.
CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "digit": "0-9",
    "space": r"\x20\x09-\x0D",
    "mark": r".,;:'\"()?!\-",
    "wide": r"\x{80}-\x{10FFFF}",
}


def _without(text: Column, inside: str) -> Column:
    return F.regexp_replace(text, f"[{inside}]+", "")


def _only(text: Column, inside: str) -> Column:
    """How many characters of the class a text has."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def _shares(counts: Column) -> Column:
    sums = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return _let(sums, lambda total: F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def term(a: Column, b: Column) -> Column:
        zero = F.lit(0.0)
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(zero) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(zero)

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _by_language(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else table


def common_words(docs: DataFrame) -> DataFrame:
    """__lang, common: the most frequent words of each language, most frequent first, and the length of the longest."""
    counted = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(_words(F.coalesce("text", F.lit("")))).alias("word"))
    counted = counted.groupBy("lang", F.lower("word").alias("word")).count()
    order = [F.desc("count"), F.asc("word")]
    counted = counted.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(_SALTS)))
    few = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= COMMON_WORDS)
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= COMMON_WORDS)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("l"))
    return lists.select(F.col("lang").alias("__lang"), F.transform("l", lambda x: x["word"]).alias("common"), F.array_max(F.transform("l", lambda x: F.length(x["word"]))).alias("longest"))


def _signals(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, and what each row's text comes to; written, as references and verdicts both read it."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*keep, F.coalesce("lang", F.lit("")).alias("__lang"), text.alias("__text"), _without(text, CLASSES["lower"]).alias("rest"))
    names = [c for c in df.columns if c.startswith("__keep")] + ["__lang"]
    df = df.join(_by_language(materialise(common_words(docs), "common-words")), "__lang", "left")
    names += ["common"]
    df = df.select(*names, "longest", "__text", "rest", _without(F.col("rest"), CLASSES["space"]).alias("odd"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    # most characters are lower-case letters or white space: the other classes are counted in what is left
    some = [_only(F.col("odd"), CLASSES[c]) for c in ("upper", "digit", "mark", "wide")]
    n_lower, n_space, n_odd = F.length("__text") - F.length("rest"), F.length("rest") - F.length("odd"), F.length("odd")
    df = df.select(
        *names, "longest",
        _words(F.col("__text")).alias("w"),
        lines.alias("lines"),
        _only(F.col("odd"), "#*$%&|<>").alias("n_symbols"),
        (F.length("__text") - n_space).cast("long").alias("word_chars"),
        F.array(n_lower.cast("long"), some[0], some[1], n_space.cast("long"), some[2], some[3], n_odd.cast("long")).alias("c"),
    )
    n = F.size("w")
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)).alias("h"), i.alias("p")))
    c = F.col("c")

    def found(at: Column) -> Column:
        each = [(F.size(at) - F.size(F.array_remove(at, F.lit(k).cast("long")))).cast("long") for k in range(1, COMMON_WORDS + 1)]
        return F.concat(F.slice(F.array(*each), 1, F.size("common")), F.array((n - F.size(at)).cast("long")))

    # bound once: a filter moves below the projection and would repeat what has only a column's name.
    # a word is never longer than it is in lower case
    short = F.filter("w", lambda x: F.length(x) <= F.col("longest"))
    at = F.array_remove(F.transform(short, lambda x: F.array_position("common", F.lower(x))), 0)
    df = df.select(
        *names, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(windows)).alias("windows"),
        F.concat(F.slice(c, 1, 6), F.array(c[6] - c[1] - c[2] - c[4] - c[5])).alias("classes"),
        _let(at, found).alias("hits"),
    )
    m = F.size("windows")
    twice = F.transform(
        "windows",
        lambda x, i: F.when(((i > 0) & (F.get("windows", i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get("windows", i + 1)["h"] == x["h"])), x["p"]),
    )
    df = df.select(*names, "word_chars", "n_symbols", "n_words", "n_dup_lines", "classes", "hits", F.sort_array(F.array_compact(twice)).alias("twice"))
    covered = F.transform("twice", lambda x, i: F.when(i < F.size("twice") - 1, F.least(F.lit(3), F.get("twice", i + 1) - x)).otherwise(3))
    repeated = F.when(F.size("twice") > 0, F.aggregate(covered, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long")
    return materialise(df.withColumn("n_repeat_words", repeated).drop("twice", "common"), "quality-signals")


def language_references(signals: DataFrame) -> DataFrame:
    """__lang, class_share, common_share, absent, used of each language with enough words."""
    n = len(CLASSES) + 1
    sums = [F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(size)]) for c, size in (("classes", n), ("hits", COMMON_WORDS + 1))]
    found = signals.groupBy("__lang").agg(sums[0].alias("classes"), sums[1].alias("hits"), F.sum("n_words").alias("words"), F.max(F.size("hits")).alias("places"))
    found = found.where((F.col("words") >= MIN_REFERENCE_WORDS) & (F.col("places") > 1))
    found = found.select("__lang", _shares(F.col("classes")).alias("class_share"), _shares(F.slice("hits", 1, F.col("places"))).alias("common_share"))
    absent = F.transform("common_share", lambda x, i: F.when(i == F.size("common_share") - 1, 1.0).otherwise(0.0))
    return found.select("*", js_distance(absent, F.col("common_share")).alias("absent"), (1 - F.element_at("common_share", -1)).alias("used"))


def _compared(signals: DataFrame) -> DataFrame:
    refs = materialise(language_references(signals), "language-references")
    df = signals.join(_by_language(refs), "__lang", "left")
    common = F.when(F.col("common_share").isNotNull(), js_distance(_shares(F.col("hits")), F.col("common_share")))
    return df.withColumn("class_distance", js_distance(_shares(F.col("classes")), F.col("class_share"))).withColumn("common_distance", common)


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _verdict(df: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    expected = F.col("n_words") * F.col("used")
    limit = F.col("absent") * F.least(F.lit(ABSENT), F.sqrt(NEAR + NOISE / F.greatest(expected, F.lit(1.0))))
    limit = F.when(expected >= MIN_EXPECTED, F.least(F.lit(MAX_COMMON_DISTANCE), limit)).otherwise(MAX_COMMON_DISTANCE)
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & F.coalesce(F.col("common_distance") <= limit, F.lit(True))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)


def judge_quality(docs: DataFrame) -> DataFrame:
    """The signals and the verdict of each document row."""
    df = _verdict(_compared(_signals(docs, [F.col("doc_id").alias("__keep_id")])))
    return df.select(
        F.col("__keep_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("class_distance", 9).alias("class_distance"), F.round("common_distance", 9).alias("common_distance"),
    )


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their columns as they were."""
    df = _verdict(_compared(_signals(docs, [F.struct(*[docs[c] for c in docs.columns]).alias("__keep_row")])))
    return df.where("kept").select(*[F.col("__keep_row")[c].alias(c) for c in docs.columns])
