"""Quality rules: counts of whole texts, and the distance of their histograms from their language's.

DataFrame functions only. A text's histogram of character classes and its histogram of common words are compared
with the reference of its language by Jensen-Shannon distance (base 2, from 0 to 1). A reference is the mean
histogram of all documents of the language that are long enough and pass the base rules. Texts and languages
with too little to compare are judged by the base rules alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import store

#: Frequent words of each language that has a reference.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
#: Character classes, as parts of a regular expression; all other characters are one more class. Digits are not
#: counted: numbers say little about a text's quality.
CLASSES = (r"a-z\u00DF-\u00F6\u00F8-\u00FF", r"A-Z\u00C0-\u00D6\u00D8-\u00DE", r".,;:!?'\"()\-")
SYMBOLS, DIGITS = r"#*$%&|<>", "0-9"
MIN_WORDS, MIN_COMMON = 50, 20
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.02**0.5, 0.35**0.5
WINDOW = 5
_ANY = sorted({w for words in COMMON_WORDS.values() for w in words})


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _shares(counts: Column) -> Column:
    total = _sum(F.transform(counts, lambda x: x.cast("double")))
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, the root of the divergence to base 2, of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return F.sqrt(F.greatest(_sum(F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)), F.lit(0.0)))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later projections read instead of computing it again."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("x")))).alias("_one")).withColumn(name, F.col("_one.x")).drop("_one")


def repeated_words(words: Column, hashes: Column, size: int = WINDOW) -> Column:
    """Words within windows whose hash occurs twice or more. hashes: one for each window, in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(pairs, size))


def _covered(pairs: Column, size: int) -> Column:
    same = F.transform(F.array(pairs), lambda s: F.filter(F.zip_with(F.zip_with(s, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s), lambda a, b: F.struct(a.alias("a"), b["h"].alias("before"))), F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x, c: F.struct(x["a"].alias("a"), x["before"].alias("before"), c["h"].alias("after"))), lambda x: x["a"].isNotNull() & ((x["a"]["h"] == x["before"]) | (x["a"]["h"] == x["after"]))))
    places = F.transform(same, lambda s: F.sort_array(F.transform(s, lambda x: x["a"]["i"])))
    steps = F.transform(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size)))))
    return F.aggregate(F.element_at(steps, 1), F.lit(0), lambda a, b: a + b)


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, the base counts, and both histograms (arrays of counts; no words of an unknown language)."""
    own = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    own = _held(own, "words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    own = _held(own, "hashes", windows)
    common = F.filter("words", lambda w: w.isin(_ANY))
    own = _held(own, "common", F.when(F.col("lang").isin(list(COMMON_WORDS)), common))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = _held(own, "lines", lines)
    of = lambda kind: F.length(F.regexp_replace("text", f"[^{kind}]+", "")).cast("long")
    all_chars, word_chars = F.length("text").cast("long"), F.length(F.array_join("words", "")).cast("long")
    own = _held(own, "known", F.array(*(of(kind) for kind in (*CLASSES, SYMBOLS)), all_chars - word_chars, of(DIGITS), word_chars))
    n = len(CLASSES)
    rest = F.col("known")[n + 3] - reduce(lambda a, b: a + b, (F.col("known")[i] for i in (*range(n + 1), n + 2)))
    times = lambda w: F.size("common") - F.size(F.array_remove("common", w))
    by_lang = F.lit(None).cast("array<int>")
    for lang, words in COMMON_WORDS.items():
        by_lang = F.when(F.col("lang") == lang, F.array(*(times(w) for w in words))).otherwise(by_lang)
    return own.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.col("known")[n + 3].alias("word_chars"),
        F.col("known")[n].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.concat(F.slice("known", 1, n + 2), F.array(rest)).alias("classes"),
        by_lang.alias("common"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance.

    base_failed: under 10 words, or over a fifth of the words within 5-word windows that occur twice. Other texts
    go if they have MIN_WORDS words and diverge from their language's reference in characters, or in common
    words where they or at least MIN_COMMON of them would be expected. Null texts count as empty. A null or
    unknown language, or one without reference documents, has null distances and only base rules. Repeated
    rows and null ids are judged like any other. Empty table: no rows. Other columns are not read.
    """
    rows = measure(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = store(rows, "measures").withColumn("p", _shares(F.col("classes"))).withColumn("w", _shares(F.col("common")))
    good = rows.where(F.col("common").isNotNull() & ~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS))
    classes, words = len(CLASSES) + 3, len(next(iter(COMMON_WORDS.values())))
    mean = lambda c, n: F.array(*(F.avg(F.col(c)[i]) for i in range(n)))
    # at most a row for each language of COMMON_WORDS
    references = good.groupBy("lang").agg(mean("p", classes).alias("p0"), mean("w", words).alias("w0"), (F.sum(_sum(F.transform("common", lambda x: x.cast("double")))) / F.sum("n_words")).alias("rate"))
    judged = rows.join(F.broadcast(references), "lang", "left")
    long_ = F.col("n_words") >= MIN_WORDS
    judged = judged.withColumn("class_distance", F.when(F.col("p0").isNotNull() & long_, distance(F.col("p"), F.col("p0"))))
    judged = judged.withColumn("word_distance", F.when(F.col("w0").isNotNull() & long_ & (F.col("rate") * F.col("n_words") >= MIN_COMMON), distance(F.col("w"), F.col("w0"))))
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~diverges).alias("kept"), "class_distance", "word_distance")
