"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histograms of character classes and of its language's most
common words (of any length) are compared with those of the language as a
whole by Jensen-Shannon distance (base 2, so between 0 and 1). The references
are counted over all rows. How far words can be from a reference depends on
how much of it the common words make up, so a document fails by a share of
the distance that a text without any of them has.

Defined cases: a null text is an empty one and fails the base rules; a null
language, or one with too few words for a reference, is held against the
character classes and common words of all documents together (words only if
these have enough); of words equally common the one that sorts first counts;
texts of any length are counted whole; repeated rows and ids are judged one by
one; an empty table gives no row; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import free, remove, words, written

CLASSES = ("letters", "capitals", "digits", "spaces", "symbols", "punctuation")


@dataclass(frozen=True)
class QualityRules:
    """min_words, max_repeat_percent: base rules. common_words: words in a language's word histogram.
    max_class_distance: a document beyond it fails, and so does one beyond max_word_share of the distance that
    no common word at all has. guard_words: words that a document needs for its word histogram to be compared.
    reference_words: words that a language needs for a reference."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 16
    max_class_distance: float = 0.25
    max_word_share: float = 0.95
    guard_words: int = 50
    reference_words: int = 2000


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeated(grams: Column) -> Column:
    """Words that lie in windows found twice or more: the windows are sorted by value, those equal to a
    neighbour give their places, and the places give the words they cover."""

    def places(pairs: Column) -> Column:
        like = lambda x, j: F.coalesce(x["g"] == F.get(pairs, j)["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda x, j: like(x, j - 1) | like(x, j + 1)), lambda x: x["i"]))

    paired = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    found = F.transform(F.array(paired), places)[0]
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    step = lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at"))
    return F.aggregate(found, start, step, lambda a: a["n"])


def common_words(docs: DataFrame, rules: QualityRules = QualityRules()) -> tuple[DataFrame, Row | None]:
    """A written table of each language with enough words: ref_lang, ref_words, and their shares of all words with the rest's last
    (word_shares); and the same of all documents together. Counted over all rows."""
    each = docs.select(F.col("lang").alias("ref_lang"), F.explode(words(F.lower("text"))).alias("word"))
    counts = written(each.groupBy("ref_lang", "word").count(), "quality-words")
    rank = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("count"), "word"))
    top = counts.where(F.col("ref_lang").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= rules.common_words)
    in_all = counts.groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word").limit(rules.common_words)

    def shares(top: DataFrame, sums: DataFrame, *key: str) -> DataFrame:
        lists = top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "word"))).alias("top"))  # common_words entries
        joined = (lists.join(sums, list(key)) if key else lists.crossJoin(sums)).where(F.col("all_words") >= rules.reference_words)  # without a key: a row each
        known = F.transform("top", lambda t: -t["less"] / F.col("all_words"))
        rest = 1 - F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
        return joined.select(*key, F.col("top.word").alias("ref_words"), F.concat(known, F.array(rest)).alias("word_shares"))

    total = F.sum("count").alias("all_words")
    found = written(shares(top, counts.groupBy("ref_lang").agg(total), "ref_lang"), "quality-languages"), shares(in_all, counts.agg(total)).first()
    remove(counts)
    free(docs.sparkSession)
    return found


def features(docs: DataFrame, refs: DataFrame | None = None, in_all: Row | None = None) -> DataFrame:
    """What the rules look at: a row per document with its id, language, counts, and of the words of its
    reference how often it has each (seen; null without a reference) and their shares there (word_shares)."""
    text, w = F.col("text"), F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    grams = F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram)).otherwise(F.array().cast("array<bigint>"))
    base = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.lit(None)
    if refs is None:
        base = base.withColumns({"ref_words": none.cast("array<string>"), "word_shares": none.cast("array<double>")})
    else:
        base = base.join(refs, F.col("lang") == F.col("ref_lang"), "left").drop("ref_lang")
    if in_all is not None:
        pooled = {"ref_words": F.array(*map(F.lit, in_all["ref_words"])), "word_shares": F.array(*map(F.lit, in_all["word_shares"]))}
        base = base.withColumns({k: F.coalesce(k, v) for k, v in pooled.items()})
    split = base.withColumn("words", words(text))
    counted = split.select(
        "doc_id",
        "lang",
        "ref_words",
        "word_shares",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(text).cast("long").alias("n_chars"),
        _count(text, r"[#*$%&|<>]+").alias("n_symbols"),
        _count(text, r"[A-Z]+").alias("capitals"),
        _count(text, r"[0-9]+").alias("digits"),
        _count(text, r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]+").alias("punctuation"),
        lines.alias("lines"),
        grams.alias("grams"),
        F.lower(F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))).alias("apart"),
    )
    g, n, apart = F.col("grams"), F.col("lines"), F.col("apart")
    found = counted.select("*", F.size(F.array_distinct(g)).alias("distinct_grams"))
    times = lambda x: (F.octet_length(apart) - F.octet_length(F.replace(apart, F.concat(F.lit(" "), x, F.lit(" ")), F.lit("")))) / (F.octet_length(x) + 2)
    return found.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"),
        F.when(F.col("distinct_grams") == F.size(g), F.lit(0)).otherwise(_repeated(g)).cast("long").alias("n_repeat_words"),
        F.array(
            F.col("word_chars") - F.col("capitals") - F.col("digits") - F.col("n_symbols") - F.col("punctuation"),
            F.col("capitals"), F.col("digits"), F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"), F.col("punctuation"),
        ).alias("classes"),
        F.transform("ref_words", times).alias("seen"),
        "word_shares",
    )


def class_shares(found: DataFrame, by_word: DataFrame) -> tuple[DataFrame, list[float]]:
    """The class shares of each language that has enough words (ref_lang, ref_classes), and those of all
    documents. by_word: the languages that have."""
    sums = [F.sum(F.col("classes")[i]).cast("double").alias(c) for i, c in enumerate(CLASSES)]
    shares = F.array(*(F.col(c) / sum((F.col(x) for x in CLASSES[1:]), F.col(CLASSES[0])) for c in CLASSES))
    by_lang = found.groupBy(F.col("lang").alias("ref_lang")).agg(*sums).join(by_word.select("ref_lang"), "ref_lang")
    everything = found.agg(*sums).select(shares.alias("all_classes")).first()["all_classes"]  # six numbers
    return by_lang.select("ref_lang", shares.alias("ref_classes")), [float(x if x is not None else 0) for x in everything or [0] * len(CLASSES)]


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def farthest(shares: Column) -> Column:
    """The distance of a text that has none of the words from their shares (the rest's last)."""
    rest = F.get(shares, F.size(shares) - 1)
    return F.sqrt((1 - rest + F.log2(2 / (1 + rest)) + F.when(rest > 0, rest * F.log2(2 * rest / (1 + rest))).otherwise(F.lit(0.0))) / 2)


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """A row per document: doc_id, the base counts, base_failed, kept, and both distances (null where they
    aren't compared)."""
    by_word, in_all = common_words(docs, rules)
    few = by_word.count() <= 10_000  # rows of a few hundred bytes each
    found = written(features(docs, F.broadcast(by_word) if few else by_word, in_all), "quality")
    by_class, overall = class_shares(found, by_word)
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    own = F.transform("classes", lambda c: c / F.col("n_chars"))
    joined = found.join(F.broadcast(by_class) if few else by_class, F.col("lang") == F.col("ref_lang"), "left").withColumn("n_chars", n_chars)
    seen = F.transform("seen", lambda x: x / F.col("n_words"))
    doc_shares = F.concat(seen, F.array(1 - F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)))
    measured = joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("n_chars") > 0, distance(own, F.coalesce("ref_classes", F.array(*map(F.lit, overall))))).alias("class_distance"),
        F.when((F.col("n_words") >= rules.guard_words) & F.col("seen").isNotNull(), distance(doc_shares, F.col("word_shares"))).alias("word_distance"),
        (rules.max_word_share * farthest(F.col("word_shares"))).alias("most"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    near = (F.col("class_distance") <= rules.max_class_distance) & F.coalesce(F.col("word_distance") <= F.col("most"), F.lit(True))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(near, F.lit(False))).alias("kept"), "class_distance", "word_distance")
