"""Quality rules: counts over a text, and divergence from what a language looks like.

All is DataFrame functions in one pass over the texts: counts, repeated lines, repeated
8-word windows, a histogram of character classes and one of common words. Each language of
the corpus has a list of common words of its own, and the histograms of its rows that pass
the counts add up to its reference. A row is kept if its Jensen-Shannon distances to
its language's reference stay under bounds, which are wider for short texts and for
references of few rows. A row that its own language finds odd, or that has none, is
compared with the language most of whose common words it has. All of that are joins by
language, word and text; no task and no row has all languages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Common words of a language: those with a share of its words of COMMON_SHARE at least, the first
#: OF_LANGUAGE of them.
COMMON_SHARE, OF_LANGUAGE = 0.002, 24
CLASSES = ("lower", "upper", "digit", "symbol", "blank", "wide", "other")

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Bounds of the distances, from 0 to 1, and the least lengths at which they are applied. That of
#: words grows for short texts, by the distance that chance alone gives a text of their length.
MOST_CLASS_DISTANCE = 0.33
MOST_WORD_DISTANCE, CHANCE = 0.32, 0.2
LEAST_CLASS_CHARS = 200
LEAST_COMMON_WORDS = 20
#: What a reference of one row adds to both bounds; one of n rows adds it divided by sqrt(n).
FEW_ROWS = 0.5


def _without(column: str, pattern: str) -> Column:
    return F.regexp_replace(column, pattern, "")


def window_hashes(words: Column, n: Column) -> Column:
    """A hash of each window of 8 words, from hashes of 1, 2 and 4 words side by side."""

    def doubled(h: Column, by: int) -> Column:
        return common.let(h, lambda x: F.zip_with(x, F.slice(x, by + 1, F.size(x)), lambda a, b: F.xxhash64(a, b)))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    return F.slice(doubled(doubled(doubled(ones, 1), 2), 4), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))


def covered_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs more than once: sorted with their places, equal
    hashes stand side by side; their windows' places in order tell what they cover."""

    def repeated(s: Column) -> Column:
        same = lambda e, at: F.coalesce(e.h == F.get(s, at).h, F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e.i))

    places = common.let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    step = lambda acc, p: F.struct((acc.n + F.least(F.lit(WINDOW), p - acc.at)).alias("n"), p.alias("at"))
    return F.aggregate(places, zero, step, lambda acc: acc.n.cast("long"))


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")


def common_words(docs: DataFrame) -> DataFrame:
    """lang, words (its common words, in lower case, the most common first), lang_words (all that
    it has), lang_rows, counted over all rows that have a language.

    A language has few words of COMMON_SHARE and more, so that only these are ranked.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({common.WORD})"))
    named = docs.select(_lang(docs), words.alias("words")).where("lang IS NOT NULL")
    counts = common.staged(named.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    total = common.staged(counts.groupBy("lang").agg(F.sum("n").alias("lang_words"), F.count("*").alias("kinds")), "totals")
    # A language may have most of all words: those that are common are told before any meet by language.
    often = common.lookup(counts, total, "lang", "kinds", counts.count()).where(F.col("n") >= COMMON_SHARE * F.col("lang_words"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = often.withColumn("rank", rank).where(F.col("rank") <= OF_LANGUAGE).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x.word).alias("words"), F.first("lang_words").alias("lang_words"))
    rows = docs.select(_lang(docs)).where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("lang_rows"))
    none = F.array().cast("array<string>")
    return rows.join(best, "lang", "left").select("lang", F.coalesce("words", none).alias("words"), F.coalesce("lang_words", F.lit(0).cast("long")).alias("lang_words"), "lang_rows")


def _text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"))


def features(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, lang, key (of the text), counts, and the two histograms as arrays of longs, for
    each row; that of words by its language's list in lists, or without one of no words."""
    # A character for each common word, in which a text's common words are written for counting.
    letters = [chr(0x4E00 + i) for i in range(OF_LANGUAGE)]
    marks = F.array(*map(F.lit, letters)).cast("array<string>")
    # A list is searched as one text, each word between blanks; where a word's first blank stands,
    # a second text has its character. A longer word is in no list: lower case makes none shorter.
    listed = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("listed")
    marked = F.array_join(F.transform("words", lambda w, i: F.concat(F.get(marks, i), F.repeat(F.lit(" "), F.length(w)))), "").alias("marked")
    longest = F.coalesce(F.array_max(F.transform("words", lambda w: F.length(w))), F.lit(0)).alias("longest")
    lists = common.staged(lists.select("lang", "lang_rows", listed, marked, longest), "listed")
    d = docs.select("doc_id", _lang(docs), F.coalesce("text", F.lit("")).alias("t"))
    total = lists.agg(F.coalesce(F.sum("lang_rows"), F.lit(0))).first()[0]
    named = common.lookup(d.where("lang IS NOT NULL"), lists, "lang", "lang_rows", total).drop("lang_rows")
    d = named.unionByName(d.where("lang IS NULL").withColumns({"listed": F.lit(""), "marked": F.lit(""), "longest": F.lit(0)}))
    d = d.select("doc_id", "lang", "t", "listed", "marked", "longest", _text_key(F.col("t")).alias("key"), F.regexp_extract_all("t", F.lit(f"({common.WORD})")).alias("w"), _without("t", common.SPACE).alias("t1"))
    d = d.withColumns({"t2": _without("t1", "[a-z]+"), "n": F.size("w"), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    d = d.withColumns({"t3": _without("t2", "[A-Z]+"), "hashes": window_hashes(F.col("w"), F.col("n")), "known": F.filter(F.transform(F.filter("w", lambda w: F.length(w) <= F.col("longest")), lambda w: F.concat(F.lit(" "), F.lower(w), F.lit(" "))), lambda w: F.contains("listed", w))})
    d = d.withColumns({"t4": _without("t3", "[#*$%&|<>]+"), "marks": F.array_join(F.transform("known", lambda w: F.substring("marked", F.instr("listed", w), F.lit(1))), "")})
    d = d.withColumns({"t5": _without("t4", "[0-9]+"), "repeats": F.size(F.array_distinct("hashes")) < F.size("hashes")})
    size = lambda c: F.length(c).cast("long")
    wide = size(_without("t5", "[\\x00-\\x7F]+"))
    classes = [size("t1") - size("t2"), size("t2") - size("t3"), size("t4") - size("t5"), size("t3") - size("t4"), size("t") - size("t1"), wide, size("t5") - wide]
    counts = [size("marks") - size(F.replace("marks", F.lit(m), F.lit(""))) for m in letters]
    return d.select(
        "doc_id",
        "lang",
        "key",
        F.col("n").cast("long").alias("n_words"),
        size("t1").alias("word_chars"),
        (size("t3") - size("t4")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered_words(F.col("hashes"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.array(*classes).alias("class_hist"),
        F.array(*counts, F.col("n").cast("long") - size("marks")).alias("word_hist"),
    )


def distance(a: Column, b: Column) -> Column:
    """The Jensen-Shannon distance, from 0 to 1, of two histograms that each add up to 1."""

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    divergence = F.aggregate(F.zip_with(a, b, lambda p, q: half(p, q) + half(q, p)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), divergence / 2))


def shares(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda s, x: s + x)
    return common.let(total, lambda n: F.transform(hist, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def references(found: DataFrame) -> DataFrame:
    """lang, lang_rows, passing (rows that pass the counts), and over these the shares of classes
    and of common words (ref_c, ref_w), for each language that has any."""
    passed = ~F.col("base_failed")
    sums = lambda c, n: F.array(*(F.sum(F.when(passed, F.col(c)[i])) for i in range(n))).alias(c)
    table = found.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("lang_rows"), F.count_if(passed).alias("passing"), sums("class_hist", len(CLASSES)), sums("word_hist", OF_LANGUAGE + 1))
    return table.where("passing > 0").select("lang", "lang_rows", "passing", shares(F.col("class_hist")).alias("ref_c"), shares(F.col("word_hist")).alias("ref_w"))


def other_languages(docs: DataFrame, keys: DataFrame, lists: DataFrame) -> DataFrame:
    """For each text of keys (key, n_rows) that has common words of any language: key, other, the
    language most of whose words it has, and other_hist, its histogram of that language's words.

    The distinct words of a text look up the languages that have them; ties go to the
    smaller language by code point. Texts without such words are left out.
    """
    place = F.posexplode("words").alias("place", "word")
    rows = lists.select("lang", "lang_words", place).groupBy("word").agg(F.collect_list(F.struct("lang", "place")).alias("langs"), F.sum("lang_words").alias("often"))
    known = common.staged(rows, "known")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("key", _text_key(F.col("t")))
    may = common.bit_filter(keys, "key")
    texts = texts.where(may).join(keys.select("key"), "key", "left_semi").dropDuplicates(["key"])
    words = texts.select("key", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(f"({common.WORD})"))).alias("word"))
    words = common.staged(words.where(common.bit_filter(known, "word")).groupBy("key", "word").agg(F.count("*").alias("n")), "met")
    often = words.groupBy("word").agg(F.count("*").alias("rows"))
    met = common.lookup(words, known.drop("often").join(often, "word"), "word", "rows", words.count())
    met = met.select("key", "n", F.inline("langs")).groupBy("key", "lang").agg(F.sum("n").alias("has"), *(F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(f"w{i}") for i in range(OF_LANGUAGE)))
    best = F.min_by(F.struct(F.col("lang").alias("other"), F.array(*(f"w{i}" for i in range(OF_LANGUAGE))).alias("other_hist")), F.struct(-F.col("has"), F.col("lang")))
    return met.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def class_bound(passing: Column) -> Column:
    """The distance of classes from which on a text is odd to a reference of so many rows."""
    return MOST_CLASS_DISTANCE + FEW_ROWS / F.sqrt(passing)


def word_bound(n: Column, passing: Column) -> Column:
    """The distance of common words from which on a text of n words is odd to such a reference.

    A sample of n words from a language lies about sqrt(cells / (8 * n * ln 2)) from it, where
    cells are the language's common words and the rest.
    """
    return F.greatest(F.lit(MOST_WORD_DISTANCE), CHANCE + F.sqrt((OF_LANGUAGE + 1) / (8 * math.log(2) * F.greatest(n, F.lit(1))))) + FEW_ROWS / F.sqrt(passing)


def _compared(rows: DataFrame, hist: Column) -> DataFrame:
    """rows beside their reference (passing, ref_c, ref_w, null without one) with class_distance,
    word_distance and odd; without a reference all are null."""
    rows = rows.withColumns({"class_distance": distance(shares(F.col("class_hist")), F.col("ref_c")), "word_distance": distance(shares(hist), F.col("ref_w"))})
    chars = F.aggregate("class_hist", F.lit(0).cast("long"), lambda s, x: s + x)
    by_class = (chars >= LEAST_CLASS_CHARS) & (F.col("class_distance") > class_bound(F.col("passing")))
    by_words = (F.col("n_words") >= LEAST_COMMON_WORDS) & (F.col("word_distance") > word_bound(F.col("n_words"), F.col("passing")))
    return rows.withColumn("odd", F.when(F.col("passing").isNotNull(), by_class | by_words)).drop("ref_c", "ref_w", "passing")


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, and lang if there is one) -> counts, base_failed, kept, distances.

    A null text has no words. Rows are independent but for the references; repeated rows
    get equal results, an empty table none. A row of a language without any row that passes
    the counts goes by the counts. A row without a language, or odd to its own, is kept if
    it is not odd to the language most of whose common words it has; without such a
    language it is odd, if any language has a reference and it has LEAST_COMMON_WORDS.
    The distances are those to the language that decided, or 0. Other columns are ignored.
    """
    lists = common.staged(common_words(docs), "lists")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = common.staged(features(docs, lists).withColumn("base_failed", failed), "features")
    table = common.staged(references(found), "references")
    total, any_ = found.count(), not table.isEmpty()
    own = common.lookup(found.where(F.col("lang").isNotNull()), table, "lang", "lang_rows", total, "left").drop("lang_rows")
    none = lambda kind: F.lit(None).cast(kind)
    nameless = found.where(F.col("lang").isNull()).withColumns({"class_distance": none("double"), "word_distance": none("double"), "odd": F.lit(any_)})
    judged = _compared(own, F.col("word_hist")).unionByName(nameless)
    judged = common.staged(judged.withColumn("again", ~F.col("base_failed") & F.coalesce("odd", F.lit(False))), "judged")

    # What is odd so far, by text.
    keys = common.staged(judged.where("again").groupBy("key").agg(F.count("*").alias("n_rows")), "keys")
    others = common.staged(other_languages(docs, keys, lists).join(keys, "key"), "others")
    second = common.lookup(judged.where("again").drop("class_distance", "word_distance", "odd"), others, "key", "n_rows", total, "left").drop("n_rows")
    refs = table.select(F.col("lang").alias("other"), "passing", "ref_c", "ref_w", F.col("lang_rows").alias("_rows"))
    with_other = second.where(F.col("other").isNotNull())
    rows = with_other.groupBy("other").agg(F.count("*").alias("rows_"))
    second_refs = refs.join(rows, "other").drop("_rows")
    met = common.lookup(with_other, second_refs, "other", "rows_", total, "left").drop("rows_")
    rest = F.greatest(F.col("n_words") - F.aggregate("other_hist", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    met = _compared(met, F.concat("other_hist", F.array(rest)))
    lost = second.where(F.col("other").isNull()).withColumns({"class_distance": F.lit(1.0), "word_distance": F.lit(1.0), "odd": F.col("n_words") >= LEAST_COMMON_WORDS})
    columns = [*judged.columns]
    done = judged.where("NOT again").unionByName(met.select(columns)).unionByName(lost.select(columns))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    odd = F.coalesce("odd", F.lit(False))
    return done.select(*names, (~F.col("base_failed") & ~odd).alias("kept"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("class_distance", "word_distance")))
