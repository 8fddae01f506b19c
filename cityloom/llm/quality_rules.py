"""Quality rules: base counts, then divergence from language references.

Every text has two histograms: of its characters by class, and of its words, as they
are written, over the ``COMMON`` most common words of each language (and one bin for
all others).  For each language the corpus gives references, the same histograms summed
over all texts of that language.  A text's divergence is its Jensen-Shannon distance
(base 2, 0 to 1) to a reference; a text fits where any reference is near enough, so a
missing or wrong language tag does no harm.  How near follows from the reference itself:
words are too far at ``WORD_SHARE`` of the distance at which a text without any common
word lies.  A text is kept if it passes the base rules and fits in both histograms; a
histogram of fewer than a least number of characters or words says too little and passes.

Only DataFrame and SQL functions are used, inside one row at a time: no text, word
or window is shuffled but the counts of words by language.  What is sent to all tasks are
the references: some numbers and ``COMMON`` words for each value of the language column.

Defined results: a null text has no words and fails the base rules; repeated rows
are judged alike; texts without a language are judged but are in no reference;
of words that are equally common the first by code point are taken; without any
reference no text is rejected for divergence; empty tables give no rows; columns of the
documents keep their names and values, and a new column whose name is taken has an
underscore more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, free_name, table, word_array

#: Common words of a language.
COMMON = 32
LEAST_CHARS, LEAST_WORDS = 200, 80
#: Limit of the distance of characters; clean prose of a reference language stays well below.
CHAR_LIMIT = 0.3
#: Limit of the distance of words, as a share of that of a text without common words.
WORD_SHARE = 0.95
#: Character classes that most texts have few of, by pattern.  Spaces, symbols and bytes
#: beyond one a character come from lengths; all other characters are the last class.
CLASSES = (r"[A-Z]", r"[0-9]+", r"[.,;:!?'\"()-]+")
SYMBOLS = r"[#*$%&|<>]+"


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_words`` (an array) and the base counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_words", word_array(t))
    n = F.size("_words")
    # Whether equal windows exist is told by primitive hashes; places are needed for few texts.
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    rows = rows.withColumn("_win", hashes)
    sorted_ = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_win", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), sorted_))
    same = lambda a, b: F.coalesce(F.get("_win", a)["h"] == F.get("_win", b)["h"], F.lit(False))
    hit = F.filter("_win", lambda x, k: same(k, k - 1) | same(k, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return rows.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length(t) - spaces(t)).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
    }).drop("_win").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def char_counts(t: Column, word_chars: Column, n_symbols: Column) -> Column:
    """Characters by class, as an array: spaces, symbols, further bytes, CLASSES, others."""
    counts = [F.length(t) - word_chars, n_symbols, F.octet_length(t) - F.length(t), *(F.length(t) - F.length(F.regexp_replace(t, c, "")) for c in CLASSES)]
    rest = word_chars
    for c in (counts[1], *counts[3:]):
        rest = rest - c
    return F.array(*counts, rest)


def spaces(t: Column) -> Column:
    """Characters that part words.  Replacements of single characters need no regular expression."""
    bare = t
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.length(t) - F.length(bare)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that sum to 1, base 2."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def sparse_js_distance(seen: Column, rest: Column, q: Column, q_rest: Column) -> Column:
    """``js_distance`` of a histogram that has few bins filled, in the same value: ``seen``
    are structs (i, p) of its filled bins, ``rest`` its share of the last bin, and ``q`` the
    other histogram.  Bins that only the other fills add half of what is left of it."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    both = lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(acc: Column, x: Column) -> Column:
        b = F.get(q, x["i"])
        return F.struct((acc["s"] + both(x["p"], b)).alias("s"), (acc["q"] + b).alias("q"))

    return F.aggregate(seen, zero, add, lambda acc: F.sqrt(F.greatest(F.lit(0.0), (acc["s"] + both(rest, q_rest) + (1 - q_rest - acc["q"])) / 2)))


def bare_distance(common: float) -> float:
    """The distance between a text without common words and a reference that has a share of ``common``."""
    p, q = 1.0, 1.0 - common
    m = (p + q) / 2
    return math.sqrt(max(0.0, (p * math.log2(p / m) + (q * math.log2(q / m) if q else 0.0) + common) / 2))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], list[tuple[list[float], list[float]]]]:
    """Common words of all languages, and for each language the shares by character class
    and by common word (then all others), over all its texts."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null AND text is not null")
    counts = cut(rows.select("lang", F.explode(word_array(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c")))
    t, n = F.col("text"), len(CLASSES) + 4
    per = rows.select("lang", char_counts(t, F.length(t) - spaces(t), F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).alias("c"))
    per = per.groupBy("lang").agg(*(F.sum(F.col("c")[i]).cast("double").alias(f"c{i}") for i in range(n))).orderBy("lang").collect()
    words = {r["lang"]: float(r["m"]) for r in counts.groupBy("lang").agg(F.sum("c").alias("m")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))
    common = sorted({r["w"] for r in counts.withColumn("r", rank).where(F.col("r") <= COMMON).select("w").distinct().collect()})
    of = {(r["lang"], r["w"]): float(r["c"]) for r in counts.where(F.col("w").isin(common)).collect()} if common else {}
    out = []
    for r in per:
        c, m = [r[f"c{i}"] for i in range(n)], words.get(r["lang"], 0.0)
        w = [of.get((r["lang"], x), 0.0) for x in common]
        out.append(([x / sum(c) if sum(c) else 0.0 for x in c], [x / m if m else 0.0 for x in [*w, m - sum(w)]]))
    return common, out


_NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", char_limit: float = CHAR_LIMIT, word_share: float = WORD_SHARE) -> DataFrame:
    """``docs`` with the base counts, ``char_distance``, ``word_distance`` (to the nearest
    references; null under the least sizes) and ``kept``."""
    common, refs = references(docs, text, lang)
    given = [f"__{i}" for i in range(len(docs.columns))]
    t = given[docs.columns.index(text)]
    rows = base(docs.toDF(*given), t)
    t = F.coalesce(F.col(t), F.lit(""))
    rows = rows.withColumn("_chars", F.when(F.length(t) >= LEAST_CHARS, char_counts(t, F.col("word_chars"), F.col("n_symbols"))))
    # Totals are columns of their own: inside a lambda they would be summed for each entry.
    rows = rows.withColumn("_m", F.aggregate("_chars", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("_p", F.transform("_chars", lambda x: F.when(F.col("_m") > 0, x / F.col("_m")).otherwise(0.0)))
    if refs:
        listed = F.array(*map(F.lit, common)) if common else F.array().cast("array<string>")
        all_ = F.array(*(F.struct(F.array(*map(F.lit, c)).alias("c"), F.array(*map(F.lit, w[:-1])).cast("array<double>").alias("w"), F.lit(w[-1]).alias("rest"), F.lit(word_share * bare_distance(1 - w[-1])).alias("limit")) for c, w in refs))
        seen = F.filter("_words", lambda w: w.isin(common)) if common else F.array().cast("array<string>")
        rows = rows.withColumn("_seen", F.when(F.col("n_words") >= LEAST_WORDS, seen)).drop("_words")
        bins = F.transform(F.array_distinct("_seen"), lambda w: F.struct((F.array_position(listed, w) - 1).cast("int").alias("i"), ((F.size("_seen") - F.size(F.array_remove("_seen", w))) / F.col("n_words")).alias("p")))
        rows = rows.withColumns({"_bins": bins, "_rest": (F.col("n_words") - F.size("_seen")) / F.col("n_words")}).drop("_seen")
        word = F.when(F.col("_bins").isNotNull(), F.transform(all_, lambda r: F.struct(sparse_js_distance(F.col("_bins"), F.col("_rest"), r["w"], r["rest"]).alias("d"), r["limit"].alias("limit"))))
        char = F.when(F.col("_p").isNotNull(), F.array_min(F.transform(all_, lambda r: js_distance(F.col("_p"), r["c"]))))
        rows = rows.withColumns({"_far": word, "char_distance": F.round(char, 9)})
        rows = rows.withColumn("word_distance", F.round(F.array_min(F.transform("_far", lambda x: x["d"])), 9))
        far = (F.col("char_distance") > char_limit, ~F.exists("_far", lambda x: x["d"] <= x["limit"]))
        rows = rows.withColumn("kept", ~F.col("base_failed") & ~(F.coalesce(far[0], F.lit(False)) | F.coalesce(far[1], F.lit(False))))
    else:
        rows = rows.withColumns({"char_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    new = []
    for name in _NEW:
        new.append(F.col(name).alias(free_name(docs, name)))
    return rows.select(*(F.col(g).alias(c) for g, c in zip(given, docs.columns, strict=True)), *new)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
