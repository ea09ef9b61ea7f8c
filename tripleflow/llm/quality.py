"""Quality rules: counts that fail a text at once, then its distance from its language.

A text is described by two histograms, of character classes and of the commonest words of
its language.  The references are the summed histograms of all documents of a language.  A
text fails if the Jensen-Shannon divergence (base 2, 0 to 1) between one of its histograms
and the reference is above a limit; a histogram of too few items is not judged.

DataFrame functions only: everything about one document is computed in its own row, and
only the references, at most one row per listed language, are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import SPACE, written

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
# Guards: fewer characters or words than these are not compared.
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DIVERGENCE = 0.08
MAX_WORD_DIVERGENCE = 0.14

# Common function words of the languages with a reference.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to a in is was that for it with as on be at by this are from".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
OTHER = "other"  # all languages without a list: compared by character classes only

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _list_of(lang: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, words in COMMON.items():
        out = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """Counts and histograms of each row.

    ``n_repeat_words``: windows are compared by a 64-bit hash chained over their words, and
    equal ones found by sorting, so a long text costs n log n.
    """
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(OTHER).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "*",
        F.filter(F.split("text", SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _list_of(F.col("lang")).alias("common"),
    )
    # what is left of a text without its small letters is short, and holds all other classes
    left = split.withColumn("rest", F.regexp_replace("text", r"[\p{Ll}\p{Lo}]+", ""))
    count = lambda pattern: F.regexp_count("rest", F.lit(pattern)).cast("long")
    spaces = F.char_length("rest") - F.char_length(F.regexp_replace("rest", SPACE + "+", ""))
    counted = left.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - spaces).cast("long").alias("word_chars"),
        spaces.cast("long").alias("n_spaces"),
        count(SYMBOLS).alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{Nd}").alias("n_digits"),
        count(r"[\p{P}&&[^#*%&]]").alias("n_marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"CASE WHEN size(words) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE "
            f"transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64("
            + ", ".join(f"words[i + {k}]" for k in range(WINDOW))
            + ")) END"
        ).alias("windows"),
        F.transform(
            F.filter("words", lambda w: w.isin(*sorted({w for some in COMMON.values() for w in some}))),
            lambda w: F.array_position("common", w),
        ).alias("found"),
    )
    counted = counted.withColumn("places", F.array_remove("found", 0)).drop("found")
    # sorted windows with their places, only where some window is met twice
    placed = counted.withColumn(
        "sorted",
        F.expr(
            "CASE WHEN size(array_distinct(windows)) = size(windows) THEN NULL "
            "ELSE sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    ).drop("windows")
    twice = placed.withColumn(
        "twice",
        F.expr(
            "sort_array(transform(filter(transform(sorted, (x, k) -> struct(x.i AS i, "
            "x.h <=> get(sorted, k - 1).h OR x.h <=> get(sorted, k + 1).h AS again)), x -> x.again), x -> x.i))"
        ),
    ).drop("sorted")
    size = len(COMMON["en"])
    return twice.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(
            f"coalesce(aggregate(twice, struct(0L AS n, 0L AS upto), (a, i) -> struct("
            f"a.n + i + {WINDOW} - greatest(a.upto, cast(i AS bigint)) AS n, cast(i + {WINDOW} AS bigint) AS upto), a -> a.n), 0L)"
        ).alias("n_repeat_words"),
        F.array(
            "n_upper", "n_digits", "n_marks", "n_symbols", "n_spaces",
            F.greatest(F.lit(0).cast("long"), F.col("word_chars") - F.col("n_upper") - F.col("n_digits") - F.col("n_marks") - F.col("n_symbols")),
        ).alias("char_hist"),
        F.expr(
            f"concat(transform(sequence(1, {size}), k -> cast(size(places) - size(array_remove(places, cast(k AS bigint))) AS bigint)), "
            "array(n_words - size(places)))"
        ).alias("word_hist"),
    )


def references(measures: DataFrame) -> DataFrame:
    """``lang, char_ref, word_ref``: summed histograms; at most five rows."""
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[k]) for k in range(n)))
    return measures.groupBy("lang").agg(
        sums("char_hist", 6).alias("char_ref"), sums("word_hist", len(COMMON["en"]) + 1).alias("word_ref")
    )


def divergence(p: str, q: str) -> Column:
    """Jensen-Shannon divergence of two columns of counts, null if one is empty."""
    total = lambda a: f"nullif(aggregate({a}, 0D, (s, x) -> s + x), 0D)"
    half = "CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0D END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0D END"
    return F.expr(
        f"aggregate(zip_with(transform({p}, x -> x / {total(p)}), transform({q}, x -> x / {total(q)}), "
        f"(a, b) -> {half}), 0D, (s, x) -> s + x) / 2"
    )


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and both divergences; one row per row.

    A null or empty text has no words and fails; null or unlisted languages share one
    reference; repeated rows are judged alike, and null ids kept as they come.
    """
    measures = written(measured(docs), "measures")
    compared = measures.join(F.broadcast(references(measures)), "lang").select(
        "*",
        divergence("char_hist", "char_ref").alias("char_divergence"),
        F.when(F.col("lang") != OTHER, divergence("word_hist", "word_ref")).alias("word_divergence"),
    )
    chars = F.col("word_chars") >= MIN_CHARS
    words = F.col("n_words") >= MIN_WORDS
    far = F.coalesce(chars & (F.col("char_divergence") > MAX_CHAR_DIVERGENCE), F.lit(False)) | F.coalesce(
        words & (F.col("word_divergence") > MAX_WORD_DIVERGENCE), F.lit(False)
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return compared.select(
        *(c.split()[0] for c in COLUMNS.split(", ")),
        failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_divergence", "word_divergence",
    )
