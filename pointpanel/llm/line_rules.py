"""Quality rules, line first: rules judge lines, failing lines go, and a document that loses too much text is rejected.

Built from DataFrame functions only. Every document is judged by itself, so there is no shuffle.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged one by one; further
columns of the input are passed through by ``clean_lines`` (its own columns win where names clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bytes that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: A line passes the punctuation rule if it ends a sentence or clause, or is long enough to be running text.
SENTENCE_END = "[.!?:;,\\x{2026}\\x{3002}\\x{FF01}\\x{FF1F}][\"')\\]\\x{201D}\\x{2019}\\x{BB}]*$"
#: Bars, angle quotes and bullets between the entries of a menu or breadcrumb.
NAVIGATION = "(^|[\\x20\\t])[|\\x{BB}\\x{203A}\\x{B7}\\x{2022}>]+([\\x20\\t]|$)"
BOILERPLATE = (
    "(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies"
    "|enable javascript|skip to (main )?content|sign (in|up) (to|for|now)|log in to|subscribe to our|share on (facebook|twitter)"
    "|click here to|lorem ipsum|powered by )"
)
#: A word that carries a run of marks, as in shouted or decorated junk.
DECORATED = "([#*$%&]{2,}|!{2,})$"


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _paired(hashes: Column, gap: int) -> Column:
    """Hashes of windows twice as long: each joined with the one that starts ``gap`` later."""
    return F.when(F.size(hashes) > gap, F.transform(
        F.slice(hashes, 1, F.size(hashes) - gap), lambda h, i: F.xxhash64(h, F.get(hashes, i + gap)),
    )).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice: sorting brings equal windows together, then the covered stretches add up."""
    def of_sorted(order: Column) -> Column:
        twice = F.filter(order, lambda w, i: (w["h"] == F.get(order, i - 1)["h"]) | (w["h"] == F.get(order, i + 1)["h"]))
        return let(F.array_sort(F.transform(twice, lambda w: w["i"])), lambda at: F.aggregate(
            F.transform(at, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), v + WINDOW) - v)),
            F.lit(0), lambda total, x: total + x,
        ))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, of_sorted)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of eight words that is found at least twice in the text."""
    def counted(eight: Column) -> Column:
        return F.when(F.size(F.array_distinct(eight)) == F.size(eight), F.lit(0)).otherwise(_covered(eight))

    def of(words: Column) -> Column:
        one = F.transform(words, lambda x: F.xxhash64(x))
        return let(one, lambda h: let(_paired(h, 1), lambda two: let(_paired(two, 2), lambda four: let(_paired(four, 4), counted))))

    return F.when(F.size(words) > WINDOW, of(words)).otherwise(F.lit(0))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = (
        docs.withColumn("_words", words_of(F.col("text")))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.size(F.split(text, SYMBOLS)) - 1).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        })
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def line_fails(line: Column) -> Column:
    """The verdict on one line: boilerplate, navigation, decorated words, shouting, or a short line that ends no sentence.

    An empty line never fails.
    """
    body = F.btrim(line, F.lit(BLANKS))
    words = F.size(F.split(body, BLANK_RUN))
    bars = F.size(F.split(body, NAVIGATION)) - 1
    decorated = F.size(F.filter(F.split(body, BLANK_RUN), lambda w: w.rlike(DECORATED)))
    capitals = F.length(F.regexp_replace(body, "[^A-Z]", ""))
    small = F.length(F.regexp_replace(body, "[^a-z]", ""))
    return (body != "") & (
        body.rlike(BOILERPLATE)
        | (bars * 5 >= words) & (bars >= 2)
        | (decorated * 2 > words)
        | (capitals > 4 * small) & (capitals >= 20)
        | (words < 3) & ~body.rlike(SENTENCE_END)
    )


def clean_lines(docs: DataFrame, max_loss_percent: int = 50) -> DataFrame:
    """``docs`` judged line by line.

    Adds the base counts, ``n_lines`` and ``n_failed_lines`` (lines with a word), ``lost_chars`` (of words in failed lines),
    ``kept``, and ``cleaned``: the text without its failed lines. A document is kept if it passes the base rules and loses at most
    ``max_loss_percent`` of the characters of its words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = lambda lines: F.aggregate(
        lines, F.lit(0).cast("long"), lambda n, line: n + F.length(F.translate(line, BLANKS, "")))
    judged = base_counts(docs).withColumn(
        "_judged", F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), line_fails(line).alias("fails"))))
    failed = F.transform(F.filter("_judged", lambda x: x["fails"]), lambda x: x["line"])
    stays = F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"])
    judged = judged.withColumn("_failed", failed)
    return judged.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_failed_lines": F.size("_failed").cast("long"),
        "lost_chars": solid(F.col("_failed")),
        "cleaned": F.array_join(stays, "\n"),
    }).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_loss_percent * F.col("word_chars"))
    ).drop("_words", "_lines", "_judged", "_failed")
