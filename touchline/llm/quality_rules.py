"""Line-first cleaning of documents with column expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses too many of its words is rejected. Repetition and
length are measured on the whole text before the cleaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import SPACE_CLASS, SPACES, WORD, free_name

SYMBOLS = "#*$%&|<>"
#: Fixed phrases of licences, consent banners and page furniture, in lower case.
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "accept cookies", "enable javascript", "lorem ipsum", "click here", "read more", "sign in",
    "log in", "subscribe", "share this", "back to top", "skip to content",
)
#: What stands between the entries of a menu or a breadcrumb trail.
SEPARATOR = " (?:[|]|>|»|·|::) "
MARK = "[#*$%&|<>!]"
ENDINGS = ".!?:;…。！？\"'”’)»"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_LOST_PERCENT = 50


def _words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def failed_rule(line: Column) -> Column:
    """The first rule that a line fails, or null: navigation, punctuation or boilerplate.

    navigation: at least three menu separators, or as many as a third of its words.
    punctuation: a symbol of markup or a ``!`` for at least every second word, or ten words
    and more without any mark at their end and without a stop or comma inside. boilerplate:
    it holds a fixed phrase and has fewer than 25 words.
    """
    lower = F.lower(line)
    words = _words_in(line)
    phrase = F.lit(False)
    for text in BOILERPLATE:
        phrase = phrase | F.contains(lower, F.lit(text))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    marks = F.regexp_count(line, F.lit(MARK))
    ended = F.right(F.btrim(line, F.lit(SPACES)), F.lit(1)).isin(*ENDINGS)
    return (
        F.when((separators >= 1) & ((separators >= 3) | (separators * 3 >= words)), "navigation")
        .when(((marks >= 3) & (marks * 2 >= words)) | (~ended & (words >= 10) & ~line.rlike("[.,;:!?]")), "punctuation")
        .when((words < 25) & phrase, "boilerplate")
    )


def _repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words that lie in a window of eight words found twice or more in the same text.

    Window hashes are combined pairwise (2, 4, 8 words), so the work is linear. Only texts
    whose hashes are not all distinct sort them to find the places.
    """
    h1, h2, h4, h8, places = (free_name(df, f"{out}_{part}") for part in ("h1", "h2", "h4", "h8", "places"))

    def paired(source: str, step: int) -> Column:
        whole = F.col(source)
        return F.transform(
            F.slice(whole, F.lit(1), F.greatest(F.size(whole) - step, F.lit(0))),
            lambda value, at: F.xxhash64(value, F.get(whole, at + step)),
        )

    df = df.withColumn(h1, F.transform(F.col(words), lambda word: F.xxhash64(word)))
    df = df.withColumn(h2, paired(h1, 1)).withColumn(h4, paired(h2, 2)).withColumn(h8, paired(h4, 4))
    ordered = F.sort_array(
        F.transform(F.col(h8), lambda value, at: F.struct(value.alias("h"), at.alias("at")))
    )
    df = df.withColumn(
        places,
        F.when(F.size(F.array_distinct(F.col(h8))) < F.size(F.col(h8)), ordered),
    )
    kept = F.filter(
        F.col(places),
        lambda entry, at: F.coalesce(
            (F.get(F.col(places), at - 1)["h"] == entry["h"]) | (F.get(F.col(places), at + 1)["h"] == entry["h"]),
            F.get(F.col(places), at - 1)["h"] == entry["h"],
            F.get(F.col(places), at + 1)["h"] == entry["h"],
            F.lit(False),
        ),
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("reach"))
    covered = F.aggregate(
        F.sort_array(F.transform(kept, lambda entry: entry["at"])),
        start,
        lambda state, at: F.struct(
            (state["total"] + at + WINDOW - F.greatest(at, state["reach"])).alias("total"),
            (at + WINDOW).alias("reach"),
        ),
        lambda state: state["total"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(h1, h2, h4, h8, places)


def clean(
    docs: DataFrame,
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
    max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """Add measures, the cleaned text and the verdict to every row.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text (lines that pass every rule), failed_lines (failed rule and number of lines),
    kept_words, kept. Columns of these names in ``docs`` are replaced. A null text counts as
    empty, and an empty text fails (too few words) and is not kept. Repeated rows are judged
    alike, each on its own; an empty table gives an empty result. Nothing is shuffled.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text",
             "failed_lines", "kept_words", "kept"]
    df = docs.drop(*(name for name in added if name != text))
    body, words, lines, verdicts = (free_name(df, f"rule_{part}") for part in ("body", "words", "lines", "verdicts"))
    whole = F.col(body)
    df = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(whole, SPACE_CLASS + "+"), lambda word: word != ""))
    df = df.withColumn(lines, F.split(whole, "\n", -1))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join(F.col(words), "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long"))
    df = _repeated_words(df, words, "n_repeat_words")
    df = df.withColumn(
        verdicts,
        F.transform(
            F.filter(F.col(lines), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
            lambda line: F.struct(line.alias("line"), failed_rule(line).alias("rule")),
        ),
    )
    df = df.withColumn(
        "n_dup_lines",
        (F.size(verdicts) - F.size(F.array_distinct(F.col(verdicts)["line"]))).cast("long"),
    )
    passed = F.filter(F.col(verdicts), lambda entry: entry["rule"].isNull())
    df = df.withColumn("clean_text", F.array_join(F.transform(passed, lambda entry: entry["line"]), "\n"))
    df = df.withColumn(
        "failed_lines",
        F.transform(
            F.array(F.lit("boilerplate"), F.lit("navigation"), F.lit("punctuation")),
            lambda rule: F.struct(
                rule.alias("rule"),
                F.size(F.filter(F.col(verdicts), lambda entry: entry["rule"] == rule)).alias("lines"),
            ),
        ),
    )
    df = df.withColumn("kept_words", _words_in(F.col("clean_text")).cast("long"))
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")),
    )
    df = df.withColumn(
        "kept",
        ~F.col("base_failed")
        & (100 * (F.col("n_words") - F.col("kept_words")) <= max_lost_percent * F.col("n_words")),
    )
    return df.drop(body, words, lines, verdicts)
