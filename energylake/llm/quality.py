"""Quality rules: a threshold table compiled into one projection.

Everything is built from Spark's own functions.  `measures` turns a text into
counts, `RULES` names a ratio of two counts with its bounds, and `verdict`
compiles the table into one boolean column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, let, words_of

WINDOW = 8
MIN_WORDS = 20
#: repeated words allowed, in percent of the words
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

#: frequent words of the corpus languages: en, fr, de, es
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by this have from or an "
    "la le les de des et un une du en que qui est pour dans sur pas au par "
    "der die das und von zu mit den ist nicht ein eine auf für im dem sich "
    "el los las y del se con una por para no su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep texts with least <= count / per <= most; applies from `from_words` words."""

    count: str
    per: str
    least: float | None = None
    most: float | None = None
    from_words: int = MIN_WORDS


RULES = (
    Rule("word_chars", "n_words", least=2.0, most=15.0),
    Rule("n_symbols", "n_words", most=0.3),
    Rule("n_stop_words", "n_words", least=0.01, from_words=100),
    Rule("n_dup_lines", "n_lines", most=0.5),
    Rule("n_echoes", "n_words", most=0.3),
)


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_echoes", "n_stop_words",
)


def _starts_of_repeats(hashes: Column) -> Column:
    """Ascending places (from 0) of the windows whose hash occurs twice or more."""

    def among(ordered: Column) -> Column:
        last = F.size(ordered) - 1

        def twin(k: Column) -> Column:
            own = F.get(ordered, k)["h"]
            return (own == F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"]) & (k > 0) | (
                own == F.get(ordered, F.least(k + 1, last))["h"]
            ) & (k < last)

        places = F.filter(F.sequence(F.lit(0), last), twin)
        return F.array_sort(F.transform(places, lambda k: F.get(ordered, k)["i"]))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.array_sort(pairs), among)


def _covered(starts: Column, window: int) -> Column:
    """Words under windows that begin at the ascending `starts`."""
    spans = F.transform(
        starts,
        lambda p, k: F.least(
            F.coalesce(F.get(starts, k + 1) - p, F.lit(window)), F.lit(window)
        ),
    )
    return F.aggregate(spans, F.lit(0), lambda a, b: a + b)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in `window`-word windows that occur at least twice in the text.

    Windows are compared by the hash of their words' hashes.  Only texts in which
    some hash comes twice are sorted.
    """
    codes = F.transform(words, lambda w: F.xxhash64(w))

    def count(codes: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(codes) - (window - 1)),
            lambda i: F.xxhash64(F.slice(codes, i, window)),
        )
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
                let(_starts_of_repeats(h), lambda s: _covered(s, window))
            ),
        )

    return F.when(F.size(words) <= window, 0).otherwise(let(codes, count))


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The counts that rules refer to.  `words` are the words of the text, as a bound variable."""
    solid = F.regexp_replace(text, WORD_GAP, "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = list(STOP_WORDS)
    return {
        "n_words": F.size(words),
        "word_chars": F.length(solid),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words),
        # words that only say again the one before
        "n_echoes": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))),
    }


def verdict(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition on a struct of `measures`."""
    kept = F.lit(True)
    for rule in rules:
        count, per = counts[rule.count], counts[rule.per]
        good = F.lit(True)
        if rule.least is not None:
            good &= count >= per * rule.least
        if rule.most is not None:
            good &= count <= per * rule.most
        kept &= good | (counts["n_words"] < rule.from_words)
    return kept


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (
        counts["n_repeat_words"] * 100 > counts["n_words"] * MAX_REPEAT_PERCENT
    )


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the counts of `measures`, base_failed and kept.

    One expression that splits the text once and takes each count once, also where the
    optimizer moves it into a filter.
    """

    def judge(counts: Column) -> Column:
        failed = base_failed(counts)
        return F.struct(
            *[counts[c].alias(c) for c in COUNTS],
            failed.alias("base_failed"),
            (~failed & verdict(counts, rules)).alias("kept"),
        )

    def count(words: Column) -> Column:
        found = measures(text, words)
        return let(F.struct(*[found[c].cast("long").alias(c) for c in COUNTS]), judge)

    return let(words_of(text), count)


def quality(
    docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """All rows and columns of `docs` in a struct `row`, with counts and verdict.

    Columns: row, the counts of `measures` (long), base_failed, kept.  A null or
    blank text has no words and is not kept.  Every row is judged by itself, so
    repeated rows get the same verdict; no rows give no rows; further columns of
    any name stay inside `row`.
    """
    return _judged(docs, text_col, rules).select("row", "judged.*")


def _judged(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        judged(text, rules).alias("judged"),
    )


def keep_good(
    docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns as they were."""
    return _judged(docs, text_col, rules).filter("judged.kept").select("row.*")
