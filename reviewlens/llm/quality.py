"""Quality rules: a table of thresholds compiled into projections of built-in expressions, without user functions.

``measures`` computes the counts and ratios of a text; ``compile_rules`` turns the table into one boolean per row.

A null text has no word and counts zero everywhere; ratios with nothing below the line are zero. Nulls in other columns,
repeated rows and an empty table pass through. Columns of the input stay and may not start with ``_q_``; a column named
like a measure is replaced. Very long texts are one row like any other: sorting hashes within the row replaces a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import SPACE, words

# Symbols of the contract, and common words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that it for with as on by this be are was at from an "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et en un une du que pour dans par sur avec il est au qui "
    "el los las y del por con para una su no es lo como se"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text while ``low <= measure <= high``."""

    measure: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (
    Rule("n_words", low=50),
    Rule("repeat_percent", high=50),
)
RULES = (
    Rule("mean_word_length", low=2, high=12),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("upper_word_ratio", high=0.3),
    Rule("mark_per_word", high=0.3),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _ratio(above: Column, below: Column) -> Column:
    return F.when(below > 0, above.cast("double") / below).otherwise(F.lit(0.0))


def _repeat_words() -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Sorting the windows' hashes with their positions brings equal windows together; a window is repeated when a neighbour
    has the same hash. A first look at the distinct hashes spares most texts the rest.
    """
    return F.expr(
        """CASE WHEN size(_q_sorted) = 0 THEN 0L ELSE
        cast(size(array_distinct(flatten(transform(
          filter(_q_sorted, (x, i) ->
            (i > 0 AND x.h = _q_sorted[i - 1].h) OR (i < size(_q_sorted) - 1 AND x.h = _q_sorted[i + 1].h)),
          x -> array(x.i, x.i + 1, x.i + 2))))) AS bigint) END"""
    )


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and ratios that the rules may name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    squeezed = F.length(F.translate(text, SPACE, ""))
    stop = "(?<![^ \\t-\\r])(?i:" + "|".join(dict.fromkeys(STOP_WORDS)) + ")(?![^ \\t-\\r,.])"
    upper = "(?<![^ \\t-\\r])[^ \\t-\\ra-zà-öø-ÿ]*\\p{Lu}{2}[^ \\t-\\ra-zà-öø-ÿ]*(?![^ \\t-\\r])"
    has_word = lambda line: F.length(F.translate(line, SPACE, "")) > 0
    step = docs.withColumns({
        "_q_words": words(F.col("text")),
        "_q_lines": F.filter(F.split(text, "\n"), has_word),
    })
    step = step.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "_q_windows": F.expr(
            "CASE WHEN size(_q_words) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_q_words) - 3),"
            " i -> xxhash64(_q_words[i], _q_words[i + 1], _q_words[i + 2])) END"
        ),
    })
    step = step.withColumn("_q_sorted", F.expr(
        "CASE WHEN size(_q_windows) = size(array_distinct(_q_windows)) THEN cast(array() AS array<struct<h: bigint, i: int>>) ELSE"
        " sort_array(transform(_q_windows, (h, i) -> struct(h, i))) END"))
    step = step.withColumns({
        "word_chars": squeezed.cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(),
        "_q_stop": F.regexp_count(text, F.lit(stop)),
        "_q_upper": F.regexp_count(text, F.lit(upper)),
        "_q_marks": F.length(text) - F.length(F.translate(text, "!?", "")),
        "_q_bullets": F.size(F.filter("_q_lines", lambda x: x.rlike("^[ \\t]*[-*\\u2022]"))),
        "_q_dots": F.size(F.filter("_q_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    })
    n, lines = F.col("n_words"), F.size("_q_lines")
    step = step.withColumns({
        "repeat_percent": F.col("n_repeat_words") * 100 / F.greatest(n, F.lit(1)),
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbols_per_word": _ratio(F.col("n_symbols"), n),
        "stop_word_ratio": _ratio(F.col("_q_stop"), n),
        "upper_word_ratio": _ratio(F.col("_q_upper"), n),
        "mark_per_word": _ratio(F.col("_q_marks"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.col("_q_bullets"), lines),
        "ellipsis_line_ratio": _ratio(F.col("_q_dots"), lines),
    })
    return step.drop(*[c for c in step.columns if c.startswith("_q_")])


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table holds."""
    kept = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            kept = kept & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            kept = kept & (F.col(rule.measure) <= rule.high)
    return kept


def apply_rules(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measures`` with base_failed and kept."""
    failed = ~compile_rules(base)
    return measures(docs).withColumns({"base_failed": failed, "kept": ~failed & compile_rules(rules)})
