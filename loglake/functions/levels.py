"""Severity functions (Column -> Column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loglake.functions.text import trim_space

# Severity words and the normalised level each one means.
SEVERITY_WORDS = {
    "error": "error",
    "alert": "error",
    "severe": "error",
    "critical": "critical",
    "emergency": "critical",
    "fatal": "critical",
    "warning": "warning",
    "warn": "warning",
    "info": "info",
    "notice": "info",
    "notification": "info",
    "config": "info",
    "debug": "debug",
    "fine": "debug",
    "finer": "debug",
    "finest": "debug",
    "trace": "trace",
}


def _has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda acc, word: acc | word, [text.contains(w) for w in words])


def level_of_word(word: Column) -> Column:
    """Level of a severity word that is trimmed and in lower case."""
    known = F.create_map(*[F.lit(x) for pair in SEVERITY_WORDS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(known, word),
        F.when(_has_any(word, ["critical", "emergency"]), "critical")
        .when(_has_any(word, ["ora-", "error"]), "error")
        .when(word.contains("warn"), "warning"),
    )


def level_in_text(low: Column) -> Column:
    """Level told by free text in lower case; the singular "error" alone means nothing."""
    return (
        F.when(_has_any(low, ["critical", "emergency", "fatal"]), "critical")
        .when(_has_any(low, ["ora-", "errors"]), "error")
        .when(low.contains("warn"), "warning")
    )


def normalize_level(raw: Column) -> Column:
    """Map a severity word to its normalised level, NULL when it means none."""
    return level_of_word(F.lower(trim_space(raw)))


def level_by_content(text: Column) -> Column:
    """Guess a level from free text."""
    return level_in_text(F.lower(text))


def level_from_http_status(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")


def level_or_unknown(level: Column) -> Column:
    return F.coalesce(F.nullif(level, F.lit("")), F.lit("unknown"))
