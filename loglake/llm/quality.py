"""Operator 2, quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). No rule decides: expectation-
maximisation estimates from all documents how often each rule's vote is right on good and
on bad texts, and a text is kept if its posterior probability of being good is at least
``KEEP``. The documents are reduced to counts of vote patterns first, at most 3 ** rules
of them, and each step of the estimation is one aggregation over that small table.

Words that repeat: three-word windows are hashed, and a window is met twice if its
neighbour in hash order is equal; the words such windows cover are counted by gaps between their
positions. A text costs n log n whatever repeats in it, and nothing is shuffled.

Edge cases: a null text counts as empty; a text without a word has zero counts, fails the
base rules and makes every rule abstain; repeated rows are judged alike (and count in the
estimation); an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import saved

KEEP, STEPS = 0.5, 20
BLANKS = r"[\x20\x09-\x0D]+"

#: Name, measure, bad if over, good if under (None: never votes good).
RULES = (
    ("symbols", lambda: F.col("n_symbols") / F.col("n_words"), 0.1, None),
    ("duplicate_lines", lambda: F.col("n_dup_lines") / F.col("n_lines"), 0.3, None),
    ("repeated_words", lambda: F.col("n_repeat_words") / F.col("n_words"), 0.3, None),
    ("shouting", lambda: F.col("n_shouts") / F.col("n_words"), 0.1, None),
    ("word_length", lambda: F.abs(F.col("word_chars") / F.col("n_words") - 5.5), 1.75, 1.25),
    ("sentence_length", lambda: F.abs(F.ln(F.col("n_words") / (F.col("n_ends") + 1)) - 2.5), 2.2, 1.2),
)


def _long(c: Column) -> Column:
    return c.cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.array_remove(F.split("text", BLANKS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("text", F.lit(r"!!+")).alias("n_shouts"),
        F.regexp_count("text", F.lit(r"[.!?]+(?=\s|$)")).alias("n_ends"),
    )
    rows = rows.select(
        "doc_id", "n_symbols", "n_shouts", "n_ends", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
    rows = rows.withColumn(
        "windows", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), window)).otherwise(F.array().cast("array<long>"))
    ).drop("h")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(repeats, placed)).drop("windows")
    met = lambda e, i: (F.get("placed", i - 1)["x"] == e["x"]) | (F.coalesce(F.get("placed", i + 1)["x"] == e["x"], F.lit(False)))
    twice = F.sort_array(F.transform(F.filter("placed", lambda e, i: F.coalesce(met(e, i), F.lit(False))), lambda e: e["i"]))
    rows = rows.withColumn("at", F.when(F.col("placed").isNotNull(), twice)).drop("placed")
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return rows.select(
        "doc_id", *(_long(F.col(c)).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        _long(F.when(F.col("at").isNotNull(), covered).otherwise(0)).alias("n_repeat_words"),
        *(_long(F.col(c)).alias(c) for c in ("n_lines", "n_shouts", "n_ends")),
    )


def votes(counts: DataFrame) -> DataFrame:
    """``counts`` with a vote_<rule> column of each rule."""
    for name, measure, bad, good in RULES:
        x = measure()
        counts = counts.withColumn(f"vote_{name}", F.when(F.col("n_words") == 0, 0).when(x > bad, -1).when(F.lit(good is not None) & (x < (good or 0)), 1).otherwise(0))
    return counts


_VOTES = [f"vote_{r[0]}" for r in RULES]


def _log_odds(model: dict) -> Column:
    """Log odds of good, given the votes and abstentions."""
    parts = [F.lit(model["prior"])]
    for v, chances in model["rules"].items():
        odds = {vote: math.log(good / bad) for vote, (good, bad) in chances.items()}
        parts.append(F.when(F.col(v) == 1, odds[1]).when(F.col(v) == -1, odds[-1]).otherwise(odds[0]))
    return reduce(add, parts)


def estimate(voted: DataFrame, steps: int = STEPS) -> dict:
    """Prior log odds, and of each rule and vote its chance on good and on bad texts.

    A rule's accuracy on good texts is the chance of 1 against that of -1, on bad texts the reverse.
    """
    patterns = saved(voted.groupBy(*_VOTES).agg(F.count("*").cast("double").alias("n")).coalesce(1), "quality-patterns")
    model = {"prior": 1.0, "rules": {v: {1: (0.6, 0.3), 0: (0.35, 0.3), -1: (0.05, 0.4)} for v in _VOTES}}
    for _ in range(steps):
        weight = {"good": F.col("n") * F.col("p"), "bad": F.col("n") * (1 - F.col("p"))}
        sums = [F.sum(w).alias(y) for y, w in weight.items()]
        sums += [F.sum(F.when(F.col(v) == x, w)).alias(f"{y} {v} {x}") for v in _VOTES for x in (-1, 0, 1) for y, w in weight.items()]
        found = patterns.withColumn("p", 1 / (1 + F.exp(-_log_odds(model)))).agg(*sums).first().asDict()
        s = {k: x or 0.0 for k, x in found.items()}
        chance = lambda y, v, x: (s[f"{y} {v} {x}"] + 0.5) / (s[y] + 1.5)  # noqa: B023, E731
        model = {
            "prior": math.log((s["good"] + 1) / (s["bad"] + 1)),
            "rules": {v: {x: (chance("good", v, x), chance("bad", v, x)) for x in (-1, 0, 1)} for v in _VOTES},
        }
    return model


def judge(docs: DataFrame) -> DataFrame:
    """The counts, base_failed, kept and the posterior ``quality`` of ``docs`` (doc_id, text)."""
    voted = votes(saved(measures(docs), "quality-counts"))
    quality = 1 / (1 + F.exp(-_log_odds(estimate(voted))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (quality >= KEEP)).alias("kept"), F.round(quality, 6).alias("quality"),
    )
