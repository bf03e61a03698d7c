"""Operator 4, language identification: rank-order profiles of n-grams.

A text's n-grams (one to three letters; words are padded on both sides) are ranked by
frequency, the first ``size`` kept. Its distance to a language is the sum, over its
n-grams, of how far out of place each is in the language's own ranking, or ``size`` if it
isn't there. The nearest language wins; ties go to the smaller name.

Profiles are counted over at most ``rows`` documents a language, those with the smallest
hashes of their id, none of them held out. Only text is looked at afterwards.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every
text if nothing could be learned; ties in frequency go by code point; repeated rows get
equal answers; further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import held_out

ROWS, SIZE = 2_000, 400
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for what is no letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.int64)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _TABLE.append(table)
    return _TABLE[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as integers (21 bits a letter, 0 is a word border) and their counts."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate(([0], x, [0]))
    x = x[(x != 0) | np.concatenate(([True], x[:-1] != 0))]
    a, b, c = x[:-2], x[1:-1], x[2:]
    middle = b != 0
    pairs = (x[:-1] << 21) | x[1:]
    codes = np.concatenate((x[x != 0], pairs[pairs != 0] | (1 << 62), ((a << 42) | (b << 21) | c)[middle] ^ np.int64(-1)))
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Rank of each n-gram in each language."""

    def __init__(self, ranks: dict[str, dict[int, int]], size: int = SIZE):
        self.size, self.languages = size, sorted(ranks)
        self.codes = np.array(sorted({c for r in ranks.values() for c in r}), np.int64)
        self.ranks = np.full((len(self.languages), len(self.codes)), -1, np.int64)
        for i, lang in enumerate(self.languages):
            for code, rank in ranks[lang].items():
                self.ranks[i, np.searchsorted(self.codes, code)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(*grams(text), self.size)
        if not len(codes) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.codes, codes).clip(0, max(0, len(self.codes) - 1))
        known = self.codes[at] == codes
        ranks = np.where(known, self.ranks[:, at], -1)
        place = np.arange(len(codes))
        far = np.where(ranks < 0, self.size, np.abs(ranks - place)).sum(1)
        order = np.argsort(far, kind="stable")
        best = far[order[0]]
        second = far[order[1]] if len(order) > 1 else self.size * len(codes)
        return self.languages[order[0]], round(float(1 - best / max(1, best + second)), 6)


def learn(docs: DataFrame, rows: int = ROWS, size: int = SIZE) -> Profiles:
    """Profiles of the languages in ``docs`` (doc_id, text, lang)."""
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    near = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(near)).filter(F.col("n") <= rows).select("doc_id").distinct()
    sample = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = [grams(t) for t in texts]
                codes, places = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": np.bincount(places, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)})

    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranks = (
        sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= size).collect()
    )
    found: dict[str, dict[int, int]] = {}
    for r in ranks:
        found.setdefault(r["lang"], {})[r["code"]] = r["rank"] - 1
    return Profiles(found, size)


def language(profiles: Profiles) -> Callable[[Column], Column]:
    """A function of a text column: struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def predict_documents(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(profiles)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
