"""Operator 1, toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps every character to one: case and accents go, look-alike letters become
Latin, digits and signs become the letters they stand for (so ``1``, ``!``, ``l`` and
``i`` are one letter), invisible characters vanish. A term is a word, which counts where it stands alone
(neither neighbour is a letter or digit as written), or a stem, written ``stem*``, which
counts where a word begins with it and goes on. Matches inside an exception phrase
don't count. A text's weight is divided by a power of its length, and a logistic curve
fitted on the learning rows turns it into a score of 0 to 1.

Learning takes at most ``rows`` labelled documents, those with the smallest hashes of
their id, none of them held out. Terms are words and stems with a high log odds of standing in
toxic rows; each must account for toxic rows that the terms before it don't, so words
that only copies of one toxic text have are left out.

Edge cases: null and empty texts score as any text without a match; a document of
conflicting labels counts as toxic; without toxic labels the lexicon is empty and every
score is 0; repeated rows get equal scores; further columns stay as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import held_out, saved

ROWS, CANDIDATES, TERMS, EXCEPTIONS = 20_000, 3_000, 100, 200
STEMS = range(4, 9)
THRESHOLD = 0.3

# Letters that look like Latin ones, and digits or signs that stand for letters.
LOOK_ALIKES = dict(zip("авекмнорстухіѕјԁɡһӏαβεικνορτυχωøłđħıſ", "abekmhopctyxisjdghlabeiknoptuxwoldhis", strict=True))
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}

_WORD = re.compile(r"[^\W_]+")


class _Fold(dict):
    """A table for str.translate that learns each character when it is first met."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        if unicodedata.category(char) in ("Cf", "Mn"):
            self[code] = None
            return None
        char = unicodedata.normalize("NFKD", char)[0].lower()[0]
        char = LOOK_ALIKES.get(char, char)
        self[code] = STAND_INS.get(char, char)
        return self[code]


class _Solid(dict):
    """Aligned with _Fold: "a" where the character as written is a letter or digit."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        self[code] = None if unicodedata.category(char) in ("Cf", "Mn") else "a" if char.isalnum() else " "
        return self[code]


FOLD, SOLID = _Fold(), _Solid()


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    #: phrases of folded words that hold a term and mean no harm
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.25
    intercept: float = -30.0
    slope: float = 0.0

    def score(self, weight: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * weight, -30, 30)))


def fold(text: str) -> str:
    return text.translate(FOLD)


def variants(word: str) -> list[str]:
    """The terms that a folded word can match."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k < len(word))]


def matcher(terms: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    by_text: dict[str, list[str]] = {}
    for term in terms:
        by_text.setdefault(term.removesuffix("*"), []).append(term)
    for text, own in by_text.items():
        automaton.add_word(text, (len(text), own))
    if terms:
        automaton.make_automaton()
    return automaton


def matches(automaton, text: str) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms in the text."""
    if not len(automaton):
        return []
    found = [(end - size + 1, end + 1, term) for end, (size, own) in automaton.iter(fold(text)) for term in own]
    if found:
        solid = text.translate(SOLID)
        found = [x for x in found if solid[x[0] - 1:x[0]] != "a" and (solid[x[1]:x[1] + 1] == "a") == (x[2][-1] == "*")]
    return found


def weigh(text: str | None, terms, exceptions, lexicon: Lexicon) -> float:
    """The text's weight, divided by a power of its length in hundreds of words."""
    found = matches(terms, text) if text else []
    if not found:
        return 0.0
    safe = matches(exceptions, text)
    total = sum(lexicon.weights[p] for a, b, p in found if not any(c <= a and b <= d for c, d, _ in safe))
    return total / (1 + len(text.split()) / 100) ** lexicon.power


def toxicity(lexicon: Lexicon) -> Callable[[Column], Column]:
    """A function of a text column: its score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, exceptions = matcher(list(lexicon.weights)), matcher(lexicon.exceptions)
        for texts in batches:
            weights = np.array([weigh(t, terms, exceptions, lexicon) for t in texts], float)
            yield pd.Series(lexicon.score(weights))

    return score


def _choose(rows: list[tuple[int, list[int]]], size: list[int], count: int, least: float) -> list[int]:
    """Terms in the order in which they account for most toxic rows not yet accounted for; of equals the longest."""
    toxic = [set(t) for y, t in rows if y]
    clean = Counter(i for y, t in rows if not y for i in t)
    chosen: list[int] = []
    while len(chosen) < count:
        gain = Counter(i for t in toxic for i in t)
        for i in clean:
            gain[i] -= 0.5 * clean[i]
        best = min(gain, key=lambda i: (-gain[i], -size[i], i), default=None)
        if best is None or gain[best] < least:
            return chosen
        chosen.append(best)
        toxic = [t for t in toxic if best not in t]
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept, slope and log loss, with a little ridge on the slope."""
    a, b = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.01 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -3, 3)
        a, b = a + step[0], b + step[1]
    p = np.clip(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))), 1e-9, 1 - 1e-9)
    return float(a), float(b), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Lexicon:
    """The lexicon of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    sample = saved(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text is not null").select("toxic", "text"), "toxicity-rows")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for y, text in zip(batch["toxic"], batch["text"], strict=True):
                (toxic if y else clean).update({v for w in set(_WORD.findall(text)) for v in variants(fold(w))})
            names = list(toxic.keys() | clean.keys())
            yield pd.DataFrame({"term": names, "t": [toxic[w] for w in names], "c": [clean[w] for w in names]})

    totals = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = int(totals["t"] or 0), int(totals["n"] - (totals["t"] or 0))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    counted = sample.mapInPandas(words, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    candidates = (
        counted.filter((F.col("t") >= 3) & (F.length("term") >= 3)).withColumn("w", odds).filter("w > 1.5")
        .orderBy(F.desc(F.col("t") * F.col("w")), "term").limit(CANDIDATES).collect()
    )
    names = [r["term"] for r in candidates]
    number = {w: i for i, w in enumerate(names)}

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = matcher(names)
        for batch in batches:
            yield pd.DataFrame({"y": batch["toxic"], "terms": [sorted({number[p] for _, _, p in matches(automaton, t)}) for t in batch["text"]]})

    held = sample.mapInPandas(found, "y int, terms array<int>").filter("size(terms) > 0").collect() if names else []
    chosen = _choose([(r["y"], list(r["terms"])) for r in held], [2 * len(w.removesuffix("*")) - w.endswith("*") for w in names], TERMS, max(3.0, 0.005 * toxic))
    lexicon = Lexicon({names[i]: round(float(candidates[i]["w"]), 4) for i in chosen})
    if not chosen:
        return lexicon

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter()
            for y, text in zip(batch["toxic"], batch["text"], strict=True):
                plain = [fold(w) for w in _WORD.findall(text)]
                hit = {w for w in set(plain) if not lexicon.weights.keys().isdisjoint(variants(w))}
                if hit:
                    seen.update((f"{a} {b}", int(y)) for a, b in set(zip(plain[:-1], plain[1:], strict=True)) if a in hit or b in hit)
            yield pd.DataFrame([(p, y, n) for (p, y), n in seen.items()], columns=["phrase", "y", "n"])

    harmless = (
        sample.mapInPandas(phrases, "phrase string, y int, n long").groupBy("phrase")
        .agg(F.sum(F.col("n") * F.col("y")).alias("t"), F.sum(F.col("n") * (1 - F.col("y"))).alias("c"))
        .filter("t = 0 and c >= 3").orderBy(F.desc("c"), "phrase").limit(EXCEPTIONS).collect()
    )
    lexicon.exceptions = [r["phrase"] for r in harmless]

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, safe = matcher(list(lexicon.weights)), matcher(lexicon.exceptions)
        flat = Lexicon(lexicon.weights, power=0)
        for batch in batches:
            yield pd.DataFrame({
                "y": batch["toxic"], "w": [weigh(t, terms, safe, flat) for t in batch["text"]],
                "n": [1 + len(t.split()) / 100 for t in batch["text"]],
            })

    curve = sample.mapInPandas(weighed, "y int, w double, n double").toPandas()
    fits = [(*_logistic((curve["w"] / curve["n"] ** p).to_numpy(float), curve["y"].to_numpy(float)), p) for p in (0.1, 0.25, 0.5, 1.0)]
    lexicon.intercept, lexicon.slope, _, lexicon.power = min(fits, key=lambda x: x[2])
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round(toxicity(lexicon)(F.col("text")), 6).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
