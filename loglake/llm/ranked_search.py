"""Operator 13, ranked lexical search: the best documents for each item of a small table.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. The
terms of all items form one Aho-Corasick automaton, each guarded by a blank on both sides;
a document's separators become blanks, so a scan of the text gives the frequency of every
term directly, in one pass and without any index of documents. A term's entry in the
automaton leads to its items.

The first scan counts documents, terms and each term's documents; the second one scores:
whole-number weights, all sums in 64-bit integers. A task keeps the ``top`` best documents
of each item; a ranked merge ends it. Texts are never shuffled, a term that all documents
hold is one counter in each task.

The automaton goes to every task, so items come in waves of at most ``wave`` bytes of terms;
each wave scans the documents again.

Edge cases: null and empty texts have no term and are not counted; very long texts are
scanned whole, one at a time; equal scores rank by doc_id, those without one last; rows that repeat
are documents of their own; items that share an id are one item, also those without id; an
item without terms has no row; empty tables give none; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.best import NO_ID, TYPE, Best, merged
from loglake.llm.common import saved

TOP = 50
WAVE = 8 << 20
SALT = 16
#: The score of documents of a task is worked out for this many (document, item) cells at a time.
CELLS = 1 << 20

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x80:] = True
_IS_TERM[[c for c in range(128) if chr(c).isalnum()]] = True
#: Separators become blanks, A-Z lower case, all other bytes stay.
_GUARD = bytes(c + 32 if 65 <= c <= 90 else c if _IS_TERM[c] else 32 for c in range(256))
_N, _L = -1, -2
_AUTOMATA: dict[tuple, object] = {}


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(_utf8(text or "").translate(_GUARD).decode("utf-8", "surrogatepass"))


def count_terms(raw: bytes) -> int:
    """The number of terms in UTF-8 text: a term begins where a term byte follows another."""
    inside = _IS_TERM[np.frombuffer(raw, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[0]) if len(inside) else 0


@dataclass
class Items:
    """The items of a wave: their ids, all their terms, and for each term the items that hold it."""

    ids: list[int | None]
    terms: list[str]
    starts: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, by_id: dict[int | None, set[str]]) -> Items:
        ids = list(by_id)
        holders: dict[str, list[int]] = {}
        for i, item in enumerate(ids):
            for term in by_id[item]:
                holders.setdefault(term, []).append(i)
        terms = sorted(holders)
        sizes = [len(holders[t]) for t in terms]
        return cls(ids, terms, np.r_[0, np.cumsum(sizes)].astype(np.int64), np.array([i for t in terms for i in holders[t]], np.int64))

    def automaton(self):
        """Built once in a worker. One character stands for one byte of UTF-8."""
        import ahocorasick

        key = (len(self.terms), hash(tuple(self.terms)))
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            made = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                made.add_word(f" {_utf8(term).decode('latin-1')} ", i)
            made.make_automaton()
            _AUTOMATA[key] = made
        return _AUTOMATA[key]


def frequencies(automaton, raw: bytes) -> dict[int, int]:
    """Occurrences in UTF-8 text of each term of the automaton, by the term's number."""
    return Counter(term for _, term in automaton.iter(f" {raw.translate(_GUARD).decode('latin-1')} "))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, int]]:
    """(doc_id, UTF-8 text, number of terms) of the documents that have terms."""
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            raw = _utf8(text.as_py() or "")
            if n := count_terms(raw):
                yield doc_id.as_py(), raw, n


def _counted(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, held = items.automaton(), np.zeros(len(items.terms), np.int64)
    documents = words = 0
    for _, raw, n in _texts(batches):
        documents, words = documents + 1, words + n
        held[list(frequencies(automaton, raw))] += 1
    met = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[met, _N, _L].astype(np.int32)), pa.array(np.r_[held[met], documents, words])], ["term", "n"]
    )


@dataclass
class Statistics:
    documents: int
    words: int
    weights: np.ndarray

    def length_part(self, n: int) -> int:
        """A document's m from its number of terms."""
        return 50 + (50 * n * self.documents) // self.words


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _scored(items: Items, known: Statistics, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, best = items.automaton(), Best(len(items.ids), top)
    width = len(items.ids)
    most = max(1, CELLS // width)
    ids: list[int] = []
    found: list[tuple[int, int, int, int]] = []

    def settle() -> None:
        if not found:
            return
        doc, term, tf, m = np.array(found, np.int64).T
        part = known.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        begin, size = items.starts[term], items.starts[term + 1] - items.starts[term]
        # each term of a document counts for all items that hold the term
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        cell = np.repeat(doc, size) * width + items.items[np.repeat(begin, size) + nth]
        scores = np.zeros(len(ids) * width, np.int64)
        np.add.at(scores, cell, np.repeat(part, size))
        scores = scores.reshape(len(ids), width)
        row, item = np.nonzero((scores > 0) & (scores >= best.floor))
        best.add(item, scores[row, item], np.array(ids, np.int64)[row])

    for doc_id, raw, n in _texts(batches):
        m = known.length_part(n)
        found += [(len(ids), term, tf, m) for term, tf in frequencies(automaton, raw).items()]
        ids.append(NO_ID if doc_id is None else doc_id)
        if len(ids) >= most or len(found) >= CELLS // 16:
            settle()
            ids.clear()
            found.clear()
    settle()
    yield best.rows()


def waves(items: DataFrame, limit: int) -> Iterator[Items]:
    """The items in groups of at most about ``limit`` bytes of terms, whatever their number."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id")
    by_id: dict[int | None, set[str]] = {}
    size = 0
    for row in rows.toLocalIterator():
        if size > limit and row.item_id not in by_id:
            yield Items.of(by_id)
            by_id, size = {}, 0
        words = set(terms_of(row.text))
        by_id.setdefault(row.item_id, set()).update(words)
        size += sum(map(len, words))
    if any(by_id.values()):
        yield Items.of(by_id)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, wave: int = WAVE) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for some in waves(items, wave):
        sent = spark.sparkContext.broadcast(some)
        counts = texts.mapInArrow(lambda batches, sent=sent: _counted(sent.value, batches), "term int, n long")
        # one row for each term of the wave
        held = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if not held.get(_N):
            continue
        weights = np.array([weight(held[_N], held.get(i, 0)) for i in range(len(some.terms))], np.int64)
        known = spark.sparkContext.broadcast(Statistics(held[_N], held[_L], weights))
        rows = texts.mapInArrow(lambda batches, sent=sent, known=known: _scored(sent.value, known.value, top, batches), TYPE)
        # the ids of a wave are as bounded as its terms
        names = spark.createDataFrame(list(enumerate(some.ids)), "group_no int, item_id long")
        best = merged(rows, top, SALT).join(F.broadcast(names), "group_no")
        parts.append(best.select("item_id", F.col("nth").alias("rank"), F.col("id").alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if len(parts) > 1:
        parts = [saved(part, "ranked-search") for part in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
