"""Operator 5, token counts: count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates, in one pass over a word, every vocabulary piece that ends at each
place; dynamic programming carries the best score and its number of pieces from place to
place, and no piece is ever written down. A text's blanks become ``METASPACE`` as the
unigram tokenizer of the tokenizers library does (``Metaspace``, one before the first word if there is none), so
a text's count is the sum over its words, and a word is worked out once per worker.

Tie rules are those of that tokenizer: of paths with equal scores the one whose last
piece starts first wins; a character that no piece covers is unknown, with a score of the
lowest score less 10. Unknown characters count as their UTF-8 bytes where the file has a piece for
each byte, as its byte fallback does; else neighbouring ones are one piece.

The vocabulary is the pieces of a SentencePiece file, without control and byte pieces, with
the file's own scores (``scores="file"``), or the logarithm of a piece's share by Zipf's law
of its rank (``"zipf"``). The file at hand holds merges in order of rank, no unigram model: its
scores are minus the rank. Counts are those of the unigram model with these pieces and
scores, which is not how the file's own tokenizer cuts.

Edge cases: a null or empty text has no token; a very long text is counted word by word; a
very long word costs time in proportion to its length; repeated rows get equal counts; an
empty table gives no row; further columns stay where :func:`token_count` is used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METASPACE = "▁"
_WORKER: dict[tuple, Counter] = {}


def vocabulary(path: str, scores: str = "file") -> list[tuple[str, float]]:
    """(piece, score) of the usable pieces of a SentencePiece file, in its order; the first is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [("<unk>", 0.0)]
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            found.append((model.id_to_piece(i), -math.log(len(found) + 1) if scores == "zipf" else float(model.get_score(i))))
    return found


def has_byte_pieces(path: str) -> bool:
    """Whether the file has a piece for each byte, so that no character is unknown to it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


class Counter:
    """Numbers of pieces, by words met before."""

    def __init__(self, pieces: list[tuple[str, float]], memo: int, byte_fallback: bool = False):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.memo, self.known = memo, {}

    def word(self, text: str) -> int:
        """The number of pieces on the best path.

        State at each place: best score, pieces, start of the last piece. Matches come by
        their end, so every start is settled before it is used.
        """
        size = len(text)
        best, count, last = [-math.inf] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        strange = not self.single.issuperset(text)
        open_unknown, place = [False] * (size + 1), 0
        for end, (length, score) in self.automaton.iter(text):
            end += 1
            if strange:
                while place < end - 1:
                    place += 1
                    self._unknown(text, place, best, count, open_unknown)
            start = end - length
            score += best[start]
            if score > best[end] or score == best[end] and start < last[end]:
                best[end], count[end], last[end] = score, count[start] + 1, start
        while strange and place < size:
            place += 1
            self._unknown(text, place, best, count, open_unknown)
        return count[size]

    def _unknown(self, text: str, place: int, best: list[float], count: list[int], open_unknown: list[bool]) -> None:
        """Settle a place whose matches are all seen: the character before it may be unknown."""
        score = best[place - 1] + self.unknown
        if text[place - 1] not in self.single and score > best[place]:
            best[place], open_unknown[place] = score, True
            pieces = len(text[place - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else not open_unknown[place - 1]
            count[place] = count[place - 1] + pieces

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        if len(known) > self.memo:
            known.clear()
        words = text.replace(" ", METASPACE).removeprefix(METASPACE).split(METASPACE)
        counts = list(map(known.get, words))
        if None in counts:
            for w in {w for w, n in zip(words, counts, strict=True) if n is None}:
                known[w] = self.word(METASPACE + w)
            counts = list(map(known.__getitem__, words))
        return sum(counts)


def token_count(pieces: list[tuple[str, float]], byte_fallback: bool = False, memo: int = 1_000_000) -> Callable[[Column], Column]:
    """A function of a text column: its number of pieces."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (len(pieces), hash(tuple(pieces)), byte_fallback, memo)
        counter = _WORKER.setdefault(key, None) or Counter(pieces, memo, byte_fallback)
        _WORKER[key] = counter
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return count


def count_documents(docs: DataFrame, path: str, scores: str = "file") -> DataFrame:
    """doc_id and n_tokens of every row of ``docs`` (doc_id, text)."""
    count = token_count(vocabulary(path, scores), has_byte_pieces(path))
    return docs.select("doc_id", count(F.col("text").cast("string")).alias("n_tokens"))
