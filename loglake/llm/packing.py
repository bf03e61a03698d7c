"""Operator 10, packing: order-preserving dynamic programming over window cuts.

The documents of a partition are one stream of token ids in reading order. Windows of
at most ``size`` tokens are cut at document or sentence ends so that padding plus a
penalty for each cut inside a document is smallest. With ``p`` the position of a cut,

    best[j] = p[j] * -1 + size + penalty[j] + min(best[i] + p[i])   over p[j] - p[i] <= size,

so the best predecessor is the minimum of a sliding window, kept in a monotone queue:
the cost is linear in the number of cuts. A run without a sentence end that is longer
than a window gets forced cuts at a higher penalty.

Text -> ids are those of the tokenizer file for the whole text. It drops white space
and never joins characters across it, so the ids of the space-separated words, found
once per word and worker, are those of the text.

Edge cases: a null or empty text is its end id alone; a very long text is cut; repeated
rows are packed again, each by itself; rows without doc_id are left out; an empty table gives no row; further columns of
the input are ignored. No row moves between tasks: nothing is shuffled, a task holds
``chunk`` tokens and the words it has met (at most ``memo``), and a task that is run
again gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)
SIZE, END_ID = 4096, 2
#: In tokens of padding: a cut inside a document, and one inside a sentence.
SENTENCE_CUT, FORCED_CUT = 24, 4096

#: Words of these characters need no normalisation besides lower case.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ÿ\n]*")
#: How the tokenizer divides lower-case words (fixed by its file), and its runs of letters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zµºªÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ÿ \n]+")
_LETTERS = re.compile(r"[a-zà-öø-ÿ]+")
#: Byte-level vocabularies write bytes that are no printable character as 256 + their rank.
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_WORKER: dict[str, Tokens] = {}


class _Runs(dict):
    """The ids of each part that the tokenizer divides words into, worked out when it is first met."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, run: str) -> bytes:
        self[run] = found = self.ids_of(run)
        return found


class Tokens:
    """The ids of texts, by parts of words met before; words of uncommon characters are kept whole."""

    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo = memo
        self.words: dict[str, bytes] = {}
        self.runs = _Runs(self._run)
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.sentence_end[i] = bool(re.fullmatch(r"[.!?]+</w>", piece))

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _run(self, run: str) -> bytes:
        """The ids of a run of letters: the merges alone, on the run's bytes as the file writes them."""
        if not _LETTERS.fullmatch(run):
            return self._encode(run).tobytes()
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return array("I", [piece.id for piece in self.model.tokenize(run)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word not in self.words:
            plain = _PLAIN.fullmatch(word) and "<|" not in word
            self.words[word] = self._plain(word) if plain else self._encode(word).tobytes()
        return self.words[word]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, _SPLIT.findall(text.lower())))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        for known in (self.words, self.runs):
            if len(known) > self.memo:
                known.clear()
        return [
            self._plain(t) if _PLAIN_TEXT.fullmatch(t) and "<|" not in t
            else b"".join([self._word(w) for w in t.replace("\n", " ").split(" ")]) for t in texts
        ]


def _tokens(path: str, memo: int) -> Tokens:
    if path not in _WORKER:
        _WORKER[path] = Tokens(path, memo)
    return _WORKER[path]


def best_cuts(positions: np.ndarray, penalties: np.ndarray, size: int, last: bool = True) -> list[int]:
    """Indexes of the chosen cuts; ``positions`` rise from 0, no step is over ``size``.

    The last position is cut, and what it leaves unfilled is padding; unless more is to come
    (not ``last``): then the cheapest of the cuts within ``size`` of it ends them.
    """
    p, pen = positions.tolist(), penalties.tolist()
    best, before = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    for j in range(1, len(p)):
        while p[j] - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best[j], before[j] = best[i] + p[i] - p[j] + size + pen[j], i
        value = best[j] + p[j]
        while queue and best[queue[-1]] + p[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    if not last:
        near = int(np.searchsorted(positions, p[j] - size))
        j = min(range(j, near - 1, -1), key=best.__getitem__)
    while j > 0:
        cuts.append(j)
        j = before[j]
    return cuts[::-1]


class _Stream:
    """The open tokens of a partition: documents, or the rest of one, not yet in a window."""

    def __init__(self, tokens: Tokens, size: int, end_id: int, chunk: int, base: int):
        self.tokens, self.size, self.chunk = tokens, size, chunk
        self.end = np.array([end_id], "<u4").tobytes()
        self.open: list[tuple[int, int, int, bytes]] = []  # id, start in document, document's tokens, ids
        self.count, self.sequence = 0, base

    def add(self, doc_id: int, ids: bytes) -> None:
        ids += self.end
        self.open.append((doc_id, 0, len(ids) // 4, ids))
        self.count += len(ids) // 4

    def _cut_positions(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = np.full(len(flat) + 1, -1, np.int8)
        kind[1:][self.tokens.sentence_end[flat]] = 1
        kind[ends] = 0
        kind[0] = 0
        gaps = np.flatnonzero(kind >= 0)
        for a, b in zip(gaps[:-1], gaps[1:], strict=True):
            if b - a > self.size:
                kind[np.arange(b - self.size, a, -self.size)] = 2
        at = np.flatnonzero(kind >= 0)
        return at, np.array([0, SENTENCE_CUT, FORCED_CUT])[kind[at]]

    def windows(self, last: bool) -> list[tuple]:
        """Rows of the windows that are settled; the last one stays open until ``last``."""
        if not self.open:
            return []
        flat = np.frombuffer(b"".join([x[3] for x in self.open]), "<u4")
        ends = np.cumsum([len(x[3]) // 4 for x in self.open])
        at, penalties = self._cut_positions(flat, ends)
        cuts = [0, *at[best_cuts(at, penalties, self.size, last)].tolist()]
        rows, k, used = [], 0, 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            offset = 0
            while a + offset < b:
                doc_id, start, total, ids = self.open[k]
                take = min(len(ids) // 4 - used, b - a - offset)
                piece = ids[4 * used:4 * (used + take)]
                rows.append((doc_id, start + used, take, zlib.crc32(piece), total, self.sequence, offset, b - a))
                offset, used = offset + take, used + take
                if used == len(ids) // 4:
                    k, used = k + 1, 0
            self.sequence += 1
        rest = self.open[k:]
        if rest and used:
            doc_id, start, total, ids = rest[0]
            rest[0] = (doc_id, start + used, total, ids[4 * used:])
        self.open, self.count = rest, sum(len(x[3]) // 4 for x in rest)
        return rows


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, chunk: int = 1 << 18, memo: int = 1_000_000) -> DataFrame:
    """Pieces of the documents (``doc_id``, ``text``) in sequences of at most ``size`` tokens.

    ``tokenizer`` is the file on every worker. ``chunk`` tokens are laid out at a time; what
    would not fill a window goes on to the next chunk, so only a partition's last one is open-ended.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _tokens(tokenizer, memo)
        stream = None
        for batch in batches:
            stream = stream or _Stream(tokens, size, end_id, chunk, int(batch["part"].iloc[0]) << 36)
            doc_ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for at in range(0, len(texts), 500):
                rows = []
                for doc_id, ids in zip(doc_ids[at:at + 500], tokens.ids(texts[at:at + 500]), strict=True):
                    stream.add(doc_id, ids)
                    if stream.count >= chunk:
                        rows += stream.windows(last=False)
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES)
        if stream and stream.open:
            yield pd.DataFrame(stream.windows(last=True), columns=_NAMES)

    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.spark_partition_id().alias("part"),
    ).filter("doc_id is not null").mapInPandas(run, PIECES)


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
