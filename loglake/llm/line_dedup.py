"""Operator 11, line dedup: lines that many documents share stay in one document only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of
``chars`` code points or more that ``least`` documents or more hold lose all their lines,
except those of the largest doc_id holding it.

Each line becomes a row of 128 bits of hash and its place; the text is not moved. Rows are
range-partitioned by (hash, document), so a key that a third of all documents hold is cut
into many ranges, and sorted within by hash, document from the largest and position. A
task streams over its runs of equal hashes: the first document of a run keeps its lines,
the others lose theirs once ``least`` documents were met. Only a range's first run, which
may have begun in the range before, and a last one still short of ``least`` documents stay
undecided; a table of at most two hashes a range settles them. What comes out is a
compressed bitmap of kept lines for each document that loses any.

Edge cases: a null or empty text is one empty line; a very long text is cut into lines by
one task, and its lines are rows like others; rows that share a doc_id count as one
document and keep or lose lines alike; rows without doc_id are told apart by their texts and rank below all
doc_ids; rows repeated entirely get one bitmap and equal results; of a document all lines
of a kept key stay, repeated ones too; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import saved

CHARS, LEAST = 40, 5
_BLANKS = b" \t\n\v\f\r"

#: A document: whether it has an id, the id (else the hash of its text) and the hash of its text.
_KEY = ["known", "doc", "text_key"]
_KEY_TYPE = "known boolean, doc long, text_key long"
LINES = f"h1 long, h2 long, {_KEY_TYPE}, pos int, n_lines int"
RUNS = f"{LINES}, docs int, decided boolean"
_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text")).select(
        "*", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.xxhash64("text")).alias("doc"),
        F.xxhash64("text").alias("text_key"),
    )


def line_keys(text: str, chars: int = CHARS) -> tuple[list[int], list[bytes], int]:
    """Positions and keys of the lines with long keys, and the number of all lines."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= chars:
            key = line.strip(_BLANKS).lower()
            # a code point has one to four bytes
            if len(key) >= 4 * chars or len(key) >= chars and len(key.decode("utf-8", "surrogatepass")) >= chars:
                at.append(i)
                keys.append(key)
    return at, keys, len(lines)


def _hashed(chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        hashes, at, owner, totals = [], [], [], []
        for row, text in enumerate(batch.column("text")):
            places, keys, total = line_keys(text.as_py(), chars)
            hashes += map(xxhash.xxh3_128_digest, keys)
            at += places
            owner += [row] * len(places)
            totals += [total] * len(places)
        h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        of = pa.array(owner, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), *(batch.column(c).take(of) for c in _KEY), pa.array(at, pa.int32()), pa.array(totals, pa.int32())],
            _NAMES[:7],
        )


class _Runs:
    """Goes along the sorted rows of a range and says which lines go.

    ``state`` is the run the last rows belong to, if it was given out already: the first
    one of the range, which stays undecided, or one with documents enough. A shorter run is held.
    """

    def __init__(self, least: int):
        self.least, self.held, self.state = least, None, None

    def take(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        state = self.state
        if self.held is not None:
            rows, self.held, state = pd.concat([self.held, rows], ignore_index=True), None, None
        if not len(rows):
            return []
        h, doc = rows[["h1", "h2"]].to_numpy(), rows["doc"].to_numpy()
        known = rows["known"].to_numpy().astype(bool)
        new_run = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
        new_doc = new_run | np.r_[True, (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])]
        if state and state["h"] == tuple(h[0]):
            new_run[0] = False
            new_doc[0] = state["last"] != (known[0], doc[0])
        run = np.cumsum(new_run) - new_run[0]
        starts = np.r_[0, np.flatnonzero(new_run[1:]) + 1]
        docs = np.bincount(run, new_doc).astype(int)
        top_known, top = known[starts], doc[starts]
        undecided = np.zeros(len(starts), bool)
        enough = docs >= self.least
        if state and not new_run[0]:  # goes on from the rows before
            undecided[0], enough[0] = state["first"], not state["first"]
            top_known[0], top[0] = state["top"]
        elif state is None and not self.begun:
            undecided[0], enough[0] = True, False
        self.begun = True
        out = []
        loses = enough[run] & ((doc != top[run]) | (known != top_known[run]))
        out.append(rows[loses].assign(docs=0, decided=True))
        open_rows = undecided[run]
        out.append(rows[open_rows].assign(docs=new_doc[open_rows].astype(int), decided=False))
        last = len(starts) - 1
        if undecided[last] or enough[last]:
            earlier = state["docs"] if last == 0 and state and not new_run[0] else 0
            self.state = {"h": tuple(h[-1]), "first": bool(undecided[last]), "top": (top_known[last], top[last]),
                          "docs": earlier + int(docs[last]), "last": (known[-1], doc[-1]), "row": rows.iloc[[-1]]}
        else:
            self.held, self.state = rows[run == last].copy(), None
        return out

    begun = False

    def close(self) -> list[pd.DataFrame]:
        """What the border table must know of the last run."""
        if self.held is not None:
            new = (self.held[["known", "doc"]] != self.held[["known", "doc"]].shift()).any(axis=1)
            return [self.held.assign(docs=new.astype(int), decided=False)]
        if self.state and not self.state["first"]:
            known, doc = self.state["top"]
            return [self.state["row"].assign(known=known, doc=doc, pos=pd.NA, docs=self.state["docs"], decided=False)]
        return []


def _stream(least: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs = _Runs(least)
    for batch in batches:
        yield from (x[_NAMES] for x in runs.take(batch) if len(x))
    yield from (x[_NAMES].astype({"pos": "Int32"}) for x in runs.close())


def dropped_lines(docs: DataFrame, chars: int = CHARS, least: int = LEAST) -> DataFrame:
    """The lines that go: (known, doc, text_key, n_lines, pos)."""
    lines = saved(_keyed(docs).select("text", *_KEY).mapInArrow(partial(_hashed, chars), LINES), "line-hashes")
    order = [F.col("h1"), F.col("h2"), F.col("known").desc(), F.col("doc").desc()]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "pos")
    runs = saved(dealt.mapInPandas(partial(_stream, least), RUNS), "line-runs")
    # at most two hashes of each range: small enough for every task
    border = runs.filter("not decided").groupBy("h1", "h2").agg(
        F.sum("docs").alias("holders"), F.max(F.struct("known", "doc")).alias("top")
    ).filter(F.col("holders") >= least)
    settled = runs.filter("not decided and pos is not null").join(F.broadcast(border), ["h1", "h2"]).filter(
        F.struct("known", "doc") < F.col("top")
    )
    columns = [*_KEY, "n_lines", "pos"]
    return runs.filter("decided").select(*columns).unionByName(settled.select(*columns))


def _bitmap(n_lines: int, gone: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes())


def keep_bitmaps(docs: DataFrame, chars: int = CHARS, least: int = LEAST) -> DataFrame:
    """For each document that loses lines: (known, doc, text_key, n_lines, n_dropped, keep).

    ``keep`` holds a bit for each line, 1 where it stays, packed and compressed by zlib.
    """
    @F.pandas_udf("binary")
    def pack(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([_bitmap(n, np.asarray(g)) for n, g in zip(n_lines, gone, strict=True)])

    lost = dropped_lines(docs, chars, least).groupBy(*_KEY, "n_lines").agg(F.collect_set("pos").alias("gone"))
    return lost.select(*_KEY, "n_lines", F.size("gone").cast("long").alias("n_dropped"), pack("n_lines", "gone").alias("keep"))


def kept_lines(text: str, keep: bytes | None) -> list[str]:
    """The lines that a bitmap leaves of a text."""
    lines = text.split("\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return [line for line, bit in zip(lines, bits.tolist(), strict=True) if bit]


def with_bitmaps(docs: DataFrame, chars: int = CHARS, least: int = LEAST) -> DataFrame:
    """The documents (doc_id, text) with the bitmap and n_dropped; both null where nothing goes."""
    bitmaps = saved(keep_bitmaps(docs, chars, least).drop("n_lines"), "line-bitmaps")
    return _keyed(docs).join(bitmaps, _KEY, "left").select("doc_id", "text", "n_dropped", "keep")


def dedup_lines(docs: DataFrame, chars: int = CHARS, least: int = LEAST) -> DataFrame:
    """The documents (doc_id, text) without the lines that go."""
    @F.pandas_udf("string")
    def shorten(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(kept_lines(t, k)) for t, k in zip(text, keep, strict=True)])

    marked = with_bitmaps(docs, chars, least)
    return marked.select("doc_id", F.when(F.col("keep").isNull(), F.col("text")).otherwise(shorten("text", "keep")).alias("text"))


def line_report(docs: DataFrame, chars: int = CHARS, least: int = LEAST) -> DataFrame:
    """For each document: doc_id, n_lines before, n_dropped and the SHA-256 of what stays."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, digests = [], [], []
            for text, n, keep in zip(*(batch.column(c) for c in ("text", "n_dropped", "keep")), strict=True):
                whole = text.as_py()
                counts.append(whole.count("\n") + 1)
                gone.append(n.as_py() or 0)
                left = whole if keep.as_py() is None else "\n".join(kept_lines(whole, keep.as_py()))
                digests.append(hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return with_bitmaps(docs, chars, least).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
