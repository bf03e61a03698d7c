"""Operator 12, hard-negative mining: rows that are near an anchor and have another label.

Components become integers; a score is the integer inner product with the anchor. Anchors
are the rows whose id is divisible by ``anchor_every``. The scores of a tile of anchors
and a tile of candidates are one matrix product by Strassen's recursion: seven half-size
products instead of eight, odd sides filled up with zeros, all sums in 64-bit integers,
exact as long as the scores are 64-bit integers. Two passes over the candidates:

1. the ``positives`` best other rows with the anchor's label,
2. for the window below each positive's score, the ``negatives`` best rows of other labels.

A task keeps the best few of each anchor, or of each window, and hands on one row for each;
a ranked merge ends a pass. Anchors are sent to the tasks in waves of at most about
``wave`` bytes, as many as there are; candidates are read again for each wave and never shuffled.

Edge cases: rows without id, label or vector, or with a component that is null, not finite
or beyond 2**53 / 256, take no part; of rows that share an id the one with the smallest
(label, vector) does; vectors of unequal length are filled up with zeros; equal scores rank
by id; an anchor without positives, or a window without rows, gives no row; an empty table
gives none; a label of a third of all rows is no group anywhere; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.best import TYPE, Best, merged
from loglake.llm.common import saved

ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
SCALE = 256
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
ANCHOR_TILE, CANDIDATE_TILE, LEAF = 512, 2048, 16
WAVE = 32 << 20
_EXACT = 1 << 53


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of small int64 matrices: in doubles where all sums are sure to be exact."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of int64 matrices by seven products of halves, until a side is ``leaf`` or less."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return product(a, b)
    a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    r, k, c = (x // 2 for x in (*a.shape, b.shape[1]))
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = m1 + m4 - m5 + m7
    out[:r, c:] = m3 + m5
    out[r:, :c] = m2 + m4
    out[r:, c:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows that take part, as (vec_id, label, vector of bigint), one for each id."""
    inside = lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= _EXACT, F.lit(False))
    part = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", inside)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"),
    )
    twice = part.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    first = part.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x"))
    single = part.join(twice, "vec_id", "left_anti")
    return single.unionByName(first.select("vec_id", "x.label", "x.vector"))


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` int64, shorter ones filled with zeros, longer ones cut.

    Cutting is right where the other side has no more components: they would meet zeros.
    """
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = place < width
    out[row[fits], place[fits]] = values[fits]
    return out


class Wave:
    """Anchors that travel together, and the scores of candidates against them."""

    def __init__(self, anchors: pd.DataFrame):
        anchors = anchors.sort_values("vec_id")
        self.ids, self.labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        self.width = max(map(len, anchors["vector"]), default=0)
        self.vectors = matrix(pa.array(anchors["vector"].tolist(), pa.list_(pa.int64())), self.width)

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, scores of anchors x candidates, candidates' ids, candidates' labels)."""
        for at in range(0, batch.num_rows, CANDIDATE_TILE):
            part = batch.slice(at, CANDIDATE_TILE)
            candidates = np.ascontiguousarray(matrix(part.column("vector"), self.width).T)
            ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
            for a in range(0, len(self.ids), ANCHOR_TILE):
                span = slice(a, min(a + ANCHOR_TILE, len(self.ids)))
                yield span, strassen(self.vectors[span], candidates), ids, labels


def _positives(wave: Wave, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = Best(len(wave.ids), k)
    for batch in batches:
        for span, scores, ids, labels in wave.tiles(batch):
            fits = (wave.labels[span, None] == labels) & (scores >= best.floor[span, None]) & (wave.ids[span, None] != ids)
            row, col = np.nonzero(fits)
            best.add(row + span.start, scores[row, col], ids[col])
    yield best.rows()


def _negatives(wave: Wave, windows: pd.DataFrame, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``windows``: anchor (its place in the wave), low, high; a window's number is its row."""
    best = Best(len(windows), k)
    anchor, low, high = (windows[c].to_numpy(np.int64) for c in ("anchor", "low", "high"))
    of_tile = [np.flatnonzero((anchor >= a) & (anchor < a + ANCHOR_TILE)) for a in range(0, len(wave.ids), ANCHOR_TILE)]
    for batch in batches:
        for span, scores, ids, labels in wave.tiles(batch):
            own = of_tile[span.start // ANCHOR_TILE]
            at = anchor[own] - span.start
            for some in range(0, len(own), ANCHOR_TILE):
                w, a = own[some:some + ANCHOR_TILE], at[some:some + ANCHOR_TILE]
                seen = scores[a]
                fits = (seen >= np.maximum(low[w], best.floor[w])[:, None]) & (seen <= high[w, None])
                fits &= wave.labels[anchor[w], None] != labels
                row, col = np.nonzero(fits)
                best.add(w[row], seen[row, col], ids[col])
    yield best.rows()


def _mined(candidates: DataFrame, wave: Wave, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(wave)
    found = merged(candidates.mapInArrow(lambda batches: _positives(shared.value, positives, batches), TYPE), positives)
    # at most ``positives`` rows for each anchor of the wave
    pairs = found.toPandas().sort_values(["group_no", "nth"]).reset_index(drop=True)
    if not len(pairs):
        return None
    bounds = [(-(-low * s // 100), high * s // 100) for s in pairs["score"].tolist()]
    windows = pd.DataFrame({"anchor": pairs["group_no"], "low": [b[0] for b in bounds], "high": [b[1] for b in bounds]})
    given = spark.sparkContext.broadcast(windows)
    near = merged(candidates.mapInArrow(lambda batches: _negatives(shared.value, given.value, negatives, batches), TYPE), negatives)
    named = pd.DataFrame({
        "group_no": np.arange(len(pairs), dtype=np.int32), "anchor_id": wave.ids[pairs["group_no"]],
        "positive_id": pairs["id"].astype(np.int64), "positive_score": pairs["score"].astype(np.int64),
    })
    return near.join(F.broadcast(spark.createDataFrame(named)), "group_no").select(
        "anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def mine(
    vectors: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, wave: int = WAVE,
) -> DataFrame:
    """Hard negatives of (vec_id, label, vector): anchor_id, positive_id, rank, negative_id and both scores."""
    rows = saved(vectors, "vectors")
    anchors = rows.filter(F.col("vec_id") % anchor_every == 0)
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    waves = max(1, -(-8 * size.n * (size.width or 0) // wave))
    parts = []
    for i in range(waves):
        some = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == i).toPandas()
        part = _mined(rows, Wave(some), positives, negatives, low, high) if len(some) else None
        if part is not None:
            parts.append(saved(part, "hard-negatives") if waves > 1 else part)
    if not parts:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh id gets the next label of ten: rows whose label is wrong on purpose."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
