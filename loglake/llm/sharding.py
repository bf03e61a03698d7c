"""Operator 8, sharding: sampled splitters.

Records are ordered by (hash of the text, doc_id, size), so equal texts lie together and no
two documents share a key. A size-weighted sample of keys is drawn; its quantiles are the
splitters of ranges that hold about ``range_bytes`` each. Ranges that turn out over twice
that size are divided by further splitters drawn from their own keys, until none is.
The exact sizes of the ranges then give each range its place among all bytes, and a
record's shard is where its first byte falls when all bytes are cut into equal parts. So a
shard misses its share by less than one record.

Every range is one task's work, of bounded size: a group of equal texts that is larger is
divided by doc_id. The sample has about ``SAMPLE`` keys a splitter. Only key, size and
checksum are moved.

Edge cases: a null text has size 1 and the checksum of the empty text; rows that are
repeated entirely are told apart by a number and each gets its own slot; an empty table gives
no row; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import saved

RANGE_BYTES, SAMPLE, MOST_RANGES = 64 << 20, 40, 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of ``docs`` (doc_id, text).

    The key is 24 bytes that compare like (hash of the text, doc_id, hash of both and size).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    )
    big = lambda c: F.lpad(F.hex(c), 16, "0")
    return rows.withColumn("key", F.unhex(F.concat(big("h"), big(F.coalesce("doc_id", F.lit(0))), big(F.xxhash64("doc_id", "size"))))).drop("h")


def _sample(rows: DataFrame, mean: float) -> DataFrame:
    """Keys with a chance in proportion to their size: one for each ``mean`` bytes or so."""
    chance = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(chance * mean < F.col("size"))


def _ranged(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    """``rows`` with the number of splitters at or below their key."""
    edges = np.array([s + b"\x01" for s in splitters], "S25")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = np.array([k + b"\x01" for k in batch["key"]], "S25")
            yield batch.assign(range=np.searchsorted(edges, keys, side="right"))

    return rows.mapInPandas(run, "doc_id long, size long, text_crc32 long, key binary, range long")


def _quantiles(keys: pd.DataFrame, count: int) -> list[bytes]:
    """``count`` - 1 keys at equal steps; the sample is already weighted by size."""
    ordered = sorted(map(bytes, keys["key"]))
    return sorted({ordered[len(ordered) * i // count] for i in range(1, count)}) if ordered else []


def shards(docs: DataFrame, count: int = 8, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of ``docs`` (doc_id, text); shards are near equal in bytes."""
    rows = saved(keyed(docs), "sharding-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(2 * count, -(-total // range_bytes)))
    mean = max(1.0, total / ranges)
    splitters = _quantiles(_sample(rows, mean / SAMPLE).select("key").toPandas(), ranges)
    while True:
        dealt = _ranged(rows, splitters)
        full = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most"))
        over = full.filter((F.col("bytes") > 2 * mean + F.col("most")) & (F.col("n") > 1)).collect()
        if not over or len(splitters) >= 4 * MOST_RANGES:
            break
        inner = dealt.filter(F.col("range").isin([r["range"] for r in over]))
        found = _sample(inner, mean / (4 * SAMPLE)).select("range", "key").toPandas()
        more = {s for r in over for s in _quantiles(found[found["range"] == r["range"]], 2 * -(-int(r["bytes"]) // int(mean)))}
        if more <= set(splitters):
            break
        splitters = sorted(set(splitters) | more)
    in_order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = full.select("range", F.coalesce(F.sum("bytes").over(in_order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    placed = saved(
        dealt.join(starts, "range").withColumn("place", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("n", F.row_number().over(inside))
        .withColumn("shard", F.least(F.lit(count - 1), F.floor(F.col("place") * count / F.lit(max(1, total)))).cast("int")), "sharding-places",
    )
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("rows"), F.min("n").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select("shard", "range", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(slots, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("n") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
