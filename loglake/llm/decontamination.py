"""Operator 3, benchmark decontamination: spaced-seed hashing.

Words are runs of letters, digits and characters beyond ASCII, lower-cased. A seed is a window of 6 to 11 words of
which a fixed mask keeps six, so a hit survives substitutions at ignored places. The four
masks hit every stretch of 16 words with 3 differing ones, of 20 with 4 and of any length
with every fifth word replaced, so what the defaults below accept is found.
Benchmark and training seeds are joined by hash. Around each hit the two texts are
laid side by side and the longest stretch is found in which at most ``tolerance`` of
the words differ; it is an overlap if it has ``least`` equal words, or all words of a shorter
benchmark text.

The training side is reduced before any row is made: a bitmap of the benchmark's seed
hashes (at most 2**26 bits, 8 MB) tells which windows can hit. Runs of such windows go out
with the words they span and ``AROUND`` more on each side, so a passage of any length is seen whole,
and the text is read once and never shuffled. Everything else is joined by
hash, whatever the size of the benchmark.

Benchmark texts shorter than a mask get one seed of all their words. Texts with fewer than
``shortest`` words can't be told from chance and are left out.

Edge cases: very long texts are hashed whole, one at a time; of stretches with equally many
equal words the first one counts; null or empty texts on either side have no overlaps; repeated rows of either
table change nothing; an empty benchmark gives no overlap; further columns are ignored
and, in :func:`clean`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import mix, saved, token_hashes

# 1 keeps a word, 0 ignores it.
MASKS = ("1111011", "11000010111", "1110111", "111111")
LEAST, TOLERANCE, SHORTEST = 13, 0.2, 8
#: Words on each side of a run of hits that are looked at; hits nearer to each other are one run.
AROUND = 64
MOST_BITS = 26

_U = np.uint64


def _factors(mask: str) -> list[tuple[int, np.uint64]]:
    odd = mix(np.arange(1, 65, dtype=_U) + _U(len(mask) * 64)) | _U(1)
    return [(i, odd[i]) for i, c in enumerate(mask) if c == "1"]


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the kept words of each window."""
    count = len(tokens) - len(mask) + 1
    if count <= 0:
        return np.empty(0, _U)
    total = np.zeros(count, _U)
    for i, factor in _factors(mask):
        total += tokens[i:i + count] * factor
    return mix(total)


def masks_for(lengths: set[int], masks: tuple[str, ...] = MASKS, shortest: int = SHORTEST) -> tuple[str, ...]:
    """The masks, and one that keeps all for each length of texts shorter than every mask."""
    return (*masks, *("1" * n for n in sorted(lengths) if shortest <= n < min(map(len, masks))))


def longest_overlap(train: np.ndarray, bench: np.ndarray, shift: int, at: int, tolerance: float) -> tuple[int, int, int]:
    """(start in bench, end, equal words) of the best stretch through ``at``, bench[i] beside train[i + shift].

    Of the stretches that begin and end with equal words and in which at most
    ``tolerance`` of the words differ, the one with most equal words.
    """
    low, high = max(0, -shift), min(len(bench), len(train) - shift)
    same = bench[low:high] == train[low + shift:high + shift]
    at -= low
    # value of a stretch: equal words count tolerance, others tolerance - 1; it must not be negative
    sums = np.concatenate(([0.0], np.cumsum(np.where(same, tolerance, tolerance - 1))))
    counts = np.concatenate(([0], np.cumsum(same)))
    ends = np.flatnonzero(same)
    ends = ends[ends >= at] + 1
    best = (0, 0, 0)
    starts = np.flatnonzero(same[:at + 1])
    if not len(ends) or not len(starts):
        return best
    # the last end at which the value is not less than at the start: equal words only grow with the end
    most = np.maximum.accumulate(sums[ends][::-1])[::-1]
    last = np.searchsorted(-most, 1e-9 - sums[starts], side="right") - 1
    equal = np.where(last >= 0, counts[ends[last]] - counts[starts], 0)
    i = int(equal.argmax())
    return (low + int(starts[i]), low + int(ends[last[i]]), int(equal[i])) if equal[i] else best


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"n": [len(token_hashes(t)) for t in batch["text"].tolist()]})


def _bench_seeds(masks: tuple[str, ...], shortest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].tolist(), batch["text"].tolist(), strict=True):
                tokens = token_hashes(text)
                if len(tokens) < shortest:
                    continue
                for k, mask in enumerate(masks):
                    if k >= len(MASKS) and len(mask) != len(tokens):
                        continue
                    found = seeds(tokens, mask)
                    rows += [(s, k, item, p) for p, s in enumerate(found.view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["seed", "mask", "item_id", "at"])

    return run


def _places(x: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((x >> _U(shift)) & _U(bits - 1)).astype(np.int64) for shift in (6, 34)]


def _bitmap(values: DataFrame) -> np.ndarray:
    """A bitmap with two bits a seed, about a thousand times as many bits as seeds while that is under the bound; built in 64 slices."""
    bits = min(MOST_BITS, max(16, (1024 * max(1, values.count())).bit_length()))

    def slices(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << (bits - 6), np.uint8)
        x = group["seed"].to_numpy(np.int64).view(_U)
        for at in _places(x, len(flags)):
            flags[at] = 1
        return pd.DataFrame({"part": [int(x[0] & _U(63))], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    part = F.col("seed").bitwiseAND(F.lit(63))
    out = np.zeros((64, 1 << (bits - 9)), np.uint8)
    for r in values.distinct().groupBy(part).applyInPandas(slices, "part int, flags binary").collect():
        out[r["part"]] = np.frombuffer(r["flags"], np.uint8)
    return out


def _can_hit(flags: np.ndarray, x: np.ndarray) -> np.ndarray:
    part = (x & _U(63)).astype(np.int64)
    hit = np.ones(len(x), bool)
    for at in _places(x, flags.shape[1] * 8):
        hit &= (flags[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def _train_seeds(masks: tuple[str, ...], flags):
    """Windows that can hit, one row for each run of neighbours, with the words around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                tokens = token_hashes(text)
                hits = []
                for k, mask in enumerate(masks):
                    found = seeds(tokens, mask)
                    if len(found):
                        hits += [(p, k, int(found[p].view(np.int64))) for p in np.flatnonzero(_can_hit(flags.value, found)).tolist()]
                hits.sort()
                group: list[tuple[int, int, int]] = []
                for hit in [*hits, None]:
                    if group and (hit is None or hit[0] - group[-1][0] > AROUND):
                        low = max(0, group[0][0] - AROUND)
                        high = min(len(tokens), group[-1][0] + max(map(len, masks)) + AROUND)
                        rows.append((doc_id, low, tokens[low:high].tobytes(), [(s, k, p - low) for p, k, s in group]))
                        group = []
                    if hit:
                        group.append(hit)
            yield pd.DataFrame(rows, columns=["doc_id", "low", "words", "hits"])

    return run


def _verify(least: int, tolerance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, low, words, item, text, places in zip(*(batch[c].tolist() for c in ("doc_id", "low", "words", "item_id", "bench", "places")), strict=True):
                train, bench = np.frombuffer(words, _U), token_hashes(text)
                done: dict[int, tuple[int, int]] = {}
                for place in sorted(places, key=lambda x: (x["p"], x["at"])):
                    shift = place["p"] - place["at"]
                    if shift in done and done[shift][0] <= place["at"] < done[shift][1]:
                        continue
                    start, end, equal = longest_overlap(train, bench, shift, place["at"], tolerance)
                    done[shift] = (start, end)
                    if equal >= min(least, len(bench)):
                        rows.append((doc_id, item, low + start + shift, low + end + shift, start, equal))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "end_word", "item_word", "equal_words"])

    return run


OVERLAPS = "doc_id long, item_id long, first_word long, end_word long, item_word long, equal_words long"


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, tolerance: float = TOLERANCE, shortest: int = SHORTEST) -> DataFrame:
    """Overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text); words are counted from 0, ends are exclusive."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    lengths = items.mapInPandas(_lengths, "n long").filter(F.col("n") < min(map(len, MASKS))).distinct().collect()
    masks = masks_for({r["n"] for r in lengths}, shortest=shortest)
    own = saved(items.mapInPandas(_bench_seeds(masks, shortest), "seed long, mask int, item_id long, at int").distinct(), "decontamination-seeds")
    flags = docs.sparkSession.sparkContext.broadcast(_bitmap(own.select("seed")))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    runs = saved(
        texts.mapInPandas(_train_seeds(masks, flags), "doc_id long, low int, words binary, hits array<struct<seed:long,mask:int,p:int>>")
        .withColumn("run", F.xxhash64("doc_id", "low", "words")).dropDuplicates(["doc_id", "run"]), "decontamination-hits",
    )
    hits = runs.select("doc_id", "run", F.explode("hits").alias("hit")).select("doc_id", "run", "hit.*")
    met = hits.join(own, ["seed", "mask"]).groupBy("doc_id", "run", "item_id").agg(F.collect_set(F.struct("p", "at")).alias("places"))
    beside = met.join(runs.select("doc_id", "run", "low", "words"), ["doc_id", "run"]).join(
        items.select("item_id", F.col("text").alias("bench")).distinct(), "item_id"
    )
    return beside.mapInPandas(_verify(least, tolerance), OVERLAPS).groupBy("doc_id", "item_id", "first_word", "end_word", "item_word").agg(F.max("equal_words").alias("equal_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns as they are."""
    leaked = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
