"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.session import ship_package

#: Words are what ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_ORDER = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _BASE)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            powers = np.full(size, base, _U)
            powers[0] = 1
            _POWERS[name] = np.cumprod(powers, dtype=_U)
    return _POWERS["up"][:n], _POWERS["down"]


def _separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_BLANKS = _separators(b" \t\n\v\f\r")
_SIGNS = _separators(bytes(c for c in range(128) if not chr(c).isalnum()))


def _run_hashes(raw: bytes, separators: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes between separators.

    A run's bytes are a polynomial; prefix sums give all runs at once.
    """
    data = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = separators[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the whole text, A-Z lower-cased."""
    return _run_hashes(text.encode("utf-8", "surrogatepass").lower(), _BLANKS) if text else np.empty(0, _U)


def token_hashes(text: str | None) -> np.ndarray:
    """A hash of each run of ASCII letters, digits and characters beyond ASCII, lower-cased."""
    return _run_hashes(text.lower().encode("utf-8", "surrogatepass"), _SIGNS) if text else np.empty(0, _U)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash of every run of ``k`` words, or one of all words if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.array([(words * _ORDER[:n]).sum() + _U(n)], _U))
    total = np.zeros(n - k + 1, _U)
    for i in range(k):
        total += words[i:n - k + 1 + i] * _ORDER[i]
    return mix(total)


#: Bytes of a batch between the JVM and a Python worker where many steps share the workers.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Send the package to the workers and keep batches of texts small; results don't depend on batches."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(BATCH_BYTES))


#: Characters of text that a task works on at a time.
SLICE = 8 << 20


def slices(batches: Iterator[pd.DataFrame], column: str = "text", size: int = SLICE) -> Iterator[pd.DataFrame]:
    """The rows of the batches in parts of about ``size`` characters, so what is made of them stays small."""
    for batch in batches:
        ends = np.cumsum([len(text or "") + 1 for text in batch[column]])
        cuts = np.unique(np.searchsorted(ends, np.arange(size, ends[-1] if len(ends) else 0, size)) + 1)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            if b > a:
                yield batch.iloc[a:b]


def held_out(doc_id: Column) -> Column:
    """True for the rows that no classifier learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete tables that ``saved`` wrote once all that was made of them is written itself.

    With ``shuffles``, the shuffle files of finished steps go, too: Spark deletes those when
    the JVM has collected their last reference.
    """
    spark = tables[0].sparkSession
    jvm = spark._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles:
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, folder: str, *columns: str, table: str = "documents") -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*(columns or ("*",)))
