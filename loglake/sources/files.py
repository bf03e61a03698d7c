"""Reading log files: listings, whole contents, and lines of big files."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loglake.session import ship_package

# A file up to this size is handled as one row, a bigger one line by line.
WHOLE_FILE_BYTES = 64 << 20
# Largest content kept in one row (archives, content hash).
ROW_BYTES = 1 << 30

ZIP_MAGIC = b"PK\x03\x04"


# Names of files and folders, or what ``open_files`` made of them.
Paths = str | Sequence[str] | DataFrame

_MOUNTED = "file:"
# What Hadoop's patterns give a meaning to, and a pattern sign that was made plain.
_PATTERN_SIGNS = r"([\[\]{}*?\\])"
_PLAIN_SIGN = r"\\(.)"


def mounted(spark: SparkSession, paths: str | Sequence[str]) -> list[str] | None:
    """Names of the files and folders that ``paths`` mean, if each task opens them itself; None if only Hadoop's clients do."""
    hadoop, jvm, found = spark._jsc.hadoopConfiguration(), spark._jvm, []
    local = hadoop.get("fs.defaultFS", "file:///").startswith(_MOUNTED)
    for path in [paths] if isinstance(paths, str) else paths:
        if not (path.startswith(_MOUNTED) or (local and not re.match(r"\w[\w+.-]*:", path))):
            return None
        names = [re.sub(_PLAIN_SIGN, r"\1", path)]
        if re.search(_PATTERN_SIGNS, re.sub(_PLAIN_SIGN, "", path)):
            pattern = jvm.org.apache.hadoop.fs.Path(path)
            names = [status.getPath().toString() for status in pattern.getFileSystem(hadoop).globStatus(pattern) or ()]
        found += [os.path.abspath(re.sub(f"^{_MOUNTED}/*", "/", name)) for name in names]
    return found if found and all(map(os.path.exists, found)) else None


def _is_hidden(name: str) -> bool:
    """Names that Spark's file sources pass over, those that are no UTF-8 included."""
    plain = name.isascii() or not re.search("[\ud800-\udfff]", name)
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_") or not plain


def _below(folder: str, deep: bool) -> Iterator[tuple[str, bool]]:
    """(path, is it a folder) of what lies in a folder; with ``deep`` the files at any depth."""
    folders = [folder]
    while folders:
        try:
            with os.scandir(folders.pop()) as entries:
                for entry in entries:
                    if _is_hidden(entry.name):
                        continue
                    if entry.is_symlink() and not os.path.exists(entry.path):
                        continue
                    if not entry.is_dir():
                        yield entry.path, False
                    elif deep:
                        folders.append(entry.path)
                    else:
                        yield entry.path, True
        except FileNotFoundError:  # deleted since its name was read
            continue


_ENTRY, _SIZED = "path string, folder boolean", "path string, length bigint"
# Names that travel as one batch, and bytes of contents.
BATCH_NAMES, BATCH_BYTES = 10_000, 8 << 20


def _entries(deep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ENTRY`` with folders replaced by what lies in them."""
    rows = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["path", "folder"])

    for known in batches:
        for path, folder in zip(*(known.column(i).to_pylist() for i in range(2)), strict=True):
            for row in _below(path, deep) if folder else [(path, False)]:
                rows.append(row)
                if len(rows) >= BATCH_NAMES:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SIZED``; files deleted since their names were read are left out."""
    for batch in batches:
        paths, lengths = [], []
        for path in batch.column(0).to_pylist():
            try:
                lengths.append(os.stat(path).st_size)
            except FileNotFoundError:
                continue
            paths.append(_MOUNTED + path)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])


def _find(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, length) of the files below ``roots``, which tasks look for.

    Folders are dealt out anew on each of the first levels, and files to tell their sizes; names never
    come to the driver.
    """
    ship_package(spark)
    tasks = spark.sparkContext.defaultParallelism
    kept = [root for root in dict.fromkeys(roots) if os.path.isdir(root) or not _is_hidden(os.path.basename(root))]
    rows = spark.createDataFrame([(root, os.path.isdir(root)) for root in kept], _ENTRY).coalesce(max(1, min(len(kept), tasks)))
    for deep in (False, False, True):
        rows = rows.mapInArrow(partial(_entries, deep), _ENTRY).repartition(tasks, "path")
    rows = rows.select("path")
    if len(kept) > 1:  # one may lie in another
        rows = rows.distinct()
    return rows.mapInArrow(_sized, _SIZED)


def _spark_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, length, content) of the files below ``paths`` by Spark's source, whose index the driver holds."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(plain_path().alias("path"), "length", "content")


def open_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """Files below ``paths``, found once.

    Those of mounted folders as (path, length), empty ones too: tasks find them and open them by their
    names. Those of other stores as (path, length, content) of Spark's source, which knows no empty ones.
    """
    if isinstance(paths, DataFrame):
        return paths
    roots = mounted(spark, paths)
    return _spark_files(spark, paths) if roots is None else _find(spark, roots)


def is_mounted(found: DataFrame) -> bool:
    """Whether ``open_files`` found the files in mounted folders."""
    return "content" not in found.columns


def list_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """Files below ``paths`` as (path, filename, length), empty ones too; no content is read."""
    found = open_files(spark, paths)
    every = found.select("path", "length")
    if not is_mounted(found):
        every = every.unionByName(empty_files(spark, found).select("path", F.lit(0).cast("bigint").alias("length")))
    return every.select("path", basename(F.col("path")).alias("filename"), "length")


def empty_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """Paths of the empty files, which Spark's file sources know but make no row of.

    In other stores than mounted folders they are what a source's index holds beyond its rows. The names go
    from the index to a DataFrame inside the JVM, and only if there are any more than rows.
    """
    found = open_files(spark, paths)
    if is_mounted(found):
        return found.where("length = 0").select("path")
    names = found._jdf.inputFiles()
    missing = len(names) - found.select("path").count()
    if missing == 0:
        return spark.createDataFrame([], "path string")
    sequence = spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(names)
    index = DataFrame(spark._jsparkSession.createDataset(sequence, spark._jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    plain = F.url_decode(F.replace(F.regexp_replace("value", "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))
    empty = index.select(plain.alias("path")).distinct().join(found.select("path"), "path", "left_anti")
    if empty.count() != missing:  # never take a file for an empty one because it is spelt another way
        raise ValueError(f"{missing} files have no row, but not so by their names: are files still being written below {names[0]}?")
    return empty


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, ...) of mounted files with their contents, a few MB at a time."""
    for batch in batches:
        first, held, data = 0, 0, []
        for i, path in enumerate(batch.column("path").to_pylist(), 1):
            with open(path.removeprefix(_MOUNTED), "rb") as file:
                data.append(file.read())
            held += len(data[-1])
            if held >= BATCH_BYTES or i == batch.num_rows:
                own = batch.slice(first, i - first)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(data, pa.binary())], [*own.schema.names, "content"])
                first, held, data = i, 0, []


# Bytes of mounted files that a task reads, and what opening one counts as.
TASK_BYTES, OPEN_BYTES = 16 << 20, 8 << 10


def with_contents(files: DataFrame) -> DataFrame:
    """Rows (path, length, ...) of mounted files with ``content``; they are dealt to tasks by their bytes."""
    spark = files.sparkSession
    ship_package(spark)
    size = files.agg(F.coalesce(F.sum(F.col("length") + OPEN_BYTES), F.lit(0))).first()[0]
    dealt = files.repartition(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "path")
    return dealt.mapInArrow(_contents, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def read_blobs(
    spark: SparkSession, paths: Paths, max_bytes: int = ROW_BYTES, over: int = 0
) -> DataFrame:
    """Whole files as (path, filename, length, content, md5), of more than ``over`` bytes up to ``max_bytes``.

    The length test is pushed into Spark's source, so other files are never opened; mounted files that
    ``open_files`` found are opened by tasks.
    """
    found = paths if isinstance(paths, DataFrame) else _spark_files(spark, paths)
    blobs = found.where((F.col("length") <= max_bytes) & (F.col("length") > over))
    if is_mounted(found):
        blobs = with_contents(blobs.select("path", "length"))
    return blobs.select("path", basename(F.col("path")).alias("filename"), "length", "content",
                        F.md5("content").alias("md5"))


def plain_path() -> Column:
    """The path of a row's file as it is written, not as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def literal_path(path: Column) -> Column:
    """The path with nothing in it taken as a pattern."""
    return F.regexp_replace(path, _PATTERN_SIGNS, r"\\$1")


def literal_paths(rows: DataFrame) -> list[str]:
    """The paths of a chunk of files for a reader, with nothing in them taken as a pattern.

    Callers hand in at most a chunk of files; contents never come here.
    """
    return [re.sub(_PATTERN_SIGNS, r"\\\1", row["path"]) for row in rows.select("path").collect()]


def _raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    return text.select(
        plain_path().alias("file_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
        F.col("_metadata.file_size").alias("size"),
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines as (file_id, block, pos, value); ``file_id`` is the path.

    Only U+000A ends a line. A file is split into blocks, so it is read in parallel;
    ``block`` is the byte offset of the block and ``pos`` grows along a block.
    """
    return _raw_lines(spark, paths).select("file_id", "block", "pos", F.rtrim("value", F.lit("\r")).alias("value"))


def is_zip(filename: Column, content: Column | None = None) -> Column:
    """An archive by its name or, given the content, by its first bytes."""
    named = F.lower(filename).endswith(".zip")
    if content is None:
        return named
    return named | F.coalesce(F.substring(content, 1, 4) == F.lit(ZIP_MAGIC), F.lit(False))


# Bytes of a file that travel as one row when the file is hashed.
PIECE_BYTES = 4 << 20

_BOM = b"\xef\xbb\xbf"
_PIECE = "file_id string, block bigint, pos bigint, size bigint, lines bigint, data binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in reading order joined to pieces; a piece never goes beyond a block."""
    key, first, size, lines, held = None, 0, 0, [], 0

    def piece() -> pa.RecordBatch:
        row = [[key[0]], [key[1]], [first], [size], [len(lines)], [b"\n".join(lines)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _TYPES, strict=True)], _PIECE_NAMES)

    for batch in batches:
        for file_id, block, pos, length, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if lines and (key != (file_id, block) or held >= PIECE_BYTES):
                yield piece()
                lines, held = [], 0
            if not lines:
                key, first, size = (file_id, block), pos, length
            lines.append(data)
            held += len(data)
    if lines:
        yield piece()


_PIECE_NAMES = [field.split()[0] for field in _PIECE.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _md5_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MD5 of each file from its sorted pieces; what the line reader left out comes from ``missing``."""
    current, digest, missing = None, None, 0

    def done() -> pa.RecordBatch:
        if missing in (1, 4):
            digest.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], ["file_id", "md5"])

    for batch in batches:
        for file_id, lacking, data in zip(*(batch.column(c) for c in ("file_id", "missing", "data")), strict=True):
            if file_id.as_py() != current:
                if digest:
                    yield done()
                current, digest, missing = file_id.as_py(), hashlib.md5(), lacking.as_py()
                digest.update(_BOM if missing >= 3 else b"")
            else:
                digest.update(b"\n")
            digest.update(data.as_buffer())
    if digest:
        yield done()


def content_keys(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, md5, zip) of files of any size: the MD5 of their bytes, and whether they begin as an archive.

    Files are read in blocks whose lines travel as pieces of a few MB. MD5 goes along a
    file from front to end, so the pieces of one file meet, sorted, in one task, which
    holds one piece at a time. The line reader leaves out a byte-order mark and doesn't tell
    if the last line is ended; the file's size does.
    """
    raw = _raw_lines(spark, paths).select("file_id", "block", "pos", "size", F.col("value").cast("binary").alias("data"))
    pieces = raw.mapInArrow(_pieces, _PIECE)
    # all bytes but those that are missing are in the pieces, with one line feed between any two
    whole = pieces.groupBy("file_id").agg(
        (F.max("size") - F.sum(F.octet_length("data") + F.lit(1)) + 1).alias("missing"),
        F.min_by(F.substring("data", 1, 4), F.struct("block", "pos")).alias("magic"),
    )
    in_order = pieces.join(whole.select("file_id", "missing"), "file_id").repartition("file_id").sortWithinPartitions("file_id", "block", "pos")
    hashed = in_order.select("file_id", "missing", "data").mapInArrow(_md5_of_pieces, "file_id string, md5 string")
    return hashed.join(whole, "file_id").select(
        F.col("file_id").alias("path"), "md5", (F.col("magic") == F.lit(ZIP_MAGIC)).alias("zip"))
