"""Archive expansion as a Spark job: directories first, then every member on its own.

One pass reads each archive's directory and cuts the still compressed members out of it;
the parts are dealt out by member, so the members of one archive are inflated by
many tasks, each in bounded pieces, however long a member is.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed pattern: member names read as text logs; rotated ones have digits at the end.
TEXT_MEMBER = re.compile(r"^\.(log|out|txt|err)\d*$", re.IGNORECASE)

# Compressed bytes that travel as one row, and inflated bytes held at a time.
PART_BYTES = 4 << 20
INFLATE_BYTES = 1 << 20

# Layout of a member's own header, and the compression methods read.
_LOCAL_HEADER, _NAME_LENGTH_AT = 30, 26
STORED, DEFLATED = 0, 8

_PART = [
    ("member", pa.int64()), ("path_in_archive", pa.string()), ("method", pa.int32()), ("crc", pa.int64()), ("length", pa.int64()),
    ("archive_error", pa.string()), ("error", pa.string()), ("part", pa.int64()), ("data", pa.binary()),
]
_SQL_NAMES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(fields) -> str:
    return ", ".join(f"`{name}` {_SQL_NAMES[kind]}" for name, kind in fields)


def is_text_member(name: str) -> bool:
    ext = posixpath.splitext(posixpath.basename(name))[1]
    return ext == "" or TEXT_MEMBER.match(ext) is not None


def _member_bytes(content: memoryview, info: zipfile.ZipInfo) -> memoryview:
    """The compressed bytes of a member, which follow its own header."""
    at = info.header_offset
    sizes = [int.from_bytes(content[at + i:at + i + 2], "little") for i in (_NAME_LENGTH_AT, _NAME_LENGTH_AT + 2)]
    begin = at + _LOCAL_HEADER + sum(sizes)
    return content[begin:begin + info.compress_size]


def _parts_of(content: bytes) -> Iterator[tuple]:
    """Rows of ``_PART``: those of each text member, or one with the reason the archive can't be opened."""
    try:
        listed = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except Exception as exc:
        yield None, None, None, None, None, f"zip open: {exc}", None, 0, b""
        return
    view = memoryview(content)
    for member, info in enumerate(listed):
        if info.is_dir() or not is_text_member(info.filename):
            continue
        data = _member_bytes(view, info)
        error = None
        if info.flag_bits & 1:
            error = "the member is encrypted"
        elif info.compress_type not in (STORED, DEFLATED):
            error = f"compression method {info.compress_type} is not read"
        elif len(data) < info.compress_size:
            error = "the archive ends inside the member"
        head = (member, info.filename, info.compress_type, info.CRC, info.file_size, None, error)
        for part in range(1 if error else max(1, -(-len(data) // PART_BYTES))):
            yield (*head, part, b"" if error else bytes(data[part * PART_BYTES:(part + 1) * PART_BYTES]))


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)],
                                      [name for name, _ in fields])


def _directories(kept: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [*kept, *_PART]
    for batch in batches:
        for i in range(batch.num_rows):
            own = tuple(batch.column(name)[i].as_py() for name, _ in kept)
            rows, held = [], 0
            for row in _parts_of(batch.column("content")[i].as_py()):
                rows.append(own + row)
                held += len(row[-1])
                if held >= PART_BYTES or len(rows) >= 1000:
                    yield _batch(rows, fields)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, fields)


def archive_parts(archives: DataFrame, key: str) -> DataFrame:
    """The compressed members of archives (``key``, content) in parts, dealt out by member and in order."""
    kept = [(key, pa.string())]
    rows = archives.select(F.col(key).cast("string").alias(key), "content")
    parts = rows.mapInArrow(partial(_directories, kept), _ddl([*kept, *_PART]))
    return parts.repartition(key, "member").sortWithinPartitions(key, "member", "part")


class _Member:
    """Inflates one member part by part and checks what came out."""

    def __init__(self, own: tuple, row: dict):
        self.own, self.row = own, row
        self.inflater = zlib.decompressobj(-15) if row["method"] == DEFLATED else None
        self.crc = self.length = 0
        self.md5 = hashlib.md5()
        self.error = row["error"]

    def _seen(self, out: bytes) -> bytes:
        self.crc = zlib.crc32(out, self.crc)
        self.length += len(out)
        self.md5.update(out)
        return out

    def take(self, data: bytes, last: bool) -> Iterator[bytes]:
        while data and not self.error:
            try:
                out = self.inflater.decompress(data, INFLATE_BYTES) if self.inflater else data
            except zlib.error as exc:
                self.error = str(exc)
                return
            data = self.inflater.unconsumed_tail if self.inflater else b""
            yield self._seen(out)
        if last and not self.error and not self.row["archive_error"]:
            if self.inflater:
                yield self._seen(self.inflater.flush())
            if (self.crc, self.length) != (self.row["crc"], self.row["length"]):
                self.error = "the member's bytes are not those that were packed"


def _opened(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Member, bytes, bool]]:
    """(member, part, is it the last one), in order."""
    open_member, waiting = None, b""
    for batch in batches:
        for row in batch.to_pylist():
            own = (row[key], row["member"])
            if open_member is None or open_member.own != own:
                if open_member:
                    yield open_member, waiting, True
                open_member = _Member(own, row)
            else:
                yield open_member, waiting, False
            waiting = row["data"]
    if open_member:
        yield open_member, waiting, True


_MEMBER = [
    ("member", pa.int64()), ("path_in_archive", pa.string()), ("content", pa.binary()), ("md5", pa.string()),
    ("size_bytes", pa.int64()), ("archive_error", pa.string()), ("error", pa.string()),
]


def _inflated(key: str, row_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [(key, pa.string()), *_MEMBER]
    rows, held, pieces = [], 0, []
    for member, part, last in _opened(key, batches):
        fits = (member.row["length"] or 0) <= row_bytes
        for out in member.take(part, last):
            if fits:
                pieces.append(out)
        if last:
            row = member.row
            broken = member.error or row["archive_error"]
            content = None if broken or not fits else b"".join(pieces)
            pieces = []
            rows.append((
                row[key], row["member"], row["path_in_archive"], content, None if broken else member.md5.hexdigest(),
                None if broken else member.length, row["archive_error"], member.error,
            ))
            held += len(content or b"")
            if held >= PART_BYTES or len(rows) >= 1000:
                yield _batch(rows, fields)
                rows, held = [], 0
    if rows:
        yield _batch(rows, fields)


def expand_archives(archives: DataFrame, key: str, row_bytes: int = 64 << 20) -> DataFrame:
    """Archives (``key``, content) as members.

    (``key``, member, path_in_archive, member_name, content, md5, size_bytes, error,
    archive_error): ``member`` is the place in the archive's directory and tells members of
    the same name apart; a member over ``row_bytes`` has no content here but can be read
    with ``member_lines``; ``error`` says why a member can't be read, ``archive_error`` why
    the archive can't be opened, which is then its only row.
    """
    fields = [(key, pa.string()), *_MEMBER]
    members = archive_parts(archives, key).mapInArrow(partial(_inflated, key, row_bytes), _ddl(fields))
    return members.withColumn("member_name", F.substring_index("path_in_archive", "/", -1))


_LINE = [("member", pa.int64()), ("path_in_archive", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("value", pa.binary())]


def _lines(key: str, row_bytes: int, block_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [(key, pa.string()), *_LINE]
    rest, block, pos, held, rows = b"", 0, 0, 0, []
    for member, part, last in _opened(key, batches):
        if (member.row["length"] or 0) <= row_bytes:
            continue

        def add(values: list[bytes], member: _Member = member) -> None:
            nonlocal pos, block, held
            for value in values:
                rows.append((*member.own, member.row["path_in_archive"], block, pos, value))
                pos, held = pos + 1, held + len(value) + 1
                if held >= block_bytes:
                    block, held = block + 1, 0

        for out in member.take(part, last):
            *full, rest = (rest + out).split(b"\n")
            add(full)
            if len(rows) >= 1000:
                yield _batch(rows, fields)
                rows.clear()
        if last:
            add([rest] if rest else [])
            rest, block, pos, held = b"", 0, 0, 0
    if rows:
        yield _batch(rows, fields)


def member_lines(archives: DataFrame, key: str, row_bytes: int = 64 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """Lines (``key``, member, path_in_archive, block, pos, value) of the members over ``row_bytes``."""
    fields = [(key, pa.string()), *_LINE]
    lines = archive_parts(archives, key).mapInArrow(partial(_lines, key, row_bytes, block_bytes), _ddl(fields))
    return lines.withColumn("value", F.rtrim(F.col("value").cast("string"), F.lit("\r")))
