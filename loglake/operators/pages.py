"""Ordered pages over entries, uploads and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.text import contains_like
from loglake.operators.predicates import entry_filter, file_list, ts_literal
from loglake.schema import ENTRY_COLUMNS

PAGE_DEFAULT = 100
PAGE_CAP = 1000

UPLOAD_SORTS = ("filename", "size_bytes", "uploaded_at", "status", "md5")


@dataclass(frozen=True)
class Page:
    """A page of rows with the number of rows its predicate matches in all."""

    items: DataFrame
    total: DataFrame
    limit: int
    offset: int


def page_bounds(limit: int | None = None, offset: int | None = None, cap: int | None = PAGE_CAP) -> tuple[int, int]:
    """Default 100 rows, at most ``cap`` (``None``: as many as asked for); a negative limit means no limit."""
    limit = PAGE_DEFAULT if limit is None else int(limit)
    if cap is not None:
        limit = min(limit, cap)
    return limit, max(int(offset or 0), 0)


def cut(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit >= 0 else ordered


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def scope(entries: DataFrame, files: DataFrame | None, upload_id: str | None, selected=None) -> DataFrame:
    """Entries of the selected files, or of all files of an upload.

    A file selection stands alone, as the upload is implied by it. The upload's own
    files are found by a semi-join; Catalyst broadcasts the id list when it is small.
    """
    if file_list(selected) or upload_id is None:
        return entries
    entries = entries.where(F.col("upload_id") == upload_id)
    if files is None:
        return entries
    ids = files.where(F.col("upload_id") == upload_id).select(F.col("id").alias("file_id"))
    return entries.join(ids, "file_id", "left_semi")


def search(
    entries: DataFrame,
    files: DataFrame | None = None,
    upload_id: str | None = None,
    /,
    *,
    limit: int | None = None,
    offset: int | None = None,
    cap: int | None = PAGE_CAP,
    **filters,
) -> DataFrame:
    """Matching entries of an upload ordered by file and record; ``cap`` as in ``correlate``."""
    limit, offset = page_bounds(limit, offset, cap)
    hits = scope(entries, files, upload_id, filters.get("files")).where(entry_filter(**filters))
    return cut(hits.select(*ENTRY_COLUMNS).orderBy("file_id", "seq"), limit, offset)


def _correlated(entries: DataFrame, files: DataFrame, upload_id: str | None, filters: dict) -> tuple[DataFrame, DataFrame]:
    """Matching entries, and the names of the files they may belong to."""
    if upload_id is not None:
        files = files.where(F.col("upload_id") == upload_id)
        entries = entries.where(F.col("upload_id") == upload_id)
    return entries.where(entry_filter(**filters)), files.select(F.col("id").alias("file_id"), "filename")


def correlate_rows(entries: DataFrame, files: DataFrame, upload_id: str | None = None, /, **filters) -> DataFrame:
    """Matching entries of one upload (or of all) with their file name, unordered."""
    hits, names = _correlated(entries, files, upload_id, filters)
    return hits.join(names, "file_id").select(*ENTRY_COLUMNS, "filename")


def after_key(ts, seq: int, file_id: str) -> Column:
    """Rows that come after a given one in correlation order (NULL times last)."""
    later = (F.col("seq") > seq) | ((F.col("seq") == seq) & (F.col("file_id") > file_id))
    if ts is None:
        return F.col("ts").isNull() & later
    moment = ts_literal(ts)
    return F.col("ts").isNull() | (F.col("ts") > moment) | ((F.col("ts") == moment) & later)


def correlate(
    entries: DataFrame,
    files: DataFrame,
    upload_id: str | None = None,
    /,
    *,
    limit: int | None = None,
    offset: int | None = None,
    after: tuple | None = None,
    cap: int | None = PAGE_CAP,
    **filters,
) -> Page:
    """One time-ordered stream over the selected files.

    ``after=(ts, seq, file_id)`` continues behind a known row without skipping over
    all rows before it: use it instead of ``offset`` for deep pages.

    The entries are scanned once: a semi-join with the file ids keeps what belongs to
    known files, each task sends on at most the rows of the page, and names are joined to
    the page alone. ``cap`` bounds the page; ``None`` gives as many rows as asked for.
    """
    limit, offset = page_bounds(limit, offset, cap)
    hits, names = _correlated(entries, files, upload_id, filters)
    known = hits.join(names.select("file_id"), "file_id", "left_semi").select(*ENTRY_COLUMNS)
    order = [F.col("ts").asc_nulls_last(), "seq", "file_id"]
    page = cut((known.where(after_key(*after)) if after else known).orderBy(*order), limit, offset)
    items = page.join(names, "file_id").select(*ENTRY_COLUMNS, "filename").orderBy(*order)
    return Page(items, count_rows(known), limit, offset)


def file_entries(
    entries: DataFrame,
    file_id: str,
    *,
    limit: int | None = None,
    offset: int | None = None,
    level: str | None = None,
    ts_from=None,
    ts_to=None,
    q: str | None = None,
    cap: int | None = PAGE_CAP,
) -> Page:
    """Entries of one file in record order; text is looked for in three fields."""
    limit, offset = page_bounds(limit, offset, cap)
    hits = entries.where(
        entry_filter(files=[file_id], level=level, ts_from=ts_from, ts_to=ts_to, q=q, fields="file")
    ).select(*ENTRY_COLUMNS)
    return Page(cut(hits.orderBy("seq"), limit, offset), count_rows(hits), limit, offset)


def uploads_list(
    uploads: DataFrame, sort: str = "uploaded_at", direction: str = "asc", filter_text: str | None = None
) -> DataFrame:
    """Uploads by an allowed column; the id makes the order total."""
    if filter_text:
        uploads = uploads.where(contains_like(F.col("filename"), filter_text))
    key = F.col(sort if sort in UPLOAD_SORTS else "uploaded_at")
    ordered = key.desc() if direction.lower() == "desc" else key.asc()
    return uploads.orderBy(ordered, "id")


def files_list(files: DataFrame, upload_id: str | None = None) -> DataFrame:
    if upload_id:
        files = files.where(F.col("upload_id") == upload_id)
    return files.orderBy("filename", "id")
