"""Row predicates over entries, built as one Column.

Terms are ANDed cheapest first (files, time, level, then text) so that the parts the
Parquet reader can use come first and the text tests see the fewest rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, functions as F

from loglake.functions.text import attr, check_pattern, contains_like, regexp_match

SEARCH_FIELDS = {
    "all": ("ts_raw", "level", "component", "message", "raw_line"),
    "raw": ("raw_line",),
    "file": ("message", "raw_line", "component"),
}


def file_list(files: str | Iterable[str] | None) -> list[str]:
    """File ids from a list or from comma-separated text; blanks are dropped."""
    if files is None:
        return []
    items = files.split(",") if isinstance(files, str) else files
    return [item.strip() for item in items if item.strip()]


def ts_literal(moment: str | datetime) -> Column:
    """A UTC time literal from ISO text or a datetime; without an offset it is UTC already."""
    value = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_files(files: str | Iterable[str] | None) -> Column | None:
    ids = file_list(files)
    return F.col("file_id").isin(ids) if ids else None


def in_window(ts_from=None, ts_to=None) -> Column | None:
    """Both ends are inclusive; rows without a time drop out when an end is set."""
    terms = []
    if ts_from:
        terms.append(F.col("ts") >= ts_literal(ts_from))
    if ts_to:
        terms.append(F.col("ts") <= ts_literal(ts_to))
    return reduce(lambda a, b: a & b, terms) if terms else None


def has_level(level: str | None) -> Column | None:
    return F.col("level") == level if level else None


def text_match(q: str | None, fields: str = "all", mode: str = "text") -> Column | None:
    """Text or regular-expression search, true when any of the fields matches."""
    if not q:
        return None
    names = SEARCH_FIELDS.get(fields or "all", SEARCH_FIELDS["all"])
    if mode == "regex":
        check_pattern(q)
        tests = [regexp_match(F.col(name), q) for name in names]
    else:
        tests = [F.coalesce(contains_like(F.col(name), q), F.lit(False)) for name in names]
    return reduce(lambda a, b: a | b, tests)


def parse_attr_filter(text: str) -> list[tuple[str, str]]:
    """``k1:v1,k2:v2`` as pairs; a key alone asks only that the key exists."""
    pairs = []
    for item in text.split(","):
        item = item.strip()
        if not item:
            continue
        key, _, value = item.partition(":")
        key = key.strip()
        if not key:
            raise ValueError(f"bad attribute filter {item!r}, expected key:value")
        pairs.append((key, value.strip()))
    if not pairs:
        raise ValueError("empty attribute filter")
    return pairs


def attrs_match(attrs: str | None, column: str = "attrs") -> Column | None:
    """Every named attribute must exist and contain its value."""
    if not attrs:
        return None
    tests = []
    for key, value in parse_attr_filter(attrs):
        found = attr(F.col(column), key)
        tests.append(F.coalesce(contains_like(found, value), F.lit(False)) if value else found.isNotNull())
    return reduce(lambda a, b: a & b, tests)


def entry_filter(
    files: str | Iterable[str] | None = None,
    ts_from=None,
    ts_to=None,
    level: str | None = None,
    q: str | None = None,
    fields: str = "all",
    mode: str = "text",
    attrs: str | None = None,
) -> Column:
    """One predicate for a page and for its total."""
    terms = [
        in_files(files),
        in_window(ts_from, ts_to),
        has_level(level),
        attrs_match(attrs),
        text_match(q, fields, mode),
    ]
    present = [t for t in terms if t is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def combine(predicates: Sequence[Column], how: str = "and") -> Column:
    """Several saved filters as one predicate."""
    if not predicates:
        return F.lit(True)
    if how == "or":
        return reduce(lambda a, b: a | b, predicates)
    return reduce(lambda a, b: a & b, predicates)
