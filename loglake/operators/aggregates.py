"""Bounds, histograms, term counts and catalogue totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loglake.functions.text import STOP_WORDS, tokenize
from loglake.functions.times import bucket_keys, bucket_label

TERMS_DEFAULT = 20
TERMS_CAP = 200


def timeline(entries: DataFrame) -> DataFrame:
    """First and last time of a selection, NULLs when it is empty."""
    return entries.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def histogram(
    entries: DataFrame, unit: str = "day", by: str | None = None, pivot: Sequence[str] | None = None
) -> DataFrame:
    """Entries per time bucket, optionally per value of ``by``.

    Rows are grouped on integers and the few resulting buckets are labelled after
    that. ``pivot`` names the values of ``by`` that become columns.
    """
    keys = bucket_keys(F.col("ts"), unit)
    names = list(keys)
    timed = entries.where(F.col("ts").isNotNull()).select(
        *[col.alias(name) for name, col in keys.items()], *([by] if by else [])
    )
    label = bucket_label({name: F.col(name) for name in names}, unit).alias("bucket")
    if pivot is not None:
        counted = timed.groupBy(*names).pivot(by, list(pivot)).agg(F.count(F.lit(1)))
        filled = [F.coalesce(F.col(f"`{value}`"), F.lit(0)).alias(value) for value in pivot]
        return counted.select(label, *filled).orderBy("bucket")
    group = [by] if by else []
    counted = timed.groupBy(*names, *group).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(label, *group, "count").orderBy("bucket", *group)


def stack_totals(stacked: DataFrame) -> DataFrame:
    """Height of each bar of a stacked histogram."""
    return stacked.groupBy("bucket").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("segments"))


def histogram_total(hist: DataFrame) -> DataFrame:
    return hist.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def term_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """How often each term occurs, stop words left out."""
    terms = texts.select(F.explode(tokenize(F.col(column))).alias("term"))
    return terms.where(~F.col("term").isin(*STOP_WORDS)).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def lexemes(entries: DataFrame, limit: int | None = None, cap: int | None = TERMS_CAP) -> DataFrame:
    """Most frequent terms of message and raw text.

    ``limit`` terms, at most ``cap`` (``None``: as many as asked for); a negative limit means all.
    """
    limit = TERMS_DEFAULT if limit is None else int(limit)
    if cap is not None:
        limit = min(limit, cap)
    texts = entries.select(
        F.concat(F.coalesce("message", F.lit("")), F.lit(" "), F.coalesce("raw_line", F.lit(""))).alias("text")
    )
    ordered = term_counts(texts).orderBy(F.col("count").desc(), "term")
    return ordered.limit(limit) if limit >= 0 else ordered


def storage_stats(uploads: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """Stored bytes and row counts of the catalogue, in one row."""
    zero = F.lit(0).cast("bigint")
    parts = [
        uploads.agg(
            F.coalesce(F.sum(F.col("size_bytes").cast("bigint")), zero).alias("storage_size"),
            F.count(F.lit(1)).alias("upload_count"), zero.alias("file_count"), zero.alias("record_count"),
        ),
        files.agg(
            zero.alias("storage_size"), zero.alias("upload_count"),
            F.count(F.lit(1)).alias("file_count"), zero.alias("record_count"),
        ),
        entries.agg(
            zero.alias("storage_size"), zero.alias("upload_count"), zero.alias("file_count"),
            F.count(F.lit(1)).alias("record_count"),
        ),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(*[F.sum(name).alias(name) for name in stacked.columns])


def upload_detail(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Each upload with its file count, time span and, for a single file, its summary."""
    summary = [F.min_by("summary", "id").alias("summary")] if "summary" in files.columns else []
    per_upload = files.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        *summary,
    )
    joined = uploads.join(per_upload, uploads["id"] == per_upload["upload_id"], "left").drop("upload_id")
    out = joined.withColumn("file_count", F.coalesce("file_count", F.lit(0).cast("bigint")))
    if summary:
        out = out.withColumn("summary", F.when(F.col("kind") == "file", F.col("summary")))
    return out
