"""Deciding what happens to incoming files: limits, duplicates, report, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TOO_LARGE = "file exceeds the size limit"
DUPLICATE = "file was uploaded before"

# Copies of one content may be a large part of a batch: their join key is spread this far.
SALT = 16


def _salted(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))


def duplicate_report(batch: DataFrame, existing: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Incoming files (id, filename, md5, size_bytes) with what becomes of them.

    Adds ``status`` (accepted, duplicate, failed), ``existing_upload_id`` and ``error``.
    Of equal contents the first by file name is accepted, unless ``existing`` (id, md5)
    has the content already, whatever became of it then. A file over the limit fails and
    is no duplicate of anything.

    The first of each content comes from a map-side aggregate, not a window, and only
    contents met more than once are joined back, on a salted key.
    """
    over = F.col("size_bytes") > max_bytes if max_bytes is not None else F.lit(False)
    batch = batch.withColumn("over", F.coalesce(over, F.lit(False)))
    firsts = batch.where(~F.col("over")).groupBy("md5").agg(
        F.min(F.struct("filename", "id")).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    known = existing.groupBy("md5").agg(F.min("id").alias("known_id"))
    notable = firsts.join(known, "md5", "left").where((F.col("copies") > 1) | F.col("known_id").isNotNull())
    spread = notable.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = _salted(batch, "id").join(spread, ["md5", "salt"], "left")
    is_first = F.col("first").isNull() | (F.col("first.id") == F.col("id"))
    accepted = F.col("known_id").isNull() & is_first
    status = F.when(F.col("over"), "failed").when(accepted, "accepted").otherwise("duplicate")
    columns = [c for c in batch.columns if c != "over"]
    return joined.select(
        *columns,
        status.alias("status"),
        F.when(~F.col("over") & ~accepted, F.coalesce("known_id", F.col("first.id"))).alias("existing_upload_id"),
        F.when(F.col("over"), TOO_LARGE).when(~accepted, DUPLICATE).alias("error"),
    )


def upload_report(uploads: DataFrame, files: DataFrame, nest: bool = True) -> DataFrame:
    """One row per upload with its files nested, ordered by path and name.

    With ``nest=False`` one row per file (an upload without files has one, too), which
    suits uploads of any number of files.
    """
    shown = [c for c in ("path_in_archive", "filename", "id", "format", "status", "record_count", "summary", "error")
             if c in files.columns]
    if not nest:
        own = files.select("upload_id", F.struct(*shown).alias("file"))
        return uploads.join(own, uploads["id"] == own["upload_id"], "left").drop("upload_id")
    nested = files.groupBy("upload_id").agg(F.collect_list(F.struct(*shown)).alias("files"))
    ordered = nested.withColumn("files", F.array_sort("files", lambda a, b: F.when(
        _name_key(a) < _name_key(b), -1).when(_name_key(a) > _name_key(b), 1).otherwise(0)))
    return uploads.join(ordered, uploads["id"] == ordered["upload_id"], "left").drop("upload_id")


def _name_key(item):
    return F.concat_ws("\n", F.coalesce(item["path_in_archive"], F.lit("")), item["filename"])


# Saved view state that goes with an upload.
VIEW_TABLES = ("filters", "highlights", "presets", "annotations")

# Tables that go with an upload and the column that names it.
UPLOAD_TABLES = {
    "uploads": "id", "files": "upload_id", "entries": "upload_id", "filters": "upload_id",
    "highlights": "upload_id", "presets": "upload_id", "annotations": "upload_id",
}


def delete_uploads(tables: dict[str, DataFrame], upload_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the given uploads (column ``id``)."""
    out = dict(tables)
    for name, column in UPLOAD_TABLES.items():
        if name in out:
            ids = upload_ids.select(F.col("id").alias(column)).distinct()
            out[name] = out[name].join(ids, column, "left_anti")
    return out


def delete_files(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """Files and their entries without the given files; annotations stay and may dangle."""
    out = dict(tables)
    for name, column in {"files": "id", "entries": "file_id"}.items():
        if name in out:
            ids = file_ids.select(F.col("id").alias(column)).distinct()
            out[name] = out[name].join(ids, column, "left_anti")
    return out


def missing_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids a deletion names that are not there."""
    return ids.select("id").distinct().join(table.select("id"), "id", "left_anti")
