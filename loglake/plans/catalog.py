"""The catalogue: uploads, files and entries as Parquet tables, and batch ingestion.

Each batch writes its own partition of every table and the uploads last, so a batch
that was cut short is invisible and can simply be run again under the same id.
Deletion appends the deleted ids; readers leave them out by an anti-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loglake.operators.assembly import (
    assemble_lines,
    clean_text,
    detect_lines,
    detect_text,
    encoding_of_lines,
    parse_records,
    split_records,
)
from loglake.operators.intake import TOO_LARGE, VIEW_TABLES, duplicate_report, missing_ids, upload_report
from loglake.operators.summaries import marker_table, sessions, summarize
from loglake.operators.views import validate_annotations, validate_rules
from loglake.schema import ANNOTATIONS, ENTRIES, ENTRY_COLUMNS, FILES, FILTERS, HIGHLIGHTS, MARKERS, PRESETS, SESSIONS, UPLOADS
from loglake.session import many_small_files, ship_package
from loglake.sources.archives import expand_archives, member_lines
from loglake.sources.encodings import UTF8, decode_text, detect_encoding
from loglake.sources.files import (
    ROW_BYTES,
    WHOLE_FILE_BYTES,
    Paths,
    content_keys,
    is_mounted,
    is_zip,
    list_files,
    literal_path,
    literal_paths,
    open_files,
    read_blobs,
    read_lines,
    with_contents,
)

MAX_FILE_BYTES = 10 << 30
# Files whose names are handed to a reader at a time.
CHUNK_FILES = 50_000

_DELETED = "kind string, id string"
_SUMMARIES = T.StructType([ENTRIES["file_id"], FILES["summary"]])


class Catalog:
    """Tables below one folder of a file system all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str, batch_id: str | None = None) -> str:
        return f"{self.folder}/{table}" + (f"/batch_id={batch_id}" if batch_id else "")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _read(self, table: str, schema) -> DataFrame:
        if not self._exists(self.path(table)):
            return self.spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("string"))
        full = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType())])
        return self.spark.read.schema(full).option("basePath", self.path(table)).parquet(self.path(table))

    def _write(self, df: DataFrame, table: str, batch_id: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(self.path(table, batch_id))

    # ---- reading -------------------------------------------------------------

    def _without_deleted(self, rows: DataFrame, **kinds: str) -> DataFrame:
        """Rows whose ids (column by kind) were not deleted."""
        path = self.path("deleted")
        if not self._exists(path):
            return rows
        deleted = self.spark.read.schema(_DELETED).parquet(path)
        for kind, column in kinds.items():
            ids = deleted.where(F.col("kind") == kind).select(F.col("id").alias(column)).distinct()
            rows = rows.join(ids, column, "left_anti")
        return rows

    def uploads(self) -> DataFrame:
        rows = self._read("uploads", UPLOADS)
        return self._without_deleted(rows, upload="id").select(*UPLOADS.names, "batch_id")

    def _newest_runs(self) -> DataFrame:
        """(file_id, run, newer): the last summary of each file that was summarised again."""
        again = self._read("summaries", _SUMMARIES)
        return again.groupBy("file_id").agg(F.max("batch_id").alias("run"), F.max_by("summary", "batch_id").alias("newer"))

    def files(self) -> DataFrame:
        """Files of finished batches; a file that was summarised again shows its last version."""
        rows = self._read("files", FILES).join(self.uploads().select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
        rows = self._without_deleted(rows, file="id")
        again = self._newest_runs()
        joined = rows.join(again, rows["id"] == again["file_id"], "left")
        return joined.withColumn("summary", F.coalesce("newer", "summary")).withColumn(
            "duration_sec", F.col("summary.duration_sec")
        ).select(*FILES.names, "batch_id")

    def entries(self, upload_id: str | None = None) -> DataFrame:
        """Entries of finished batches, of one upload or of all.

        For one upload its batch is found in the small uploads table, which prunes the
        partitions of the big one; within them the files are sorted by upload and file, so
        row groups are skipped by their statistics.
        """
        rows, done = self._read("entries", ENTRIES), self._read("uploads", UPLOADS)
        if upload_id is not None:
            rows, done = rows.where(F.col("upload_id") == upload_id), done.where(F.col("id") == upload_id)
        # broadcast: shuffled by their batch, all entries of a batch would go to one task
        rows = rows.join(F.broadcast(done.select("batch_id").distinct()), "batch_id", "left_semi")
        return self._without_deleted(rows, upload="upload_id", file="file_id").select(*ENTRY_COLUMNS)

    def sessions(self, file_id: str | None = None) -> DataFrame:
        """Start/stop sessions of the stored files, from the run that made their summary."""
        first, again = self._read("sessions", SESSIONS), self._read("sessions_again", SESSIONS)
        if file_id is not None:
            first, again = (rows.where(F.col("file_id") == file_id) for rows in (first, again))
        runs = self._newest_runs().select("file_id", F.col("run").alias("batch_id"))
        rows = first.join(runs.select("file_id"), "file_id", "left_anti").select(*SESSIONS.names).unionByName(
            again.join(runs, ["file_id", "batch_id"], "left_semi").select(*SESSIONS.names))
        kept = self.files().select(F.col("id").alias("file_id"))
        return rows.join(kept, "file_id", "left_semi")

    def markers(self) -> DataFrame | None:
        """The session markers the catalogue was given last (format, kind, text); None if it never was."""
        if not self._exists(self.path("markers")):
            return None
        rows = self._read("markers", MARKERS)
        last = rows.agg(F.max("batch_id").alias("batch_id"))
        return rows.join(F.broadcast(last), "batch_id", "left_semi").select(*MARKERS.names)

    # ---- saved view state ----------------------------------------------------

    def view(self, table: str) -> DataFrame:
        """Stored filters, highlights, presets or annotations of the uploads that are there."""
        rows = self._read(table, _VIEWS[table])
        rows = rows.join(self.uploads().select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
        return self._without_deleted(rows, **{table: "id"}).select(*_VIEWS[table].names)

    def save_view(self, table: str, rows: DataFrame, run_id: str) -> DataFrame:
        """Store rows of a view table and return those that were refused, with the reason.

        Rows of an unknown upload are refused, as are rows without what their kind needs.
        Saving a run again replaces it.
        """
        schema = _VIEWS[table]
        rows = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
        ])
        checked = validate_annotations(rows) if table == "annotations" else validate_rules(rows, table)
        known = self.uploads().select(F.col("id").alias("upload_id"), F.lit(True).alias("known"))
        checked = checked.join(known, "upload_id", "left").withColumn(
            "error", F.coalesce("error", F.when(F.col("id").isNull(), "id is required"), F.when(F.col("known").isNull(), "no such upload")))
        self._write(checked.select(*schema.names, "error"), f"{table}_checked", run_id)
        stored = self.spark.read.parquet(self.path(f"{table}_checked", run_id))
        self._write(stored.where("error IS NULL").select(*schema.names), table, run_id)
        return stored.where("error IS NOT NULL")

    # ---- changing ------------------------------------------------------------

    def _bury(self, ids: DataFrame) -> None:
        """Append deleted ids (batch_id, kind, id); those of a batch go when it is run again."""
        ids.write.mode("append").partitionBy("batch_id").parquet(self.path("deleted"))

    def _delete(self, kind: str, table: DataFrame, ids: Sequence[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone = [r["id"] for r in missing_ids(table, wanted).collect()]
        if gone:
            raise KeyError(f"no such {kind}: {', '.join(sorted(gone))}")
        return table.join(F.broadcast(wanted), "id", "left_semi").select("batch_id", F.lit(kind).alias("kind"), "id")

    def delete_uploads(self, ids: Sequence[str]) -> None:
        """Uploads with their files, entries and view rows; a later rerun of the batch brings no view row back."""
        rows = self._delete("upload", self.uploads(), ids)
        for table in VIEW_TABLES:
            own = self.view(table).where(F.col("upload_id").isin(list(ids)))
            rows = rows.unionByName(own.select(F.lit(_VIEW_BATCH).alias("batch_id"), F.lit(table).alias("kind"), "id"))
        self._bury(rows)

    def delete_files(self, ids: Sequence[str]) -> None:
        """Files with their entries; annotations stay and dangle."""
        self._bury(self._delete("file", self.files(), ids))

    def delete_view(self, table: str, ids: Sequence[str]) -> None:
        self._bury(self._delete(table, self.view(table).withColumn("batch_id", F.lit(_VIEW_BATCH)), ids))

    def clear_view_state(self, upload_id: str) -> None:
        """Drop the filters and highlights of an upload; presets and annotations stay."""
        for table in ("filters", "highlights"):
            own = self.view(table).where(F.col("upload_id") == upload_id)
            self._bury(own.select(F.lit(_VIEW_BATCH).alias("batch_id"), F.lit(table).alias("kind"), "id"))

    def resummarize(
        self, run_id: str, file_ids: Sequence[str] | None = None, markers: DataFrame | dict | None = None
    ) -> DataFrame:
        """Summarise stored entries again without parsing; ``run_id`` must sort after earlier runs.

        ``markers`` become the catalogue's session markers; without them its last ones hold.
        The run's summaries are written last and make its sessions valid with them.
        """
        if markers is not None:
            self._write(marker_table(self.spark, markers), "markers", run_id)
        markers = self.markers()
        files, entries = self.files(), self.entries()
        if file_ids is not None:
            files = files.where(F.col("id").isin(list(file_ids)))
            entries = entries.where(F.col("file_id").isin(list(file_ids)))
        self._write(sessions(entries, markers).select(*SESSIONS.names), "sessions_again", run_id)
        found = self.spark.read.schema(SESSIONS).parquet(self.path("sessions_again", run_id))
        sized = files.withColumn("size_bytes", F.col("summary.file_size"))
        self._write(summarize(entries, sized, self.uploads(), found=found), "summaries", run_id)
        return self.files().join(files.select("id"), "id", "left_semi")


_VIEWS = {"filters": FILTERS, "highlights": HIGHLIGHTS, "presets": PRESETS, "annotations": ANNOTATIONS}
# View rows belong to no batch of files.
_VIEW_BATCH = "views"


def _upload_id(batch_id: str):
    return F.md5(F.concat_ws("|", F.lit(batch_id), F.col("path")))


def _file_id():
    """From the upload, the path in it and, as names may repeat in an archive, the place in its directory."""
    return F.md5(F.concat_ws("|", "upload_id", F.coalesce("path_in_archive", F.lit("")), "member"))


def _with_text(rows: DataFrame) -> DataFrame:
    """Contents with encoding, cleaned text and format."""
    rows = rows.withColumn("encoding", detect_encoding(F.col("content")))
    return detect_text(rows.withColumn("text", clean_text(decode_text(F.col("content"), F.col("encoding")))))


def _chunks(rows: DataFrame, size: int):
    """``rows`` (path, ...) in chunks of about ``size``, so that names are never in the driver all at once; and what tells each chunk's paths."""
    count = rows.count()
    parts = -(-count // size)
    for i in range(parts):
        own = F.pmod(F.xxhash64("path"), F.lit(parts)) == i if parts > 1 else F.lit(True)
        yield rows.where(own), own


def intake(spark: SparkSession, paths, batch_id: str, catalog: Catalog, max_bytes: int) -> DataFrame:
    """Incoming files with content key, kind, encoding, format and what becomes of them.

    The key is the MD5 of the bytes for files of any size. Files that fit a row are keyed in
    one narrow pass over the folder that also tells encoding and format of the ordinary
    ones; bigger files are keyed from their blocks.
    """
    none = F.lit(None).cast("string")
    catalog._write(list_files(spark, paths).select(
        "path", "filename", F.col("length").alias("size_bytes"), _upload_id(batch_id).alias("id")
    ), "listing", batch_id)
    listed = spark.read.parquet(catalog.path("listing", batch_id))
    found = listed.select("path", F.col("size_bytes").alias("length")) if is_mounted(paths) else paths
    whole = _with_text(read_blobs(spark, found, min(WHOLE_FILE_BYTES, max_bytes))).select(
        "path", "md5", is_zip(F.col("filename"), F.col("content")).alias("zip"), "encoding", "format"
    )
    empty = listed.where("size_bytes = 0").select(
        "path", F.md5(F.lit(b"")).alias("md5"), F.lit(False).alias("zip"), F.lit(UTF8).alias("encoding"), F.lit("text").alias("format"))
    keyed = [whole, empty]
    sizes = F.col("size_bytes")
    for chunk, _ in _chunks(listed.where((sizes > WHOLE_FILE_BYTES) & (sizes <= min(ROW_BYTES, max_bytes))), CHUNK_FILES):
        keyed.append(read_blobs(spark, literal_paths(chunk)).select(
            "path", "md5", is_zip(F.col("filename"), F.col("content")).alias("zip"), none.alias("encoding"), none.alias("format")))
    for chunk, _ in _chunks(listed.where((sizes <= max_bytes) & (sizes > ROW_BYTES)), CHUNK_FILES):
        keyed.append(content_keys(spark, literal_paths(chunk)).select("*", none.alias("encoding"), none.alias("format")))
    # stored, as the search for copies takes them twice and would read the contents each time
    catalog._write(reduce(lambda a, b: a.unionByName(b), keyed), "keyed", batch_id)
    known = spark.read.parquet(catalog.path("keyed", batch_id))
    batch = listed.join(known, "path", "left").withColumn(
        "kind", F.when(F.coalesce("zip", F.lit(False)) | is_zip(F.col("filename")), "zip").otherwise("file")
    ).drop("zip")
    earlier = catalog.uploads().where(F.coalesce("batch_id", F.lit("")) != batch_id)
    return duplicate_report(batch, earlier, max_bytes)


class _Intake:
    """Reads the accepted files of a batch chunk by chunk and writes their entries.

    ``members`` and ``long_files`` keep what was learned of archive members and of files read by lines.
    """

    def __init__(self, catalog: Catalog, batch_id: str, default_tz: str):
        self.catalog, self.spark, self.batch_id, self.default_tz = catalog, catalog.spark, batch_id, default_tz
        self.written: set[str] = set()

    def _add(self, rows: DataFrame, table: str) -> None:
        self.catalog._write(rows, table, self.batch_id, "append" if table in self.written else "overwrite")
        self.written.add(table)

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.catalog.path(table, self.batch_id))

    def _store(self, records: DataFrame) -> None:
        rows = parse_records(records, self.default_tz).select(*ENTRY_COLUMNS)
        self._add(rows.sortWithinPartitions("upload_id", "file_id", "seq"), "entries")

    def _texts(self, texts: DataFrame) -> None:
        self._store(split_records(texts.select("upload_id", "file_id", "format", "text")))

    def ordinary(self, names: list[str], paths: DataFrame, chunk: DataFrame, own: Column) -> None:
        """Files that are one row each: read, decoded, cut, parsed and written in one map stage.

        Mounted files are opened by the tasks that the chunk's rows are dealt to. Others are read from the
        listing there is, as finding and listing a file again by its name takes longer than reading it:
        ``own`` leaves out the files of other chunks before any is opened, and what is known of the
        chunk's ``names``, bounded by its size, goes to every task.
        """
        if is_mounted(paths):
            blobs = with_contents(chunk.select("path", F.col("size_bytes").alias("length"), "encoding", "format"))
        else:
            named = self.spark.createDataFrame([(name,) for name in names], "name string")
            known = chunk.withColumn("name", literal_path(F.col("path"))).join(named, "name", "left_semi")
            known = F.broadcast(known.select("path", "encoding", "format").distinct())
            blobs = read_blobs(self.spark, paths, WHOLE_FILE_BYTES).where(own).join(known, "path")
        blobs = blobs.select(
            _upload_id(self.batch_id).alias("upload_id"), F.lit(None).cast("string").alias("path_in_archive"),
            F.lit(None).cast("bigint").alias("member"), "format",
            clean_text(decode_text(F.col("content"), F.col("encoding"))).alias("text"))
        self._texts(blobs.withColumn("file_id", _file_id()))

    def archives(self, names: list[str]) -> None:
        """Members are dealt out before they are inflated; those over a row are read by lines."""
        blobs = read_blobs(self.spark, names).select(_upload_id(self.batch_id).alias("upload_id"), "content")
        members = _with_text(expand_archives(blobs, "upload_id", WHOLE_FILE_BYTES).withColumnRenamed("member_name", "filename"))
        members = members.withColumn("file_id", _file_id())
        self._add(members.select(
            "upload_id", "file_id", "filename", "path_in_archive", "md5", "size_bytes", "encoding", "format", "archive_error", "error",
            (F.col("content").isNull() & F.col("error").isNull() & F.col("archive_error").isNull()).alias("by_lines"),
        ), "members")
        self._texts(members.where(F.col("content").isNotNull()))
        long = self._read("members").where("by_lines").select("file_id", "upload_id")
        if long.limit(1).count():
            lines = member_lines(blobs, "upload_id", WHOLE_FILE_BYTES).withColumn("file_id", _file_id())
            good = lines.select("file_id", "block", "pos", "value").join(long, "file_id", "left_semi")
            self._by_lines(good, long)

    def long(self, names: list[str]) -> None:
        """Files over a row are read by lines, block by block."""
        lines = read_lines(self.spark, names).withColumnRenamed("file_id", "path").select(
            _upload_id(self.batch_id).alias("upload_id"), F.lit(None).cast("string").alias("path_in_archive"),
            F.lit(None).cast("bigint").alias("member"), "block", "pos", "value").withColumn("file_id", _file_id())
        self._by_lines(lines.select("file_id", "block", "pos", "value"), lines.select("file_id", "upload_id").distinct())

    def _by_lines(self, lines: DataFrame, owners: DataFrame) -> None:
        self._add(_read_by_lines(lines), "long_files")
        meta = self._read("long_files").join(owners, "file_id")
        self._store(assemble_lines(lines, meta))

    def found(self, decided: DataFrame) -> DataFrame:
        """What is known of each file that was read, or was found in an archive."""
        none = F.lit(None).cast("string")
        rows = decided.where(F.col("kind") == "file").select(
            F.col("id").alias("upload_id"), "filename", none.alias("path_in_archive"), F.lit(None).cast("bigint").alias("member"), "md5",
            "size_bytes", "encoding", "format", none.alias("archive_error"), none.alias("error"),
        ).withColumn("file_id", _file_id()).drop("member")
        if "members" in self.written:
            rows = rows.unionByName(self._read("members").drop("by_lines"))
        if "long_files" in self.written:
            by_lines = self._read("long_files").select("file_id", F.col("encoding").alias("line_encoding"), F.col("format").alias("line_format"))
            rows = rows.join(by_lines, "file_id", "left").withColumn("encoding", F.coalesce("line_encoding", "encoding")).withColumn(
                "format", F.coalesce("line_format", "format")).drop("line_encoding", "line_format")
        return rows


def ingest(
    spark: SparkSession,
    paths: Paths,
    folder: str,
    batch_id: str,
    *,
    default_tz: str = "UTC",
    max_bytes: int = MAX_FILE_BYTES,
    max_files: int | None = None,
    markers: DataFrame | dict | None = None,
    nest: bool = False,
) -> DataFrame:
    """Ingest log files and archives as one batch and return the report of the batch.

    Ordinary files are read, decoded, assembled, parsed and written in one map stage: no
    content is ever shuffled. Files over WHOLE_FILE_BYTES go through the line path, block
    by block; both paths tell encodings and contents alike. Files are read in chunks, and
    only the names of one chunk pass through the driver. Running a batch id again replaces
    the batch and undoes deletions from it. ``markers`` become the catalogue's session
    markers. The report has a row for each file, or with ``nest`` for each upload.
    """
    ship_package(spark)
    with many_small_files(spark):
        return _ingest(spark, open_files(spark, paths), Catalog(spark, folder), batch_id, default_tz, max_bytes, max_files, markers, nest)


def _ingest(
    spark: SparkSession, paths: DataFrame, catalog: Catalog, batch_id: str, default_tz: str, max_bytes: int,
    max_files: int | None, markers: DataFrame | dict | None, nest: bool,
) -> DataFrame:
    if max_files is not None:
        count = list_files(spark, paths).count()
        if count > max_files:
            raise ValueError(f"{count} files exceed the limit of {max_files} per batch")
    if markers is not None:
        catalog._write(marker_table(spark, markers), "markers", batch_id)
    stamped = _utc_now()

    catalog._write(intake(spark, paths, batch_id, catalog, max_bytes), "intake", batch_id)
    decided = spark.read.parquet(catalog.path("intake", batch_id))
    taken = F.col("status") == "accepted"
    size, archived = F.col("size_bytes"), F.col("kind") == "zip"
    filled = decided.where(taken & (size > 0))

    reader = _Intake(catalog, batch_id, default_tz)
    reader._add(spark.createDataFrame([], ENTRIES), "entries")
    for chunk, own in _chunks(filled.where(~archived & (size <= WHOLE_FILE_BYTES)), CHUNK_FILES):
        reader.ordinary(literal_paths(chunk), paths, chunk, own)
    for rows, read in (
        (filled.where(archived & (size <= ROW_BYTES)), reader.archives),
        (filled.where(~archived & (size > WHOLE_FILE_BYTES)), reader.long),
    ):
        for chunk, _ in _chunks(rows, CHUNK_FILES):
            read(literal_paths(chunk))

    met = reader.found(decided.where(taken))
    failed = met.where(F.col("archive_error").isNotNull()).groupBy("upload_id").agg(F.min("archive_error").alias("archive_error"))
    unread = F.when(taken & archived, F.when(size == 0, "zip open: the file is empty").when(
        size > ROW_BYTES, "archive is too large to be opened"))
    reason = F.coalesce("archive_error", "error", unread)
    uploads = decided.join(failed, decided["id"] == failed["upload_id"], "left").select(
        "id", "filename", "md5", "size_bytes", "kind",
        F.when(taken, F.when(reason.isNotNull(), "failed").otherwise("parsed")).otherwise(F.col("status")).alias("status"),
        stamped.alias("uploaded_at"), reason.alias("error"), "existing_upload_id",
    )
    stored = spark.read.schema(ENTRIES).parquet(catalog.path("entries", batch_id))
    catalog._write(sessions(stored, catalog.markers()).select(*SESSIONS.names), "sessions", batch_id)
    found = spark.read.schema(SESSIONS).parquet(catalog.path("sessions", batch_id))
    catalog._write(_file_rows(stored, met.where(F.col("archive_error").isNull()), uploads, stamped, found), "files", batch_id)
    if catalog._exists(catalog.path("deleted", batch_id)):
        catalog._write(spark.createDataFrame([], _DELETED), "deleted", batch_id)
    # a duplicate and a file over the limit leave no trace but the report
    kept = uploads.where((F.col("status") != "duplicate") & (F.coalesce("error", F.lit("")) != TOO_LARGE))
    catalog._write(kept.select(*UPLOADS.names), "uploads", batch_id)
    return upload_report(uploads, spark.read.schema(FILES).parquet(catalog.path("files", batch_id)), nest)


def _read_by_lines(lines: DataFrame) -> DataFrame:
    """Encoding and format of files read by lines; bytes that are no UTF-8 do not matter here."""
    valid = F.is_valid_utf8(F.col("value"))
    readable = F.when(valid, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    detected = detect_lines(lines.withColumn("value", readable))
    return encoding_of_lines(lines).join(detected, "file_id")


def _utc_now():
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))


def _file_rows(entries: DataFrame, met: DataFrame, uploads: DataFrame, stamped, found: DataFrame) -> DataFrame:
    """Rows of the files table from what was read and stored of each file."""
    meta = met.withColumnRenamed("file_id", "id")
    summaries = summarize(entries, meta, uploads, found=found)
    joined = meta.join(summaries, meta["id"] == summaries["file_id"], "left")
    good = F.col("error").isNull()
    return joined.select(
        "id", "upload_id", "filename", "path_in_archive", "md5",
        F.coalesce("format", F.lit("text")).alias("format"),
        F.when(good, "parsed").otherwise("failed").alias("status"),
        F.when(good, F.col("summary.total_records")).otherwise(F.lit(0)).cast("bigint").alias("record_count"),
        F.when(good, stamped).alias("parsed_at"),
        "encoding",
        F.col("summary.first_ts").alias("first_ts"), F.col("summary.last_ts").alias("last_ts"),
        F.col("summary.duration_sec").alias("duration_sec"),
        F.when(good, "done").alias("pp_status"),
        F.when(good, stamped).alias("pp_at"),
        F.when(good, F.col("summary")).alias("summary"),
        "error",
    )
