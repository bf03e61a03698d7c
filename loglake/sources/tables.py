"""The driver's tables seen as log data.

Every adapter is a projection of a whole table (or a grouping where the catalogue needs
one), so a query over it does work in proportion to the table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loglake.operators.assembly import clean_text
from loglake.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_level(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "error")
        .when(event_type == "purchase", "warning")
        .when(event_type == "view", F.lit(None))
        .otherwise("info")
    )


def event_message() -> Column:
    return F.concat("event_type", F.lit(" value="), F.col("value").cast("decimal(18,2)").cast("string"))


def entries_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """One entry per event: a user is a file, fifty users are an upload."""
    ts_raw = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.expr("user_id div 50")).alias("upload_id"),
        F.concat(F.lit("f"), "user_id").alias("file_id"),
        (F.col("event_id") + 1).alias("seq"),
        F.lit("text").alias("format"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        ts_raw.alias("ts_raw"),
        F.lit("Z").alias("tz_offset"),
        F.lit(False).alias("tz_inferred"),
        event_level(F.col("event_type")).alias("level"),
        F.col("event_type").alias("component"),
        event_message().alias("message"),
        F.concat(ts_raw, F.lit(" "), "event_type", F.lit(" user="), "user_id", F.lit(" "), "props").alias("raw_line"),
        F.from_json("props", "map<string,string>").alias("attrs"),
    )


def files_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """The file catalogue that goes with ``entries_from_events``."""
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(F.col("ts").cast("timestamp_ntz")).alias("first_ts"),
        F.max(F.col("ts").cast("timestamp_ntz")).alias("last_ts"),
    ).select(
        F.concat(F.lit("f"), "user_id").alias("id"),
        F.concat(F.lit("u"), F.expr("user_id div 50")).alias("upload_id"),
        F.concat(F.lit("f"), "user_id", F.lit(".log")).alias("filename"),
        F.lit("text").alias("format"),
        F.lit("UTF-8").alias("encoding"),
        (F.col("record_count") * 100).alias("size_bytes"),
        "record_count", "first_ts", "last_ts",
    )


def uploads_from_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.expr("user_id div 50").alias("n")).agg(
        F.count(F.lit(1)).alias("records"), F.min(F.col("ts").cast("timestamp_ntz")).alias("uploaded_at")
    ).select(
        F.concat(F.lit("u"), "n").alias("id"), (F.col("records") * 1000).alias("size_bytes"), "uploaded_at",
    )


def texts_from_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document is the whole text of a file."""
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text")


def entries_from_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("source").alias("upload_id"),
        F.col("doc_id").cast("string").alias("file_id"),
        F.lit(1).cast("bigint").alias("seq"),
        F.lit("text").alias("format"),
        F.lit(None).cast("string").alias("level"),
        F.col("lang").alias("component"),
        F.col("text").alias("message"),
        F.col("text").alias("raw_line"),
    )


#: Files that a task puts in one folder.
FOLDER_FILES = 1000


def _file_of_each(folder: str):
    """Rows (doc_id, text) sorted by doc_id: those of one doc_id are lines of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written, current, file = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file is None or doc_id != current:
                    if file:
                        file.close()
                    below = f"{folder}/{part:06d}-{written // FOLDER_FILES:06d}"
                    if written % FOLDER_FILES == 0:
                        os.makedirs(below, exist_ok=True)
                    current, file = doc_id, open(f"{below}/{doc_id}.txt", "wb")  # noqa: SIM115
                    written += 1
                file.write((text.as_buffer() if text.is_valid else b""))
                file.write(b"\n")
        if file:
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    return run


def write_documents(spark: SparkSession, folder: str, target: str) -> None:
    """Each document as a file below ``target``.

    Hadoop's client starts processes to set the rights of each file of a mounted folder, at
    some ms each, so tasks write the files there themselves; elsewhere Spark's writer does.
    """
    rows = table(spark, folder, "documents").select("doc_id", "text")
    at = urlsplit(target)
    if at.scheme not in ("", "file"):
        rows.write.option("lineSep", "\n").partitionBy("doc_id").text(target)
        return
    ship_package(spark)
    path = unquote(at.path) if at.scheme else target
    os.makedirs(path, exist_ok=True)
    rows.sortWithinPartitions("doc_id").mapInArrow(_file_of_each(path), "files long").agg(F.sum("files")).collect()


# ---- events written as log lines ---------------------------------------------

# Which format the log of a user is written in, by user number.
EVENT_FORMATS = ("oracle", "weblogic", "wls_stdout", "java", "access", "odl", "text")


def _at(pattern: str, shift_hours: int = 0) -> Column:
    ts = F.col("ts").cast("timestamp_ntz")
    if shift_hours:
        ts = ts + F.make_dt_interval(hours=F.lit(shift_hours))
    return F.date_format(ts, pattern)


def _word(error: str, warning: str, info: str) -> Column:
    kind = F.col("event_type")
    return F.when(kind == "error", error).when(kind == "purchase", warning).otherwise(info)


def render_head(fmt: str) -> Column:
    """The head line of an event in a format."""
    c = F.lit
    kind, user, event, text = F.col("event_type"), F.col("user_id"), F.col("event_id"), event_message()
    if fmt == "oracle":
        return F.concat(_at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", -4), c("-04:00"))
    if fmt == "weblogic":
        millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
        return F.concat(
            c("####<"), _at("MMM d, yyyy h:mm:ss a", 3), c(" MSK> <"), _word("Error", "Warning", "Notice"), c("> <"), kind,
            c("> <m"), user, c("> <server> <main> <<WLS Kernel>> <> <> <"), millis, c("> <BEA-"), event, c("> <"), text, c("> "),
        )
    if fmt == "wls_stdout":
        return F.concat(
            c("<"), _at("MMM d, yyyy h:mm:ss a", 3), c(" GMT+03:00> <"), _word("SEVERE", "WARNING", "INFO"), c("> <"), kind,
            c("> <"), text, c(">"),
        )
    if fmt == "java":
        return F.concat(_at("yyyy-MM-dd HH:mm:ss,SSS"), c(" "), _word("ERROR", "WARN", "INFO"), c("  [t-"), user, c("] app."),
                        kind, c(" - "), text)
    if fmt == "access":
        return F.concat(
            c("h"), user, c(" - - ["), _at("dd/MMM/yyyy:HH:mm:ss", 4), c(' +0400] "GET /'), kind, c("/"), event,
            c(' HTTP/1.1" '), _word("500", "404", "200"), c(" "), event,
        )
    if fmt == "odl":
        return F.concat(
            c("["), _at("yyyy-MM-dd'T'HH:mm:ss.SSS", 4), c("+04:00] ["), kind, c("] ["),
            _word("ERROR", "WARNING", "NOTIFICATION"), c("] [] [mod] [tid: t"), user, c("] [userId: u"), user,
            c("] [ecid: e"), event, c("] "), text,
        )
    return F.concat(c("##### "), _at("EEE MMM d HH:mm:ss", -4), c(" GMT-4 "), _at("yyyy", -4), c(" "), text)


def render_lines(fmt: str) -> Column:
    """All lines of an event: errors go on for a second line where the format allows it."""
    head = render_head(fmt)
    lines = F.array(head, event_message()) if fmt == "oracle" else F.array(head)
    if fmt in ("access", "text"):
        return lines
    return F.when(F.col("event_type") == "error", F.concat(lines, F.array(F.lit("\tat app.Main")))).otherwise(lines)


def rendered_records(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    """Every event as one record of a format."""
    return table(spark, folder, "events").select(
        "event_id", F.lit(fmt).alias("format"), F.array_join(render_lines(fmt), "\n").alias("raw_line")
    )


def rendered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The logs of all users as lines, each user in one of the formats."""
    which = F.pmod("user_id", F.lit(len(EVENT_FORMATS)))
    lines = F.coalesce(*[F.when(which == i, render_lines(fmt)) for i, fmt in enumerate(EVENT_FORMATS)])
    exploded = table(spark, folder, "events").select("user_id", "event_id", F.posexplode(lines).alias("i", "value"))
    return exploded.select(
        F.concat(F.lit("f"), "user_id").alias("file_id"),
        F.expr("event_id div 1000").alias("block"),
        (F.col("event_id") * 8 + F.col("i")).alias("pos"),
        "value",
    )


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all documents, in blocks of sixteen."""
    texts = texts_from_documents(spark, folder).withColumn("text", clean_text(F.col("text"))).where("text IS NOT NULL")
    lines = texts.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return lines.withColumn("block", F.expr("pos div 16"))
