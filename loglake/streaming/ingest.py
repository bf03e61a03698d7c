"""Continuous ingestion of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loglake.plans.catalog import MAX_FILE_BYTES, Catalog, ingest
from loglake.session import few_tasks, many_small_files
from loglake.sources.files import basename, empty_files, literal_paths, mounted

FILES_PER_TRIGGER = 1000

# Fixed value: the schema of Spark's binary file source, which a stream must be given.
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(
    spark: SparkSession,
    folder_in: str,
    catalog_folder: str,
    checkpoint: str,
    *,
    default_tz: str = "UTC",
    max_bytes: int = MAX_FILE_BYTES,
    files_per_trigger: int = FILES_PER_TRIGGER,
    bytes_per_trigger: int | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Ingest files as they appear below ``folder_in``; each micro-batch is a catalogue batch.

    The stream carries names and sizes only; the batch pipeline reads the contents. Names of files in
    mounted folders go from the stream to the batch's listing without the driver. A micro-batch
    admits at most ``files_per_trigger`` files, or about ``bytes_per_trigger`` bytes if that
    is given, so neither names nor plan grow with the folder. A replayed micro-batch has the
    same batch id and replaces what it wrote before. Spark gives no row for an empty file:
    the first one met becomes an upload, as further ones are duplicates of it.
    """
    admitted = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    names = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option(*admitted)
        .load(folder_in)
        .select("path", "length")
    )

    def take(batch: DataFrame, epoch: int) -> None:
        session, batch_id = batch.sparkSession, f"stream-{epoch:012d}"
        named = mounted(session, folder_in) is None  # then the batch is told by its names, which tasks can't open
        earlier, empty = Catalog(session, catalog_folder).uploads().where(F.col("batch_id") != batch_id), []
        if not earlier.where("size_bytes = 0").limit(1).count():
            first = empty_files(session, folder_in).orderBy(basename(F.col("path")), "path").limit(1)
            empty = literal_paths(first) if named else [(row["path"], 0) for row in first.collect()]
        if named:
            paths = some = literal_paths(batch) + empty
        else:
            paths = batch.unionByName(session.createDataFrame(empty, batch.schema))
            some = empty or not batch.isEmpty()
        if some:
            ingest(session, paths, catalog_folder, batch_id, default_tz=default_tz, max_bytes=max_bytes)

    writer = names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    few_tasks(spark)  # the source lists and deals files in the caller's session for as long as the stream runs
    with many_small_files(spark):  # the batches keep the settings the stream starts with
        return writer.start()
