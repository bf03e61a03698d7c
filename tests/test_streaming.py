"""Streaming histograms against the batch ones."""

from datetime import datetime, timedelta

import pytest

from loglake.operators.aggregates import histogram
from loglake.streaming.histogram import histogram_stream

SCHEMA = "ts timestamp_ntz, file_id string, seq long"


def drop(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("unit,by", [("hour", "file_id"), ("day", None)])
def test_stream_over_drops_equals_the_batch(spark, tmp_path, unit, by):
    """Buckets come out once, whole, and only when they are closed; the session zone skips an hour within the data."""
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    start = datetime(2018, 3, 10, 20, 30)
    first = [(start + timedelta(minutes=13 * i), f"f{i % 3}", i) for i in range(200)] + [(None, "f0", 900)]
    second = [(start + timedelta(minutes=13 * i + 5), f"f{i % 4}", i) for i in range(150, 400)]
    last = [(start + timedelta(days=30), "f9", 999)]
    seen = []
    for rows in (first, second, last):
        drop(spark, source, rows)
        stream = histogram_stream(spark.readStream.schema(SCHEMA).parquet(source), unit, by, lateness="24 hours")
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.parquet(sink).count())
    whole = histogram(spark.createDataFrame(first + second, SCHEMA), unit, by)
    got = spark.read.parquet(sink).select(*whole.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert 0 < seen[0] < seen[2] == whole.count()


def test_a_stream_has_no_months(spark, tmp_path):
    drop(spark, str(tmp_path), [(datetime(2020, 1, 1), "f", 1)])
    with pytest.raises(ValueError, match="month"):
        histogram_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path)), "month")
