from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglake.functions.levels import level_by_content, level_from_http_status, normalize_level
from loglake.functions.text import check_pattern, contains_like, java_pattern, regexp_match, tokenize, trim_space
from loglake.functions.times import first_date, parse_datetime, time_bucket

DATES = [
    ("2016-03-16 GMT-3 19:45:41", datetime(2016, 3, 16, 22, 45, 41), "-03:00", False),
    ("2016-03-16 GMT+0 19:45:41", datetime(2016, 3, 16, 19, 45, 41), "+00:00", False),
    ("2019-05-31T14:52:53.818309-04:00", datetime(2019, 5, 31, 18, 52, 53, 818309), "-04:00", False),
    ("2019-05-31T14:52:53+00:00", datetime(2019, 5, 31, 14, 52, 53), "Z", False),
    ("2019-05-31T14:52:53.1234567-04:30", datetime(2019, 5, 31, 19, 22, 53, 123456), "-04:30", False),
    ("16/May/2018:18:34:08 +0400", datetime(2018, 5, 16, 14, 34, 8), "+04:00", False),
    ("2012-03-28 16:15:40,637", datetime(2012, 3, 28, 16, 15, 40, 637000), "", True),
    ("May 16, 2018 6:28:57 PM", datetime(2018, 5, 16, 18, 28, 57), "", True),
    ("May 16, 2018 12:00:01 AM", datetime(2018, 5, 16, 0, 0, 1), "", True),
    ("May 16, 2018 6:26:25 PM MSK", datetime(2018, 5, 16, 18, 26, 25), "", True),
    ("Mar 24, 2016 12:51:34 AM GMT+03:00", datetime(2016, 3, 23, 21, 51, 34), "+03:00", False),
    ("May 16, 2018 16:28:57 MSK", datetime(2018, 5, 16, 16, 28, 57), "", True),
    ("Wed Mar 28 16:17:29 GMT-4 2012", datetime(2012, 3, 28, 20, 17, 29), "-04:00", False),
    ("Wed Mar 28 16:17:29 MSK 2012", datetime(2012, 3, 28, 16, 17, 29), "", True),
    # a time the test session's zone skips: it must pass unchanged
    ("2018-03-11 02:30:00,000", datetime(2018, 3, 11, 2, 30), "", True),
    ("Feb 30, 2018 6:28:57 PM", None, "", False),
    ("Foo 30, 2018 6:28:57 PM", None, "", False),
    ("May 16, 2018 13:28:57 PM", None, "", False),
    ("2019-05-31T14:52:53.818309-04:00 more", None, "", False),
    ("no date", None, "", False),
    ("", None, "", False),
]


def _one(spark, rows, *columns):
    return spark.createDataFrame([(r,) for r in rows], "s string").select("s", *columns).collect()


def test_parse_datetime_layouts(spark):
    rows = _one(spark, [d[0] for d in DATES], parse_datetime(F.col("s")).alias("d"))
    for row, (text, ts, offset, inferred) in zip(rows, DATES):
        assert (row.d.ts, row.d.tz_offset, row.d.tz_inferred) == (ts, offset, inferred), text
        assert row.d.ts_raw == text


def test_parse_datetime_default_zone(spark):
    rows = _one(spark, ["2012-03-28 16:15:40,637", "16/May/2018:18:34:08 +0400"], parse_datetime(F.col("s"), "Europe/Moscow").alias("d"))
    assert rows[0].d.ts == datetime(2012, 3, 28, 12, 15, 40, 637000)
    assert rows[1].d.ts == datetime(2018, 5, 16, 14, 34, 8)
    unknown = _one(spark, ["2012-03-28 16:15:40,637"], parse_datetime(F.col("s"), "No/Where").alias("d"))
    assert unknown[0].d.ts == datetime(2012, 3, 28, 16, 15, 40, 637000)


def test_first_date(spark):
    rows = _one(spark, [f"## {d[0]} and more" for d in DATES[:14]] + ["nothing 2018"], first_date(F.col("s")).alias("f"))
    assert [r.f for r in rows] == [d[0] for d in DATES[:14]] + [None]


def test_levels(spark):
    words = {"Error": "error", "ALERT": "error", " Notice ": "info", "FINEST": "debug", "Fatal": "critical", "trace": "trace",
             "ORA-600": "error", "some error": "error", "critical error": "critical", "warned": "warning", "x": None, "": None}
    rows = _one(spark, list(words), normalize_level(F.col("s")).alias("l"))
    assert {r.s: r.l for r in rows} == words
    texts = {"an error": None, "Errors in": "error", "ora-1": "error", "fatal errors": "critical", "Warnings": "warning", "ok": None}
    rows = _one(spark, list(texts), level_by_content(F.col("s")).alias("l"))
    assert {r.s: r.l for r in rows} == texts
    rows = spark.createDataFrame([(500,), (404,), (302,)], "s int").select(level_from_http_status(F.col("s")).alias("l")).collect()
    assert [r.l for r in rows] == ["error", "warning", "info"]


@pytest.mark.parametrize("q,hits", [
    ("SECUR", {"Security on"}), ("r_t", {"Security on"}), ("s%on", {"Security on"}), ("É", {"caFÉ"}), ("é", set()),
    ("fÉ", {"caFÉ"}), (r"a\Eb", {r"xa\Eby"}), ("a.b", set()), ("%", {"Security on", "caFÉ", r"xa\Eby", "Kelvin"}),
    ("kelvin", set()), ("elvin", {"Kelvin"}),
])
def test_contains_like(spark, q, hits):
    rows = _one(spark, ["Security on", "caFÉ", r"xa\Eby", "Kelvin"], contains_like(F.col("s"), q).alias("m"))
    assert {r.s for r in rows if r.m} == hits


def test_regexp_match(spark):
    assert java_pattern("(?P<n>a)$") == r"(?d)(?<n>a)\z"
    assert java_pattern(r"a\$") == r"(?d)a\$"
    rows = spark.createDataFrame([("abc\n",), ("abc",), ("",), (None,), ("ABC",)], "s string").select(
        regexp_match(F.col("s"), "^a.*c$").alias("m")).collect()
    assert [r.m for r in rows] == [False, True, False, False, False]
    with pytest.raises(ValueError):
        check_pattern("[bad(")


def test_tokens_buckets_and_trim(spark):
    row = spark.range(1).select(
        tokenize(F.lit("Hello, a-B_c é 12!")).alias("t"),
        time_bucket(F.lit("2018-05-16 18:06:25.5").cast("timestamp_ntz"), "minute").alias("minute"),
        time_bucket(F.lit("2018-05-16 18:06:25.5").cast("timestamp_ntz"), "hour").alias("hour"),
        time_bucket(F.lit("2018-05-16 18:06:25.5").cast("timestamp_ntz"), "month").alias("month"),
        time_bucket(F.lit("2018-05-16 18:06:25.5").cast("timestamp_ntz"), "year").alias("day"),
        trim_space(F.lit("\t  x y　\r")).alias("trimmed"),
    ).first()
    assert row.t == ["hello", "a-b_c", "12"]
    assert (row.minute, row.hour, row.month, row.day) == ("2018-05-16T18:06", "2018-05-16T18", "2018-05", "2018-05-16")
    assert row.trimmed == "x y"
