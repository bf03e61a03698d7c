from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglake.functions.text import trim_space
from loglake.operators.assembly import clean_text, detect_text, parse_records, split_records
from loglake.operators.formats import FormatSpec, formats, parts, register_format, unregister_format

WEBLOGIC = ("####<Feb 9, 2021 11:04:59 AM CET> <Notice> <Cluster> <node7> <east1> <pool-3> <<anonymous>> <> <> "
            "<1612865099042> <BEA-000197> <Listening for peers> ")
ODL = "[2018-05-16T18:26:25.123+04:00] [comp] [ERROR] [] [module] [tid: t] [userId: u] [ecid: e] text [[\nCause: x\n]]"
STACK = "2020-10-05 08:30:11,204 INFO  [worker two] org.depot.Loader - 14 crates read\n\tat x.y\nCaused by: z"

CASES = [
    ("weblogic", WEBLOGIC, dict(
        ts=datetime(2021, 2, 9, 10, 4, 59, 42000), ts_raw="Feb 9, 2021 11:04:59 AM CET", tz_offset="Z", tz_inferred=False,
        level="info", component="Cluster", message="Listening for peers",
        attrs={"machine": "node7", "server": "east1", "thread": "pool-3", "millis": "1612865099042", "code": "BEA-000197"})),
    ("weblogic", "####<x> <Error> <C> <m> <s> <t> <1526480785513> <BEA-1> <a> <b>\nmore", dict(
        ts=datetime(2018, 5, 16, 14, 26, 25, 513000), message="a> <b\nmore", level="error")),
    ("weblogic", "####<x> <Error>", dict(ts=None, ts_raw="x", level="error", component=None, message="Error", attrs={})),
    ("weblogic", "before the first head ", dict(ts=None, ts_raw="", level=None, message="before the first head", attrs={})),
    ("wls_stdout", "<Mar 24, 2016 12:51:34 AM GMT+03:00> <INFO> <NodeManager> <Starting <x> y>", dict(
        ts=datetime(2016, 3, 23, 21, 51, 34), tz_offset="+03:00", tz_inferred=False, level="info", component="NodeManager",
        message="Starting <x> y")),
    ("wls_stdout", "<2016-03-16 GMT-3 19:45:41> <WARNING> <C> <m>\n", dict(
        ts=datetime(2016, 3, 16, 22, 45, 41), tz_offset="-03:00", level="warning", message="m\n")),
    ("wls_stdout", "<May 16, 2018 6:28:57 PM> <SEVERE> <C> <m>", dict(ts=datetime(2018, 5, 16, 18, 28, 57), tz_inferred=True, level="error")),
    ("java", STACK, dict(
        ts=datetime(2020, 10, 5, 8, 30, 11, 204000), tz_inferred=True, level="info", component="org.depot.Loader",
        message="14 crates read\n\tat x.y\nCaused by: z", attrs={"thread": "worker two"})),
    ("java", "2012-03-28 16:15:40,637 FATAL a.B - c", dict(level="critical", component="a.B", message="c", attrs={})),
    ("java", "2012-03-28 16:15:40,637 INFO nothing here", dict(ts=None, ts_raw="", level=None, message=None)),
    ("access", '127.0.0.1 - - [16/May/2018:18:08:04 +0400] "GET /a/ HTTP/1.1" 503 895 ', dict(
        ts=datetime(2018, 5, 16, 14, 8, 4), tz_offset="+04:00", level="error", component="GET /a/", message="GET /a/ HTTP/1.1",
        attrs={"host": "127.0.0.1", "method": "GET", "path": "/a/", "proto": "HTTP/1.1", "status": "503", "size": "895"})),
    ("access", "", dict(ts=None, message=None, raw_line="")),
    ("odl", ODL, dict(
        ts=datetime(2018, 5, 16, 14, 26, 25, 123000), tz_offset="+04:00", level="error", component="comp",
        message="text [[\nCause: x\n]]", attrs={"module": "module", "tid": "t", "userId": "u", "ecid": "e"})),
    ("odl", "[2018-05-16T18:26:25.123+04:00] short\nextra", dict(ts=None, level=None, message="extra")),
    ("oracle", "2019-05-31T14:52:53.818309-04:00\n \n Errors in file \nORA-1", dict(
        ts=datetime(2019, 5, 31, 18, 52, 53, 818309), tz_offset="-04:00", level="error", message="Errors in file", component=None)),
    ("oracle", "2019-05-31T14:52:53.818309-04:00", dict(message="2019-05-31T14:52:53.818309-04:00", level=None)),
    ("oracle", "errors before any head", dict(ts=None, level=None, message="errors before any head")),
    ("text", "== Thu Oct 1 07:00:30 GMT+2 2020 pumps on ==", dict(
        ts=datetime(2020, 10, 1, 5, 0, 30), ts_raw="Thu Oct 1 07:00:30 GMT+2 2020", tz_offset="+02:00")),
    ("weblogic", "####<x> <Error> <C> <m> <s> <t> <not a time> <BEA-1> <text>", dict(ts=None, ts_raw="x", message="text", component="C")),
    ("oracle", "2019-05-31T14:52:53.818309-04:00\n\n   ", dict(message="2019-05-31T14:52:53.818309-04:00")),
    ("unknown", "text", dict(ts=None, ts_raw="", message=None, level=None, attrs={})),
    ("text", "  some fatal line ", dict(ts=None, ts_raw="", level="critical", message="some fatal line", raw_line="  some fatal line ")),
    ("text", "on Feb 30, 2018 6:28:57 PM it was", dict(ts=None, ts_raw="")),
]


def test_fields_of_each_format(spark):
    df = spark.createDataFrame([(i, fmt, raw) for i, (fmt, raw, _) in enumerate(CASES)], "i int, format string, raw_line string")
    rows = {r.i: r.asDict() for r in parse_records(df).collect()}
    for i, (_, raw, want) in enumerate(CASES):
        assert {k: rows[i][k] for k in want} == want, raw


def test_default_zone_reaches_the_parsers(spark):
    df = spark.createDataFrame([("java", STACK)], "format string, raw_line string")
    assert parse_records(df, "Europe/Moscow").first().ts == datetime(2020, 10, 5, 5, 30, 11, 204000)


def parsed(spark, text):
    df = spark.createDataFrame([("f", text)], "file_id string, text string").withColumn("text", clean_text(F.col("text")))
    return parse_records(split_records(detect_text(df))).orderBy("seq").collect()


def test_three_text_records(spark):
    rows = parsed(spark, "no head here\n== Thu Oct 1 07:00:30 GMT+2 2020 pumps on ==\nlast words\n")
    assert [(r.seq, r.format) for r in rows] == [(1, "text"), (2, "text"), (3, "text")]
    assert rows[1].ts == datetime(2020, 10, 1, 5, 0, 30)


def test_custom_format_by_columns(spark):
    def fields(raw):
        return parts(message=F.upper(trim_space(raw)), level_word=F.lit("warn"), component=F.lit("own"))

    register_format(FormatSpec("own", fields, head=r"@@"))
    try:
        assert [s.name for s in formats()][-2:] == ["own", "text"]
        rows = parsed(spark, "@@ a\nb\n@@ c\n")
        assert [(r.format, r.message, r.level, r.component) for r in rows] == [("own", "@@ A\nB", "warning", "own"), ("own", "@@ C", "warning", "own")]
    finally:
        unregister_format("own")
    assert parsed(spark, "@@ a\nb")[0].format == "text"


def test_custom_format_overrides_and_frames(spark):
    def frame(records, default_tz):
        def run(batches):
            for batch in batches:
                batch["message"] = batch["raw_line"].str[::-1]
                yield batch

        done = records.withColumn("message", F.lit("")).mapInPandas(run, "file_id string, format string, seq long, raw_line string, message string")
        none = F.lit(None).cast("string")
        return done.select("*", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("").alias("ts_raw"), F.lit("").alias("tz_offset"),
                           F.lit(False).alias("tz_inferred"), none.alias("level"), none.alias("component"),
                           F.create_map().cast("map<string,string>").alias("attrs"))

    register_format(FormatSpec("access", head="GET", multiline=False, frame_fields=frame))
    try:
        assert [(r.format, r.message) for r in parsed(spark, "GET x\ny")] == [("access", "x TEG"), ("access", "y")]
    finally:
        unregister_format("access")
    with pytest.raises(ValueError):
        register_format(FormatSpec("headless"))


def test_custom_format_by_batches(spark):
    """A parser over pandas batches: what it leaves out is NULL, a time may be a text in a known layout."""
    seen = []

    def parse(raw, default_tz):
        seen.append(default_tz)
        fields = [dict(x.split("=", 1) for x in r.split("|")[1:]) for r in raw]
        return pd.DataFrame({"ts_text": [f.get("at") for f in fields], "level": [f.get("sev") for f in fields],
                             "message": [f.get("msg") for f in fields], "attrs": fields})

    register_format(FormatSpec("pipes", head=r"EV\|", parse_batch=parse))
    try:
        rows = parsed(spark, "EV|at=2020-10-05 08:30:11,204|sev=Fatal|msg=a=b\nEV|msg=\nEV|at=16/May/2018:18:34:08 +0400\n")
        whole = spark.createDataFrame([("x", 7, "pipes", "EV|sev=warn"), ("y", 8, "java", STACK), ("z", 9, None, "?")], "k string, n int, format string, raw_line string")
        mixed = {r.k: (r.n, r.level, r.component) for r in parse_records(whole).collect()}
        entry = parse_records(whole.where("k = 'x'"))
        assert entry.schema["attrs"].dataType.simpleString() == "map<string,string>" and entry.first().attrs == {"sev": "warn"}
    finally:
        unregister_format("pipes")
    assert [(r.seq, r.ts, r.ts_raw, r.tz_offset, r.tz_inferred, r.level, r.message) for r in rows] == [
        (1, datetime(2020, 10, 5, 8, 30, 11, 204000), "2020-10-05 08:30:11,204", "", True, "critical", "a=b"),
        (2, None, "", "", False, None, None),
        (3, datetime(2018, 5, 16, 14, 34, 8), "16/May/2018:18:34:08 +0400", "+04:00", False, None, None)]
    assert mixed == {"x": (7, "warning", None), "y": (8, "info", "org.depot.Loader"), "z": (9, None, None)}


def test_a_parser_must_return_a_row_for_each_record(spark):
    register_format(FormatSpec("short", head="S", parse_batch=lambda raw, tz: pd.DataFrame({"message": raw[:1]})))
    try:
        with pytest.raises(Exception, match="1 rows for 2 records"):
            parsed(spark, "S a\nS b\n")
    finally:
        unregister_format("short")


def test_parsing_compiles(spark):
    """No value is bound by a function over an array of one: those are interpreted."""
    df = spark.createDataFrame([("java", STACK)], "format string, raw_line string")
    plan = parse_records(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("Project") >= 6
