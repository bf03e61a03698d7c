"""Search, correlation, histograms, views on small inline entries."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglake.operators import aggregates, pages, views
from loglake.operators.predicates import entry_filter, file_list, parse_attr_filter
from loglake.schema import ANNOTATIONS, ENTRIES

A, B = "a.log", "b.log"


def at(second):
    return datetime(2018, 5, 16, 14, 26, second)


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        ("u", A, 1, "weblogic", at(25), "r1", "Z", False, "info", "Security", "Security initializing", "####<Security>", {"user": "alice", "status": "200"}),
        ("u", A, 2, "weblogic", at(31), "r2", "Z", False, "error", "Server", "other", "####<x>", {"user": "bob", "status": "404"}),
        ("u", B, 1, "java", at(28), "r3", "", True, "info", "com.bea", "done", "line", {"user": "alice", "status": "404"}),
        ("u", B, 2, "java", None, "", "", False, None, None, None, "\tat z", {}),
        ("v", "c.log", 1, "text", at(28), "", "", False, "warning", None, "x", "x", {}),
    ]
    return spark.createDataFrame(rows, ENTRIES)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(A, "u", "A.log"), (B, "u", "B.log"), ("c.log", "v", "C.log")], "id string, upload_id string, filename string")


def ids(df):
    return [(r.file_id, r.seq) for r in df.collect()]


def test_correlate_order_total_and_window(entries, files):
    page = pages.correlate(entries, files, "u")
    assert ids(page.items) == [(A, 1), (B, 1), (A, 2), (B, 2)]
    assert page.total.first().total == 4 and page.items.first().filename == "A.log"
    window = pages.correlate(entries, files, "u", ts_from="2018-05-16T14:26:26Z", ts_to="2018-05-16T18:26:30+04:00")
    assert ids(window.items) == [(B, 1)] and window.total.first().total == 1
    assert pages.correlate(entries, files, "u", files=[A]).total.first().total == 2
    assert pages.correlate(entries, files, "nowhere").total.first().total == 0
    cut = pages.correlate(entries, files, "u", limit=1, offset=1)
    assert ids(cut.items) == [(B, 1)] and cut.total.first().total == 4


def test_correlate_keyset_equals_offset(entries, files):
    every = pages.correlate(entries, files, limit=-1).items.collect()
    for i, row in enumerate(every):
        rest = pages.correlate(entries, files, limit=-1, after=(row.ts, row.seq, row.file_id)).items
        assert ids(rest) == [(r.file_id, r.seq) for r in every[i + 1:]]


def test_correlate_scans_the_entries_once(spark, entries, files, tmp_path):
    entries.write.parquet(str(tmp_path / "e"))
    files.write.parquet(str(tmp_path / "f"))
    stored, names = spark.read.schema(ENTRIES).parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "f"))
    page = pages.correlate(stored, names, "u", q="alice", limit=2)
    plan = page.items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("raw_line") > 0 and sum("FileScan" in line and "raw_line" in line for line in plan.split("\n")) == 1
    assert "TakeOrderedAndProject" in plan and ids(pages.correlate(stored, names, "u", limit=2).items) == [(A, 1), (B, 1)]
    wide = pages.correlate(stored, names, limit=5000, cap=None)
    assert wide.limit == 5000 and wide.items.count() == 5 and pages.correlate(stored, names, limit=5000).limit == 1000
    assert pages.search(stored, limit=-1, cap=None).count() == 5


def test_search_modes(entries, files):
    def found(**filters):
        return ids(pages.search(entries, files, "u", **filters))

    assert found(q="security") == [(A, 1)]
    assert found(q="Security", mode="regex") == [(A, 1)]
    assert found(q="^.*Security.*$", mode="regex", fields="raw") == [(A, 1)]
    assert found(q="initializing", fields="raw") == []
    assert found(q="r1") == [(A, 1)]
    assert found(attrs="user:alice") == [(A, 1), (B, 1)]
    assert found(attrs="user:alice,status:200") == [(A, 1)]
    assert found(attrs="nonexistent:foo") == []
    assert found(attrs="user") == found(attrs="user:") == [(A, 1), (A, 2), (B, 1)]
    assert found(files="a.log, ") == [(A, 1), (A, 2)]
    assert found(level="error") == [(A, 2)]
    assert found(limit=1, offset=2) == [(B, 1)]
    with pytest.raises(ValueError):
        entry_filter(q="[bad(", mode="regex")


def test_filter_texts():
    assert file_list(" a, ,b") == ["a", "b"]
    assert parse_attr_filter("a: x ,b,c:1:2") == [("a", "x"), ("b", ""), ("c", "1:2")]
    for bad in (":v", " , "):
        with pytest.raises(ValueError):
            parse_attr_filter(bad)
    assert pages.page_bounds() == (100, 0)
    assert pages.page_bounds(5000, -3) == (1000, 0)
    assert pages.page_bounds(-1, 7) == (-1, 7)


def test_file_entries(entries):
    page = pages.file_entries(entries, A, q="SERVER")
    assert ids(page.items) == [(A, 2)] and page.total.first().total == 1
    assert ids(pages.file_entries(entries, A, q="r1").items) == []


def test_lists(spark):
    uploads = spark.createDataFrame([("1", "b.log", 5), ("2", "A.log", 9), ("3", "c.txt", 1)], "id string, filename string, size_bytes int")
    uploads = uploads.withColumn("uploaded_at", F.col("size_bytes"))
    assert [r.id for r in pages.uploads_list(uploads, "size_bytes", "DESC").collect()] == ["2", "1", "3"]
    assert [r.id for r in pages.uploads_list(uploads, "drop table").collect()] == ["3", "1", "2"]
    assert [r.id for r in pages.uploads_list(uploads, "filename", filter_text=".LOG").collect()] == ["2", "1"]


def test_histograms(entries):
    scoped = entries.where("upload_id = 'u'")
    hist = aggregates.histogram(scoped, "hour", "file_id")
    assert [tuple(r) for r in hist.collect()] == [("2018-05-16T14", A, 2), ("2018-05-16T14", B, 1)]
    assert aggregates.histogram_total(hist).first().total == 3
    assert [tuple(r) for r in aggregates.stack_totals(hist).collect()] == [("2018-05-16T14", 3, 2)]
    pivot = aggregates.histogram(scoped, "minute", "file_id", pivot=[A, B, "none"]).collect()
    assert [tuple(r) for r in pivot] == [("2018-05-16T14:26", 2, 1, 0)]
    assert aggregates.histogram(scoped.where("ts IS NULL"), "day").count() == 0
    bounds = aggregates.timeline(scoped).first()
    assert (bounds.min_ts, bounds.max_ts) == (at(25), at(31))
    assert tuple(aggregates.timeline(scoped.where("false")).first()) == (None, None)


def test_lexemes_and_stats(entries, files):
    top = aggregates.lexemes(entries.where("upload_id = 'u'"), limit=2).collect()
    assert [tuple(r) for r in top] == [("security", 2), ("done", 1)]
    assert "at" not in {r.term for r in aggregates.lexemes(entries).collect()}
    none = files.limit(0).withColumn("size_bytes", F.lit(1))
    assert tuple(aggregates.storage_stats(none, files, entries).first()) == (0, 0, 3, 5)


def test_highlights(spark, entries):
    rules = [("DONE", "#1"), ("security", "#2"), ("i", "#3"), ("", "#4")]
    colors = {(r.file_id, r.seq): r.color for r in views.highlight(entries, rules).collect()}
    assert colors == {(A, 1): "#2", (A, 2): None, (B, 1): "#1", (B, 2): None, ("c.log", 1): "#3"}
    table = spark.createDataFrame(
        [("u", "1", "DONE", "#1", 1), ("u", "3", "i", "#3", 3), ("u", "2", "security", "#2", 2)],
        "upload_id string, id string, text string, color string, created_at int")
    by_table = {(r.file_id, r.seq): r.color for r in views.highlight(entries, table).collect()}
    assert by_table == {**colors, ("c.log", 1): None}


def test_markup(spark):
    df = spark.createDataFrame([("u", "a.B a.b $1 \\E x"), ("v", None)], "upload_id string, message string")
    rows = views.highlight_markup(df, [("A.b", "$0\\"), ("\\E", "c")]).collect()
    mark = '<mark style="background:{}40">{}</mark>'.format
    assert rows[0].marked == f"{mark('$0' + chr(92), 'a.B')} {mark('$0' + chr(92), 'a.b')} $1 {mark('c', chr(92) + 'E')} x"
    assert rows[1].marked == ""
    # a later rule also sees the marks of an earlier one
    again = views.mark_text(F.lit("x"), [("x", "r"), ("mark", "s")])
    assert spark.range(1).select(again.alias("m")).first().m.count("<mark style") == 2
    table = spark.createDataFrame([("u", 1, "a.b", "r", 1)], "upload_id string, id int, text string, color string, created_at int")
    assert {r.upload_id: r.marked for r in views.highlight_markup(df, table).collect()}["v"] == ""


def test_annotations(spark, entries, files):
    rows = [
        ("1", "u", A, 5, None, "n", "c", None), ("2", "u", None, None, at(28), "n", "c", None),
        ("3", "u", A, None, None, "n", "c", None), ("4", "u", A, 1, None, "", "c", None),
        ("5", "u", A, 1, at(28), "n", "c", None), ("6", "u", "gone", 2, None, "n", "c", None), ("7", "u", A, None, at(28), "n", "c", None),
    ]
    ann = spark.createDataFrame(rows, ANNOTATIONS)
    errors = {r.id: r.error for r in views.validate_annotations(ann).collect()}
    assert [k for k, v in errors.items() if v is None] == ["1", "2", "6"]
    dangling = {r.id: r.dangling for r in views.resolve_annotations(ann, files).collect()}
    assert dangling == {"1": False, "2": False, "3": False, "4": False, "5": False, "6": True, "7": False}
    hist = aggregates.histogram(entries, "minute")
    pins = ann.where("id IN ('1', '2')").unionByName(ann.where("id = '2'").withColumn("id", F.lit("9")).withColumn("ts", F.lit(at(1)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")))
    assert [tuple(r)[:2] for r in views.annotation_markers(pins, hist, "minute").collect()] == [("2", "2018-05-16T14:26")]


def test_saved_filters_and_preset(entries, files):
    saved = [("search", json.dumps({"q": "security"})), ("search", json.dumps({"q": "done"})),
             ("timeline", json.dumps({"from": "", "to": "2018-05-16T14:26:30Z"}))]
    assert ids(views.apply_filters(entries, saved)) == []
    assert ids(views.apply_filters(entries, saved[:2], "or").orderBy("file_id")) == [(A, 1), (B, 1)]
    assert ids(views.apply_filters(entries, [])) != []
    snap = {"searchFilters": [], "timeline": {"from": "2018-05-16T14:26:26Z", "to": ""}, "highlights": [{"text": "done", "color": "#1", "lexeme": 0}],
            "selectedFileIds": [A, B], "correlateMode": True, "pageSize": 25}
    rows = views.apply_preset(entries, files, "u", json.dumps(snap)).collect()
    assert [(r.file_id, r.seq, r.color) for r in rows] == [(B, 1, "#1"), (A, 2, None)]
    snap["correlateMode"] = False
    assert ids(views.apply_preset(entries, files, "u", snap)) == [(A, 2), (B, 1)]


def test_validate_rules(spark):
    df = spark.createDataFrame([("search", "{}"), ("", "{}"), ("x", None)], "kind string, rule string")
    assert [r.error is None for r in views.validate_rules(df, "filters").collect()] == [True, False, False]
