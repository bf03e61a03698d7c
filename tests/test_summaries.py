import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglake.operators.summaries import (
    base_summary,
    level_counts,
    register_summarizer,
    session_stats,
    sessions,
    summarize,
    summarizer_names,
    unregister_summarizer,
)
from loglake.schema import ENTRIES

START = datetime(2018, 5, 16, 10)


def entry(file_id, seq, ts, level, message, raw="", fmt="weblogic"):
    return ("u", file_id, seq, fmt, ts, "", "", False, level, None, message, raw, {})


@pytest.fixture(scope="module")
def three(spark):
    rows = [
        entry("f", 1, START, "info", "Server state changed to STARTING"),
        entry("f", 2, START + timedelta(minutes=5), "warning", "x"),
        entry("f", 3, START + timedelta(hours=1, milliseconds=900), "error", None, "SERVER STATE CHANGED TO SHUTDOWN"),
        entry("g", 1, None, None, "Server state changed to STARTING", fmt="text"),
    ]
    return spark.createDataFrame(rows, ENTRIES)


def test_base_summary(three):
    rows = {r.file_id: r for r in base_summary(three).collect()}
    f, g = rows["f"], rows["g"]
    assert (f.total_records, f.first_ts, f.duration_sec) == (3, START, 3600)
    assert f.level_counts == {"info": 1, "warning": 1, "error": 1}
    assert (g.total_records, g.first_ts, g.duration_sec, g.level_counts) == (1, None, 0, {"unknown": 1})
    assert {(r.file_id, r.level): r["count"] for r in level_counts(three).collect()}[("g", "unknown")] == 1


def test_durations_know_no_clock_change(spark):
    """The session zone puts its clock forward between these times, which are in UTC."""
    early, late = datetime(2018, 3, 10, 20, 0, 0, 500000), datetime(2018, 3, 12, 3)
    rows = [entry("f", 1, early, None, "Server state changed to STARTING"), entry("f", 2, late, None, "Server state changed to FAILED")]
    entries = spark.createDataFrame(rows, ENTRIES)
    assert base_summary(entries).first().duration_sec == sessions(entries).first().duration_sec == 31 * 3600 - 1


def test_one_session(three):
    found = sessions(three).collect()
    assert [(r.file_id, r.duration_sec, r.note) for r in found] == [("f", 3600, "start-stop")]
    assert session_stats(sessions(three)).first().asDict() == {"file_id": "f", "session_count": 1, "total_sec": 3600, "longest_sec": 3600}


def by_rule(rows):
    """The rule, one record at a time."""
    out, opened = [], None
    for ts, text in rows:
        if opened is None:
            if "start" in text and ts is not None:
                opened = ts
        elif "stop" in text:
            if ts is not None:
                out.append((opened, ts))
            opened = None
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 20])
def test_sessions_against_the_rule(spark, chunk):
    rng = random.Random(11)
    rows, want = [], {}
    for n in range(150):
        texts = [(None if rng.random() < 0.25 else START + timedelta(seconds=60 * i),
                  rng.choice(["start", "stop", "start stop", "x", "stop", "start"])) for i in range(rng.randrange(1, 30))]
        want[f"f{n}"] = by_rule(texts)
        rows += [entry(f"f{n}", i, ts, None, text, fmt="own") for i, (ts, text) in enumerate(texts, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ENTRIES).repartition(7)
    got = {}
    for r in sessions(df, {"own": (["START"], ["Stop"])}, chunk=chunk).collect():
        got.setdefault(r.file_id, []).append((r.start_ts, r.stop_ts))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_full_summary_and_extras(spark, three):
    files = spark.createDataFrame(
        [("f", "u", "UTF-8", 77), ("g", "u", "UTF-8", None), ("empty", "u", "UTF-8", 0)], "id string, upload_id string, encoding string, size_bytes long")
    uploads = spark.createDataFrame([("u", 999, START)], "id string, size_bytes long, uploaded_at timestamp_ntz")
    register_summarizer("text", lambda e: e.groupBy("file_id").agg(F.create_map(F.lit("n"), F.count("*").cast("string")).alias("extras")))
    try:
        assert "text" in summarizer_names() and "base" in summarizer_names()
        rows = {r.file_id: r.summary for r in summarize(three, files, uploads, nest_sessions=True).collect()}
    finally:
        unregister_summarizer("text")
    assert rows["f"].file_size == 77 and rows["g"].file_size == 999
    assert len(rows["f"].sessions) == 1 and rows["f"].sessions[0].duration_sec == 3600
    assert rows["g"].sessions == [] and rows["g"].extras == {"n": "1"} and rows["f"].extras is None
    assert (rows["f"].session_count, rows["f"].session_sec, rows["g"].session_count) == (1, 3600, 0)
    flat = {r.file_id: r.summary for r in summarize(three, files, uploads).collect()}
    assert flat["f"].sessions is None and flat["f"].session_sec == 3600
    assert rows["empty"].total_records == 0 and rows["empty"].level_counts == {}
