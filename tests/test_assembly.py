"""Both ways of assembling records against a line-by-line rule written out in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loglake.operators.assembly import (
    HEAD_CHARS,
    assemble_lines,
    clean_text,
    detect_lines,
    detect_text,
    number_lines,
    sample_lines,
    split_records,
)
from loglake.operators.formats import format_by_name, formats

HEADS = {
    "oracle": "2019-05-31T14:52:53.818309-04:00",
    "weblogic": "####<May 16, 2018> <Info> <Sub>",
    "wls_stdout": "<May 16, 2018 6:28:57 PM> <INFO> <x> <y>",
    "java": "2012-03-28 16:15:40,637 INFO  [t] a.b - c",
    "odl": "[2018-05-16T18:26:25.123+04:00] [c] [ERROR] [] [m] [tid: t] [userId: u] [ecid: e] text",
    "access": '1.2.3.4 - - [16/May/2018:18:08:04 +0400] "GET / HTTP/1.1" 200 1',
}
CONTINUED = re.compile(r"^\s+at |^Caused by:|^\t|^\s+\.\.\. ")


def lines_of(text):
    return [line.rstrip("\r") for line in (text[:-1] if text.endswith("\n") else text).split("\n")] if text else []


def expected(text, fmt):
    """The rule, one line at a time."""
    records, open_record = [], None
    for line in lines_of(text):
        if fmt == "access":
            records.append(line)
            continue
        if fmt != "text" and line.strip() == HEADS[fmt]:
            open_record = [line.strip()]
            records.append(open_record)
            continue
        goes_on = open_record is not None and (fmt != "java" or CONTINUED.search(line) or not line.strip())
        if fmt != "text" and goes_on:
            open_record.append(line)
            continue
        if fmt == "java":
            open_record = None
        if line.strip():
            records.append(line)
    return ["\n".join(r) if isinstance(r, list) else r for r in records]


def random_text(rng, fmt):
    pool = ["", " ", "plain", "more text \r", "\tat a.b", "Caused by: z", "   at x", " ... 3 more", "  ", "\r", "last\r\r"]
    if fmt in HEADS:
        pool += [HEADS[fmt], HEADS[fmt], "  " + HEADS[fmt] + " \r", HEADS[fmt] + "\r"]
    lines = [rng.choice(pool) for _ in range(rng.randrange(0, 40))]
    return "\n".join(lines) + rng.choice(["", "\n"])


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    return [(f"{spec.name}{i}", spec.name, random_text(rng, spec.name)) for spec in formats() for i in range(60)]


def collected(df):
    out = {}
    for r in sorted(df.select("file_id", "seq", "raw_line").collect(), key=lambda r: (r.file_id, r.seq)):
        out.setdefault(r.file_id, []).append((r.seq, r.raw_line))
    return out


def numbered(cases):
    return {name: list(enumerate(expected(text, fmt), 1)) for name, fmt, text in cases if expected(text, fmt)}


def test_whole_texts(spark, cases):
    df = spark.createDataFrame(cases, "file_id string, format string, text string")
    records = split_records(df.withColumn("text", clean_text(F.col("text"))))
    assert collected(records) == numbered(cases)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_lines_in_blocks(spark, cases, block):
    rows = [(name, i // block, i, line) for name, _, text in cases for i, line in enumerate(lines_of(text))]
    random.Random(block).shuffle(rows)
    lines = spark.createDataFrame(rows, "file_id string, block long, pos long, value string").repartition(5)
    known = spark.createDataFrame([c[:2] for c in cases], "file_id string, format string")
    assert collected(assemble_lines(lines, known)) == numbered(cases)


def test_detection_agrees(spark):
    rng = random.Random(3)
    texts = []
    for i in range(60):
        blanks = "\n" * rng.randrange(0, 3)
        lead = "".join(f"{blanks}lead {n}\n" for n in range(rng.choice([0, 5, 19, 20, 25])))
        texts.append((str(i), lead + rng.choice(list(HEADS.values())) + "\ntail"))
    df = spark.createDataFrame(texts, "file_id string, text string").withColumn("text", clean_text(F.col("text")))
    whole = {r.file_id: r.format for r in detect_text(df).collect()}
    lines = df.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "value")).withColumn("block", F.expr("pos div 4"))
    assert {r.file_id: r.format for r in detect_lines(lines).collect()} == whole
    for name, text in texts:
        sample = [line for line in text.split("\n") if line.strip()][:20]
        want = next((fmt for fmt in ("oracle", "weblogic", "wls_stdout", "java", "access", "odl")
                     if any(line == HEADS[fmt] for line in sample)), "text")
        assert whole[name] == want


def test_detection_order(spark):
    both = HEADS["odl"] + "\n" + HEADS["weblogic"]
    df = spark.createDataFrame([("a", both), ("b", "free text"), ("c", "")], "file_id string, text string")
    assert [r.format for r in detect_text(df).orderBy("file_id").collect()] == ["weblogic", "text", "text"]


def test_sample_looks_behind_the_beginning(spark):
    long_blank = " " * 100 + "\n"
    text = long_blank * (HEAD_CHARS // 50) + "\n".join(f"l{i}" for i in range(30))
    cut = "x" * (HEAD_CHARS - 3) + "\nabcdef\nrest"
    df = spark.createDataFrame([("a", text), ("b", cut), ("c", "one\ntwo")], "file_id string, text string")
    rows = {r.file_id: r.s for r in df.select("file_id", sample_lines(F.col("text")).alias("s")).collect()}
    assert rows["a"] == [f"l{i}" for i in range(20)]
    assert rows["b"] == ["x" * (HEAD_CHARS - 3), "abcdef", "rest"]
    assert rows["c"] == ["one", "two"]


def test_number_lines(spark):
    rows = [("a", i // 4, i, f"v{i}") for i in range(30)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "file_id string, block long, pos long, value string")
    assert sorted((r.line_no, r.value) for r in number_lines(df).collect()) == [(i + 1, f"v{i}") for i in range(30)]


def test_format_registry(spark):
    assert [s.name for s in formats()][-1] == "text"
    assert format_by_name("java").continuation is not None
