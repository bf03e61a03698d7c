"""Patterns in RE2's dialect against an engine that speaks it: DuckDB's."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loglake.functions.text import java_pattern, regexp_match

ALPHABET = ["a", "b", "B", "k", "_", "0", "7", " ", "\t", "\n", "\r", "\x0b", "-", ".", "é", "ш", "Ш", "\u212a", "\u2028", "\U0001f600"]


def generated(rng, depth=0):
    """A pattern of the dialect, mostly a good one."""
    def atom():
        kind = rng.randrange(12)
        if kind < 4:
            return rng.choice(["a", "b", "k", "0", "é", "ш", "_", " ", r"\.", r"\-", "-"])
        if kind == 4:
            return rng.choice([r"\d", r"\D", r"\w", r"\W", r"\s", r"\S", ".", r"\v", r"\t", r"\n"])
        if kind == 5:
            return rng.choice([r"\x{1F600}", r"\x{2028}", r"\x41", r"\x61", r"\101", r"\07", r"\141", r"\x{e9}", r"\pL", r"\p{Cyrillic}", r"\PN"])
        if kind == 6:
            return rng.choice([r"\b", r"\B", "^", "$", r"\A", r"\z"])
        if kind in (7, 8):
            items = "".join(rng.choice(["a", "b-k", "0-9", r"\d", r"\S", r"\s", r"\W", "[:alpha:]", "[:^space:]", "[:space:]", "é", "&&", "[", r"\]", r"\x{2028}", "ш", "_", "."]) for _ in range(rng.randint(1, 3)))
            return "[" + rng.choice(["", "^"]) + items + "]"
        if depth < 2:
            return rng.choice(["(", "(?:", "(?i:", "(?P<n_1>" if depth == 0 else "(?:", "(?s:", "(?m:"]) + generated(rng, depth + 1) + ")"
        return "a"

    def piece():
        found = atom()
        zero_width = found in (r"\b", r"\B", "^", "$", r"\A", r"\z")
        return found + (rng.choice(["", "", "", "*", "+", "?", "*?", "{2}", "{1,2}", "{0,}"]) if not zero_width else "")

    flags = rng.choice(["", "", "(?i)", "(?m)", "(?s)"]) if depth == 0 else ""
    return flags + "|".join("".join(piece() for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 1, 2])))


def test_patterns_mean_what_they_mean_in_re2(spark):
    rng = random.Random(20)
    patterns = list(dict.fromkeys(generated(rng) for _ in range(320)))
    texts = [""] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want, rows = {}, []
    for k, p in enumerate(patterns):
        try:
            want[k] = {i for i, hit in con.execute("SELECT i, regexp_matches(s, ?) FROM t", [p]).fetchall() if hit}
        except duckdb.Error:  # refused, as it must be here or by Java
            continue
        rows.append((k, java_pattern(p)))
    assert len(rows) > 200
    df = spark.createDataFrame(rows, "k int, p string").crossJoin(spark.createDataFrame(list(enumerate(texts)), "i int, s string"))
    got = {k: set() for k in want}
    for r in df.where(F.rlike("s", F.col("p"))).select("k", "i").collect():
        got[r.k].add(r.i)
    assert [(patterns[k], [texts[i] for i in got[k] ^ want[k]]) for k in want if got[k] != want[k]] == []


@pytest.mark.parametrize("pattern,text,hit", [
    (r"\x{1F600}", "a\U0001f600", True), (r"\x{2028}+", "\u2028", True), (r"\123", "S", True), (r"\bошибка", "ошибка", False), (r"\bfail", "a fail", True),
    (r"^\S$", "\x0b", True), (r"^\S$", "\u00a0", True), (r"[\S]", " \t", False), (r"[^\S]", "a b", True), (r"[\x{41}-\x43]", "B", True), (r"a\B", "ab", True),
    (r"\Bé", "aé", False), ("x{,3}", "x{,3}", True),
])
def test_single_patterns(spark, pattern, text, hit):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(regexp_match(F.col("s"), pattern).alias("m")).first().m is hit


@pytest.mark.parametrize("pattern", [r"\1", r"\8", r"a{2}{3}", "a**", r"[\b]", r"\x{110000}", r"\Z", r"(?=a)", "a++", "a{1001}"])
def test_refused_patterns(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)
