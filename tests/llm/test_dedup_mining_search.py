"""Line dedup, hard negatives and ranked search against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglake.llm import hard_negatives, jaccard, line_dedup, ranked_search
from loglake.llm.best import NO_ID, Best
from loglake.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# --- 11 line dedup ------------------------------------------------------------------------


def key_of(line):
    return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})


def dedup_by_hand(rows, chars, least):
    """rows of (doc_id, text); documents without an id are told apart by their texts and rank lowest."""
    name = lambda d, t: (d is not None, d if d is not None else t or "")
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= chars:
                holders.setdefault(key_of(line), set()).add(name(d, text))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < least or max(holders[key_of(x)]) == name(d, text)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(3)
    shared = [f"shared line number {i} " + "é" * rng.randint(20, 40) for i in range(30)]
    hot = "this one line stands in every third document of all of them"
    rows = []
    for i in range(400):
        lines = [rng.choice(shared) for _ in range(rng.randint(0, 6))] + [f"own {i} {j} " + "x" * rng.choice([5, 60]) for j in range(3)]
        lines += [hot if rng.random() < 0.5 else f"\t {hot.upper()} \r"] * (2 if i % 3 == 0 else 0)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    short = "é" * 39
    rows += [(1000 + i, short) for i in range(6)] + [(2000 + i, short + "y") for i in range(6)]
    rows += [(3000, None), (3001, ""), (3002, "\n\n"), (3003, " \n" + hot * 3000)]
    rows += [rows[0], rows[3], (3, "other text\n" + hot), (9, hot), (5000, f"{hot}\n{hot}"), (3004, "日本語" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(1)).withColumn("pos", F.lit("x")).repartition(5)
    got = sorted(map(tuple, line_dedup.line_report(df).collect()), key=repr)
    assert got == dedup_by_hand(rows, 40, 5) and sum(r[2] for r in got) > 200
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert texts[5000] == f"{hot}\n{hot}" and texts[2000] == "" and texts[2005] == short + "y" and texts[9] == ""


def test_line_dedup_of_rows_without_doc_id(spark):
    line = "a line that is long enough to be looked at, as it has many letters"
    rows = [(None, line + f"\n{i}") for i in range(7)] + [(None, line + "\n0"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.n_lines, r.n_dropped) for r in line_dedup.line_report(df).collect())
    assert sorted(got.items()) == sorted({(2, 1): 7, (2, 0): 1, (1, 0): 1}.items()) or got == Counter({(2, 1): 6, (2, 0): 2, (1, 0): 1})
    with_id = df.unionByName(spark.createDataFrame([(-5, line)], "doc_id long, text string"))
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_report(with_id).collect()}[-5] == 0
    assert line_dedup.line_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_runs_over_any_ranges_and_batches(seed):
    """The stream over sorted ranges, wherever ranges and batches are cut, finds what a look at all rows finds."""
    rng, least = random.Random(seed), 3
    rows = sorted({(h, d, p) for h in range(12) for d in range(rng.choice([1, 2, 3, 40])) for p in range(rng.choice([1, 1, 3]))}, key=lambda r: (r[0], -r[1], r[2]))
    docs = {}
    for h, d, _ in rows:
        docs.setdefault(h, set()).add(d)
    want = {(h, d, p) for h, d, p in rows if len(docs[h]) >= least and d != max(docs[h])}
    # a range never cuts the rows of one (hash, document)
    borders = [i for i in range(1, len(rows)) if rows[i][:2] != rows[i - 1][:2]]
    cuts = [0, *sorted(rng.sample(borders, min(len(borders), rng.choice([0, 2, 9, 30])))), len(rows)]
    names = ["h1", "h2", "known", "doc", "text_key", "pos", "n_lines"]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        frame = pd.DataFrame([(h, h, True, d, d, p, 9) for h, d, p in rows[a:b]], columns=names)
        size = rng.choice([1, 2, 7, 1000])
        out += list(line_dedup._stream(least, iter([frame[i:i + size].reset_index(drop=True) for i in range(0, len(frame), size)])))
    found = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[*names, "docs", "decided"])
    open_rows = found[~found["decided"].astype(bool)]
    border = {h: (x["docs"].sum(), x["doc"].max()) for h, x in open_rows.groupby("h1")}
    got = [tuple(x) for x in found[found["decided"].astype(bool)][["h1", "doc", "pos"]].to_numpy()]
    got += [(r.h1, r.doc, r.pos) for r in open_rows.itertuples() if not pd.isna(r.pos) and border[r.h1][0] >= least and r.doc < border[r.h1][1]]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(border) <= 2 * (len(cuts) - 1)


def test_bitmaps_keep_what_they_say():
    gone = np.array([0, 5, 999])
    lines = [str(i) for i in range(1000)]
    assert line_dedup.kept_lines("\n".join(lines), line_dedup._bitmap(1000, gone)) == [x for i, x in enumerate(lines) if i not in (0, 5, 999)]
    assert line_dedup.kept_lines("", None) == [""] and line_dedup.kept_lines("", line_dedup._bitmap(1, np.array([0]))) == []


# --- 12 hard negatives --------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (33, 64, 129), (100, 17, 18), (0, 5, 3), (4, 0, 6), (70, 130, 90)])
def test_strassen_is_the_product(shape):
    rng = np.random.default_rng(7)
    for top in (100, 1 << 30):
        a, b = rng.integers(-top, top, shape[:2]), rng.integers(-top, top, shape[1:])
        got = hard_negatives.strassen(a, b, leaf=4)
        assert got.dtype == np.int64 and (got == a @ b).all()


def mined_by_hand(rows, every, low=50, high=95):
    part = {}
    for i, v, label in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        part.setdefault(i, ([math.floor(256 * x) for x in v], label))
    out = []
    for a, (va, la) in part.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (v, _) in part.items() if i != a}  # noqa: B905
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if part[i][1] == la][:5]:
            fits = [i for i in order if part[i][1] != la and low * score[p] <= 100 * score[i] <= high * score[p]][:3]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_by_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([5, 6, 6, 6]))], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(300)]
    rows += [(300 + i, rows[5][1], i % 4) for i in range(30)]  # equal vectors: ties
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")], 1), (403, [float("inf")], 1), (404, [1.0], None), (None, [1.0], 1),
             (405, [], 1), (-10, [0.5, 0.5], 0), (7, [9.0, 9.0, 9.0], 0), (20, rows[20][1], rows[20][2]), (20, rows[20][1], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x")).repartition(6)
    vectors = hard_negatives.integer_vectors(df)
    want = mined_by_hand(rows, 10)
    assert sorted(map(tuple, hard_negatives.mine(vectors, 10).collect())) == want and len(want) > 100
    assert sorted(map(tuple, hard_negatives.mine(vectors, 10, wave=500).collect())) == want  # many waves
    assert hard_negatives.mine(vectors.limit(0)).count() == 0
    assert hard_negatives.mine(vectors.filter("vec_id % 10 <> 0"), 10).count() == 0
    changed = {r.vec_id: r.label for r in hard_negatives.relabelled(vectors).collect()}
    assert changed[7] == 1 and changed[6] == rows[6][2]


def test_best_keeps_the_best_in_any_order():
    rng = random.Random(4)
    for _ in range(20):
        entries = [(rng.randrange(5), rng.randrange(-4, 4), i) for i in range(200)]
        best = Best(6, 3)
        for at in range(0, 200, 37):
            best.add(*(np.array(x, np.int64) for x in zip(*entries[at:at + 37], strict=True)))
        rows = best.rows().to_pylist()
        for g in range(5):
            want = sorted((e for e in entries if e[0] == g), key=lambda e: (-e[1], e[2]))[:3]
            assert rows[g] == {"group_no": g, "ids": [e[2] for e in want], "scores": [e[1] for e in want]}
    best = Best(1, 2)
    assert best.rows().num_rows == 0
    best.add(np.array([0, 0]), np.array([5, 5]), np.array([NO_ID, 3]))
    assert best.rows().to_pylist() == [{"group_no": 0, "ids": [3, None], "scores": [5, 5]}]


# --- 13 ranked search ---------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_by_hand(docs, items, top):
    words = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    texts = [(d, Counter(words(t))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n_docs, n_all = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    by_id, out = {}, []
    for i, t in items:
        by_id.setdefault(i, set()).update(words(t))
    for i, terms in by_id.items():
        scores = []
        for d, c in texts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def test_ranked_search_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["The", "of", "a", "é", "naïve", "日本", "x1", "42", "ÉCOLE", "école", *(f"w{i}" for i in range(60))]
    signs = [" ", ", ", "\n", "-", "_", "@", "[", "\x7f", "\x00", "'"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(signs) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " -- \n"), (503, text(20_000)), (None, text(30)), (None, text(30)), (504, docs[0][1]), docs[0], docs[1], (505, "a" * 30_000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(30, None), (31, "--"), (32, "unknown"), (3, text(4)), (None, text(5)), (33, "a a A")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("s")).repartition(7)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(2))
    want = search_by_hand(docs, items, 10)
    assert sorted(map(tuple, ranked_search.search(d, i, 10).collect()), key=repr) == want
    assert sorted(map(tuple, ranked_search.search(d, i, 10, wave=30).collect()), key=repr) == want  # many waves
    assert ranked_search.search(d.limit(0), i).count() == 0 and ranked_search.search(d, i.limit(0)).count() == 0


def test_term_frequencies_overlap_at_their_borders():
    items = ranked_search.Items.of({1: {"a", "aa", "b"}})
    count = lambda t: {items.terms[k]: n for k, n in ranked_search.frequencies(items.automaton(), t.encode()).items()}
    assert count("a a A aa b-a") == {"a": 4, "aa": 1, "b": 1} and count("ab ba éa aé") == {} and count("") == {}
    assert [ranked_search.count_terms(t.encode()) for t in ("", " ", "a", " a", "a ", "a b", "é-ü x")] == [0, 0, 1, 1, 1, 2, 3]


def test_jaccard_compares_joined_sets_no_more(spark, monkeypatch):
    """Of a member's pivots the nearest is compared; others only if that left them in another component."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):  # near copies of one text, each with two words of its own
        own = list(words)
        own[(7 * i) % 400], own[(11 * i + 3) % 400] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(own)))
    compared, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: compared.append([tuple(r) for r in pairs.collect()]) or verified(pairs, *rest))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(40), 0)
    assert len(compared) > 1 and len(compared[0]) == len({a for a, _ in compared[0]})
    assert not set(compared[0]) & set(compared[1]) and sum(map(len, compared[:2])) < 80


def test_pipeline_packs_with_few_words_kept(spark, monkeypatch):
    """A worker that holds what earlier stages left keeps fewer words."""
    import corpus_pipeline

    kept = []
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, path, **options: kept.append(options) or docs)
    corpus_pipeline.packing(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert 0 < kept[0]["memo"] <= 100_000
