"""Operator 6, secret scans: a random forest over candidates, in DataFrame functions only.

A candidate is a run of characters such as keys are made of, wherever it stands in a word:
minified JSON, lists and query strings give each of their values. It has a digit and at least
``SHORTEST`` characters, or the format of a known key, or a secret's name right before it.
Its measures: length, shares of the character classes, transitions from one class to
another, share of letters covered by the corpus's dictionary words, path signs in it and in
the document's source, and whether the name right before it or the words around it name a
secret or something harmless. Spark's random forest, trained on labelled findings, tells
secrets from ids, hashes, addresses and numbers.

Labelled findings come from :func:`labelled`: key formats and values assigned to a secret's
name are secrets, addresses, numbers, dates and versions are not, the rest has no label and
is left to the forest. At most ``ROWS`` of them (smallest hashes) are used. A table of
findings labelled by hand can be given instead.

Only texts that have a candidate at all are taken apart into words. Nothing but the
dictionary's word counts is shuffled, pre-aggregated. What leaves the operator is a
digest of the candidate, never the secret itself.

Edge cases: null and empty texts have no candidate; a very long text is one row of words,
taken apart by one task; of equal candidates each has its own row, told apart by place and
part; if labels are missing or of one kind
only, the candidates labelled secret are reported and no other; repeated rows give repeated
findings; rows without doc_id are scanned and redacted like others; an empty table gives no row; in :func:`redact` further columns stay.
"""

from __future__ import annotations


from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import saved

ROWS, TREES, DEPTH, DICTIONARY, SHORTEST = 20_000, 24, 6, 3_000, 10
BLANKS = r"[\x20\x09-\x0D]+"

# What key-like runs look like, names of secrets, formats of keys, harmless names and formats.
_KEY = r"[A-Za-z0-9+/_.@-]"
_NAMES = r"passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
RUN = rf"(?:([A-Za-z_][A-Za-z0-9_-]*)[\"']?[=:][\"']?)?({_KEY}{{8,}}+(?:={{1,2}}(?!{_KEY}|=))?)"
CANDIDATE = rf"(?=[A-Za-z+/_.@-]*+[0-9]){_KEY}{{10,}}|AKIA[0-9A-Z]{{16}}|(?i:{_NAMES})[\"']?[=:][\"']?{_KEY}{{8,}}"
#: A word after which any run is a candidate.
ASSIGNING = rf"(?i:{_NAMES})[\"']?[=:]"
KEY_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]+)$"
SECRET_NAMES = rf"(?i)({_NAMES})"
HARMLESS_NAMES = r"(?i)(version|commit|sha1|sha256|md5|checksum|digest|uuid|isbn|mail|phone|http|example|dummy|test)"
HARMLESS = r"^([^@]+@[^@]+|\+?[0-9() .:/-]+|[a-z]+://.*|v?[0-9]+(\.[0-9]+)+.*|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"

_CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "sign": r"+/_.@=-"}


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of at least four letters in all texts of ``docs`` (text)."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter(F.length("word").between(4, 12))
    rows = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    return [r["word"] for r in rows]


def candidates(docs: DataFrame) -> DataFrame:
    """The candidates of ``docs`` (doc_id, text, source).

    doc_id, text_key (the hash of the text), source, place (of the word, from 0), part (of the
    word's runs, from 0), word, value, named (the name right before the value), before (two
    words and the name) and after (two words).
    """
    own = [F.xxhash64("text").alias("text_key"), "source"]
    assigned = ASSIGNING + BLANKS + rf"[\"']?{_KEY}{{8,}}"
    with_any = docs.filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(assigned)).select("doc_id", *own, F.array_remove(F.split("text", BLANKS), "").alias("words"))
    word = lambda w, i: F.when(
        w.rlike(CANDIDATE) | (F.get("words", i - 1).rlike(ASSIGNING + "$") & w.rlike(_KEY + "{8,}")),
        F.struct(
            i.alias("place"), w.alias("word"), F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1)).alias("around"),
            F.concat_ws(" ", F.get("words", i + 1), F.get("words", i + 2)).alias("after"),
        ),
    )
    kept = ["doc_id", "text_key", "source"]
    found = with_any.select(*kept, F.explode(F.filter(F.transform("words", word), lambda x: x.isNotNull())).alias("c")).select(*kept, "c.*")
    runs = F.arrays_zip(*[F.regexp_extract_all("word", F.lit(RUN), F.lit(i)).alias(n) for i, n in ((1, "named"), (2, "value"))])
    each = found.select(*found.columns, F.posexplode(runs).alias("part", "x")).select(
        *kept, "place", "part", "word", F.col("x.value").alias("value"), F.col("x.named").alias("named"),
        F.concat_ws(" ", "around", F.nullif("x.named", F.lit(""))).alias("before"), "after", "around",
    )
    long = (F.length("value") >= SHORTEST) & F.col("value").rlike("[0-9]")
    given = F.col("named").rlike(f"(?i:{_NAMES})$") | ((F.col("named") == "") & F.col("around").rlike(ASSIGNING + "$"))
    return each.filter(long | F.col("value").rlike(KEY_FORMATS) | given).drop("around")


def trie_pattern(words: list[str]) -> str:
    """A pattern of all the words, longest first, in which words of one beginning share it."""
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def write(node: dict) -> str:
        branches = [char + write(node[char]) for char in sorted(node, reverse=True) if char]
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)})" + ("?" if "" in node else "")

    return write(tree)


def labelled(found: DataFrame) -> DataFrame:
    """``found`` with label 1.0 (secret), 0.0 or null."""
    mixed = F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(HARMLESS)
    digit = F.col("value").rlike("[0-9]")
    label = (
        F.when(F.col("value").rlike(KEY_FORMATS), 1.0).when(F.col("before").rlike(SECRET_NAMES) & mixed & digit & (F.length("value") >= 12), 1.0)
        .when(F.col("value").rlike(HARMLESS) | F.col("before").rlike(HARMLESS_NAMES), 0.0)
    )
    return found.withColumn("label", label)


def _share(pattern: str, of: str = "value") -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))


def measured(found: DataFrame, words: list[str]) -> tuple[DataFrame, list[str]]:
    """``found`` with the forest's measures, and their names."""
    measures = {"m_length": F.length("value").cast("double")}
    for name, chars in _CLASSES.items():
        measures[f"m_{name}"] = _share(f"[{chars}]")
        for other, others in _CLASSES.items():
            measures[f"m_{name}_{other}"] = _share(f"[{chars}](?=[{others}])")
    measures["m_hex"] = F.col("value").rlike("^[0-9a-f]+$").cast("double")
    covered = F.regexp_replace(F.lower("value"), trie_pattern(words), "") if words else F.lower("value")
    measures["m_dictionary"] = 1 - F.length(F.regexp_replace(covered, r"[^\p{L}]", "")) / F.greatest(F.lit(1), F.length(F.regexp_replace("value", r"[^\p{L}]", "")))
    measures["m_path"] = F.regexp_count("word", F.lit("[/\\\\]")).cast("double")
    measures["m_source"] = F.coalesce(F.col("source"), F.lit("")).rlike("(?i)(test|example|mock|sample)").cast("double")
    measures["m_secret_name"] = F.col("before").rlike(SECRET_NAMES).cast("double")
    measures["m_harmless_name"] = F.col("before").rlike(HARMLESS_NAMES).cast("double")
    measures["m_secret_after"] = F.col("after").rlike(SECRET_NAMES).cast("double")
    measures["m_harmless_after"] = F.col("after").rlike(HARMLESS_NAMES).cast("double")
    measures["m_assigned"] = ((F.col("named") != "") | F.col("before").rlike("[=:]")).cast("double")
    measures["m_key_format"] = F.col("value").rlike(KEY_FORMATS).cast("double")
    measures["m_quoted"] = F.col("word").rlike("[\"']").cast("double")
    return found.withColumns(measures), list(measures)


def learn(found: DataFrame, names: list[str], rows: int = ROWS) -> RandomForestClassificationModel | None:
    """A forest of the labelled rows of ``found``, or None if there aren't both kinds."""
    sample = saved(
        found.filter("label is not null").orderBy(F.xxhash64("doc_id", "place", "part"), "doc_id", "place", "part", "value").limit(rows).select("label", *names), "secrets-rows",
    ).coalesce(1)
    if sample.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=names, outputCol="measures").transform(sample)
    return RandomForestClassifier(featuresCol="measures", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(ready)


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, place, part, word, value, probability and is_secret of every candidate of ``docs`` (doc_id, text, source).

    ``findings`` (doc_id, place, label) are labels given by hand; without them :func:`labelled` makes them.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(["source"] if "source" in docs.columns else [F.lit("").alias("source")]))
    found = saved(candidates(docs), "secrets-candidates")
    found = labelled(found) if findings is None else found.join(findings.select("doc_id", "place", "label"), ["doc_id", "place"], "left")
    found, names = measured(found, dictionary(docs))
    found = saved(found, "secrets-measures")
    forest = learn(found, names)
    if forest is None:
        probability = F.coalesce(F.col("label"), F.lit(0.0))
        judged = found.withColumn("probability", probability)
    else:
        ready = VectorAssembler(inputCols=names, outputCol="measures").transform(found)
        judged = forest.transform(ready).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return judged.select("doc_id", "text_key", "place", "part", "word", "value", "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def report(docs: DataFrame) -> DataFrame:
    """The candidates of ``docs`` without their values."""
    return scan(docs).select(
        "doc_id", "place", "part", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret",
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced, all other columns as they are."""
    secrets = scan(docs).filter("is_secret").groupBy("doc_id", "text_key").agg(F.collect_set("value").alias("_secrets"))
    # longer ones first: one may be part of another
    ordered = F.array_sort("_secrets", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    secrets = secrets.select(F.col("doc_id").alias("_secret_id"), F.col("text_key").alias("_secret_key"), ordered.alias("_secrets"))
    cut = F.aggregate("_secrets", F.col("text"), lambda text, value: F.replace(text, value, F.lit(mark)))
    same = F.col("doc_id").eqNullSafe(F.col("_secret_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_secret_key"))
    joined = docs.join(secrets, same, "left")
    return joined.withColumn("text", F.when(F.col("_secrets").isNotNull(), cut).otherwise(F.col("text"))).select(*docs.columns)
