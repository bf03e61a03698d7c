"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, folder of the tables) and works on all rows its predecessor
kept. All but the last return the columns of ``docs``. Rows without a doc_id pass the
near-duplicate stage, where they can't be told from each other; a null text passes every
filter and is packed as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm import decontamination as bench
from loglake.llm import jaccard, secrets, toxicity
from loglake.llm.common import ready, saved
from loglake.llm.packing import pack


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents whose toxicity score is under the threshold."""
    ready(spark)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return docs.filter(toxicity.toxicity(lexicon)(F.col("text")) < toxicity.THRESHOLD)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and all rows without an id."""
    ready(spark)
    others = jaccard.join(docs).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    ready(spark)
    return bench.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    ready(spark)
    redacted = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


#: Words, and parts of words, whose token ids a worker keeps while it packs.
MEMO = 100_000


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    ready(spark)
    # the worker holds what earlier stages left in it, too: fewer words are kept than for packing alone
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", packing),
]

#: Stages learn, hash and tokenize, which SQL can't express: tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
