"""The registered queries of this subpackage, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loglake.llm import (
    decontamination, hard_negatives, jaccard, language, line_dedup, pii, quality, ranked_search, secrets, sharding, tokens, toxicity,
)
from loglake.llm.common import documents, ready
from loglake.llm.packing import pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return toxicity.score_documents(docs, toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder, "doc_id", "text"))


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(documents(spark, folder, "doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "lang")
    return language.predict_documents(docs, language.learn(docs))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_documents(documents(spark, folder, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(documents(spark, folder, "doc_id", "text", "source"))


@query
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return jaccard.join(documents(spark, folder, "doc_id", "text"))


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(documents(spark, folder, "doc_id", "text"))


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return pii.find(docs, pii.learn(docs))


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, folder, "doc_id", "text"))


SQL["op11_line_dedup"] = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
lines AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {line_dedup.CHARS} GROUP BY k
           HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST}),
marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, "vec_id", "embedding", "label", table="embeddings")
    return hard_negatives.mine(hard_negatives.relabelled(hard_negatives.integer_vectors(rows)))


SQL["op12_hard_negatives"] = f"""
WITH part AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
              FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
                 list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM part a JOIN part c ON a.vec_id % {hard_negatives.ANCHOR_EVERY} = 0 AND a.vec_id <> c.vec_id),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES})
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pairs USING (anchor_id)
WHERE NOT same AND {hard_negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {hard_negatives.NEGATIVES}"""


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(documents(spark, folder, "doc_id", "text"), documents(spark, folder, "item_id", "text", table="benchmark"))


_TERMS = r"regexp_extract_all(translate(text, '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)
SQL["op13_ranked_search"] = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS d, sum(n)::BIGINT AS l FROM docs),
item_terms AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * d + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, d),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * d) // l))) AS part
          FROM tf JOIN docs USING (doc_id) JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM item_terms JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {ranked_search.TOP}"""
