"""Queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import oracles
from palisade.llm.bpe import bpe_digests
from palisade.llm.common import documents
from palisade.llm.jaccard import near_duplicates
from palisade.llm.mixing import mix
from palisade.llm.neighbours import nearest
from palisade.llm.passages import quality_scores
from palisade.llm.quality_rules import quality
from palisade.llm.quotes import linked_conversations
from palisade.llm.sharding import hilbert_shards
from palisade.llm.substrings import substring_dedup
from palisade.llm.suffixes import suffix_dedup

VOCABULARY = "byte_bpe_50k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).drop("class_distance", "word_distance")


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir), shards=24)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def op9_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op5_quotation_links": op5_quotation_links,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_bpe": op7_bpe,
    "op8_projection_forest": op8_projection_forest,
    "op9_passage_attention": op9_passage_attention,
    "op10_suffix_dedup": op10_suffix_dedup,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRINGS,
    "op3_ngram_jaccard": oracles.JACCARD,
    "op4_quality_rules": oracles.QUALITY,
    "op5_quotation_links": oracles.QUOTES,
    "op10_suffix_dedup": oracles.SUFFIXES,
    "op1_mixing": r"""
        WITH d AS (
            SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS sk,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))) AS key
            FROM documents),
        s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
        w AS (SELECT *, (row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
        f AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM w WINDOW before AS (ORDER BY cap / weight, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        r AS (SELECT min_by(level, struct_pack(a := cap / weight, b := sk)) AS level FROM f WHERE cap > weight * level),
        t AS (SELECT f.sk, source_size, CASE WHEN cap <= weight * f.level THEN CAST(cap AS DOUBLE) ELSE weight * r.level END AS target FROM f LEFT JOIN r ON true),
        p AS (
            SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
                   coalesce(sum(size) OVER (PARTITION BY d.sk ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t USING (sk)),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) AS BIGINT) AS taken
        FROM e""",
}
