"""A training corpus from raw documents: rules, near duplicates, repeated passages, the mix, and tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.bpe import bpe_digests
from palisade.llm.common import documents, materialize
from palisade.llm.jaccard import one_of_each
from palisade.llm.mixing import mixed_documents
from palisade.llm.quality_rules import kept_documents
from palisade.llm.queries import VOCABULARY
from palisade.llm.suffixes import deduped_texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null or empty text fails the base rules; a null language is one of its own;
    equal rows share a verdict; texts are read whole; an empty table stays empty; other columns stay, whatever their
    names."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id, then of the least hash; a null id comes last, rows
    without words are told apart by id and text; of rows with one id and text one stays, chosen by a hash of its other
    columns; an empty table stays empty; other columns stay."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go from the texts, all but the first of each; n_chars follows the text. A null text stays
    null, a null id comes last, equal rows lose alike, an empty table stays empty; other columns stay."""
    return deduped_texts(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A document without words goes, a null source is one of its
    own, equal rows share what the mix takes of them, in order of a hash of their other columns; an empty table stays
    empty; other columns stay."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of each row; a null text is the empty one; equal rows get
    equal results; an empty table gives an empty result."""
    return bpe_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]

#: Near duplicates, repeated byte strings and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
