"""From raw documents to mixed, tokenised ones: the stages in their order.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns
of its input; the last returns the digests of every document's tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm import exact_dedup, language_id, mixing, near_dup
from fieldglass.llm.common import table, written
from fieldglass.llm.queries import piece_model
from fieldglass.llm.sentencepiece_codec import encode_documents


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as ``lang``; null texts and texts without a letter go."""
    return language_id.known_language(docs, into="lang")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, and one of rows that repeat; null counts as empty."""
    return exact_dedup.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; null and wordless texts and null ids stay."""
    return near_dup.kept_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked weights of source, the language found and topic; nulls are categories."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; null text has no token."""
    return encode_documents(docs, piece_model(), keep_pieces=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

#: Language identification can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
