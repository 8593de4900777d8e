"""Corpus pipeline: from raw documents to packed sequences, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import exact_dedup, language, mixing, overlap, packing
from folio.runtime import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Each stage judges every row on its own, whether its doc_id is null or shared, reads whole texts of any length, counts null
# texts as empty, gives no rows for an empty table, and hands on columns of any name as they came.


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without one language for a fair part of their letters, go. Without labels only the first kind goes."""
    return language.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the smallest doc_id, null last, any one of rows that share it. Empty texts are equal."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, chosen as in the exact stage: five-word shingles, Jaccard similarity 0.8 or more."""
    return overlap.keep_distinct(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its sources takes it; those without words go, a null source is one of its own."""
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the packed sequences; an empty text is its end token."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("pack_sequences", pack_stage),
]

#: Predicted languages, components, and packings are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
