"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Stages take (spark, docs, sf_dir) and all but the last return the columns of
``documents``.  Near duplicates: five-word shingles, similarity 0.8 or more; of
each group the row with the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table, written
from barloom.llm.exact_dedup import one_of_each
from barloom.llm.jaccard_join import one_of_each_component
from barloom.llm.quality_rules import quality_rules
from barloom.llm.sentencepiece_nbest import encode
from barloom.llm.source_mix import in_mixed_order, mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id."""
    return one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that with the smallest doc_id.

    Rows without words have no component and stay.  Rows are told apart by id
    and text: of two rows with one id each has its own fate.
    """
    return one_of_each_component(docs, k=5, threshold=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture."""
    return in_mixed_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the N best segmentations of each row, and its place (``mix_slot``, ``mix_rank``) in the mixture.

    Files do not keep the order of rows, so the place is found here again: it
    follows from the rows alone, and is the one they were ordered by.
    """
    kept = ["doc_id", "lang", "source", "mix_slot", "mix_rank"]
    return encode(mix_sources(docs), keep=kept).select("doc_id", "lang", "source", "n_tokens", "ids", "nbest", "round_trip", "mix_slot", "mix_rank")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("source_mix", mixed), ("sentencepiece", encoded)]

#: SQL can't express the last stage; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
