"""A corpus pipeline of five stages, each over all that its predecessor kept: quality, near duplicates, repeated passages, secrets, packing.

The first four return the columns of documents: rows that the classifier rejects go; of each group of near duplicates the document
with the smallest doc_id stays; repeated passages are cut from the texts; secrets are replaced in them. The last packs what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import ngram_join, packing, quality, repeats, secrets
from callscope.llm.common import Stage, load


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least 0.3, each by its own text (null and empty ones, too); an empty table stays empty, and without labels all rows stay."""
    return quality.without_rejected(docs, load(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, and one of equal rows; rows without a doc_id, a text or words stay."""
    return ngram_join.without_duplicates(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur elsewhere. Null, empty and short texts stay as they are; a text that loses all words stays, empty."""
    return repeats.remove_repeats(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced, each row for itself; null and empty texts, and those without secrets, stay as they are."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and the sequences they are packed into: null and empty texts are one token, long ones several pieces, equal rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", repeats_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Boosted trees and token merges have no SQL form; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), load(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES[:-1]):
        docs = stage.keep(function(spark, docs, sf_dir), str(i))
        stage.drop(str(i - 1))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
