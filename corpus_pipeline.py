"""From raw documents to training sequences: toxicity, near duplicates, repeated passages, packing.

Every stage is written as Parquet into shared storage and read again as the next one's documents.

Defined cases: rows are judged one by one, so a doc_id with several texts loses only those that are copies; null and
empty texts pass all stages and are an end token in the packing; rows with a null doc_id are never copies or repeats of
others; repeated rows stay repeated; other columns are carried along up to the packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm.minhash import distinct_texts
from orbweave.llm.packing import pack_documents
from orbweave.llm.recompress import without_repeats
from orbweave.llm.toxicity import fit, keep_harmless
from orbweave.llm.workspace import materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on every text and every label, does not reject; null and empty texts stay."""
    return keep_harmless(docs, fit(docs, table(spark, sf_dir, "labels"), fold=False))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return distinct_texts(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that an earlier document has; n_chars follows the text."""
    return without_repeats(docs, 50)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every remaining document with its training sequence."""
    return pack_documents(docs, 1024, 2)


STAGES = [("toxicity", toxicity), ("near_duplicate", near_duplicate), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Signatures, symbols and linear programs are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
