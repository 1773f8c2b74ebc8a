"""From raw documents to packed training sequences, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.

Defined cases, in every stage: rows are judged as they stand, so a null id or an
id that repeats costs no other row its place; extra columns pass through, whatever
their names; an empty table gives an empty one. What becomes of a null text or of
rows that are all alike is said by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.decontamination import drop_contaminated
from plumbline.llm.near_duplicates import drop_near_duplicates
from plumbline.llm.packing import pack_documents
from plumbline.llm.quality_rules import drop_low_quality
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.runtime import materialise, table
from plumbline.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go: null and empty texts with them, copies alike."""
    return drop_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the smallest id stays.

    Of rows with the same id and text one stays; texts without words are no one's duplicate.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; a null text holds none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; their secrets are replaced by a mark, and ``n_chars`` follows. A null text stays null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row, copies too, and its place in a training sequence; a null text is one piece, the end token."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("best-fit packing", packing),
]

#: Models and a tokenizer decide in it, which SQL does not have; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
