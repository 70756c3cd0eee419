"""The text pipeline: from documents to packed sequences.

Each stage takes (spark, docs, folder) and returns a table, which is written and read back as the next one's
documents. All stages but the last return the columns of documents: those without a language go, one of each
group of near duplicates stays, repeated passages go from the texts, documents that hold benchmark items
go, and the rest is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollweave.llm import decontaminate, language, near_dedup, packing, substring
from rollweave.llm.common import saved, table


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return substring.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, folder, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Trained networks, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
