"""A training corpus from the documents table, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import stages
from winnow.llm.common import read_table, written

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("exact_dedup", stages.exact_dedup),
    ("jaccard_join", stages.jaccard_join),
    ("mixing_sources", stages.mixing_sources),
    ("bpe_encoding", stages.bpe_encoding),
]

# The classifier and the tokenizer have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
