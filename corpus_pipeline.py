"""A corpus pipeline over ``documents``: STAGES in order, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spogrid.llm import stages
from spogrid.llm.shared import stored

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("language_id", stages.language_id),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("byte_bpe", stages.byte_bpe),
]

# The learned stages and the tokenizer cannot be written as SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
