"""From documents to packed sequences: language, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import documents, release, scratch, written

#: (name, function of (spark, docs, sf_dir)); each stage's output is written and read again as the next one's documents.
STAGES = [
    ("language", stages.language),
    ("near_dedup", stages.near_dedup),
    ("secrets", stages.secrets),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: The models and the tokenizer have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before = docs
        with scratch():  # a stage's own tables go once its rows are written
            docs = written(stage(spark, before, sf_dir), f"stage-{name}", keep=True)
        release(before)
    return docs
