"""The corpus pipeline: reject toxic documents, near-duplicates and benchmark leaks, mix sources, cut shards.

Every stage takes what its predecessor kept and returns the columns of documents; the last adds shard and curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillvec.llm import hilbert_shards, mixing, near_dup, toxicity, winnowing
from quillvec.session import settle

STAGES = [
    ("toxicity", toxicity.stage),
    ("near-duplicates", near_dup.stage),
    ("decontamination", winnowing.stage),
    ("mixing", mixing.stage),
    ("shards", hilbert_shards.stage),
]

# No SQL: the toxicity stage learns a model. tests/llm checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
