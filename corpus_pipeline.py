"""The corpus pipeline: each stage's result is written as Parquet and read again as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomry.llm import exact_dedup, minhash, packing, quality, secret_scan
from fathomry.llm.runtime import Scratch, table

STAGES = [
    ("quality rules", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("minhash near-dedup", minhash.stage),
    ("secret scan", secret_scan.stage),
    ("related packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name.replace(" ", "_"))
    return docs
