"""The corpus pipeline: stages of training-data operators over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookmerge.llm import decontaminate, jaccard_join, line_dedup, packing, quality_model
from bookmerge.llm._shared import written

STAGES = [
    ("quality classifier", quality_model.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("packing", packing.stage),
]
#: Tokenizers and learned models are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
