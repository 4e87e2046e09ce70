"""The corpus pipeline: five operators in a row, each over all that the one before it kept.

Each stage's result is written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrazo.llm import decontaminate, jaccard, mixing, sharding, toxicity
from terrazo.llm.common import Scratch, documents

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: The trained classifier and the seeded order can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
