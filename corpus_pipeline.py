"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns segmentations with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchloom.llm import common, language_id, line_dedup, mixing, near_dedup, sentence_pieces

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("sentence_pieces", sentence_pieces.stage),
]

#: Fitted models, sketches and lattices have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, with a table in the shared folder between each two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
