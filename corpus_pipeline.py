"""Corpus pipeline: quality filter, line dedup, near-dedup, source mixing and tokenisation of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm._common import materialize, read
from graphloom.llm.stages import encoding_stage, line_dedup_stage, mixing_stage, near_dedup_stage, quality_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: A classifier and random rounding can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
