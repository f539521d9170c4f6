"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all documents the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import read
from .bpe import encode_decode
from .line_dedup import drop_repeated_lines
from .minhash import drop_near_duplicates
from .mixing import apply_mix
from .quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; a document that loses all its text goes."""
    return drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, 5, 80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return apply_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every row of the mix."""
    return encode_decode(docs)
