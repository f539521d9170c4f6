"""Cutting lineage: reliable checkpoints in the folder the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a temporary folder in local mode (a test) and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not shared and "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="graphloom-")
    return (shared or _own["folder"]).rstrip("/")


_own: dict[str, str] = {}


def settle(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
