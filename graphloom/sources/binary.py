"""Binary image sources with fixed-width records, and batch feature extraction with a model of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(spark: SparkSession, path: str, header: int, width: int, parse: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                raw = np.frombuffer(content, np.uint8)[header:]
                if len(raw) % width:
                    raise ValueError(f"{name} isn't a whole number of records of {width} bytes")
                rows = raw.reshape(-1, width)
                yield pd.DataFrame({"file": name, "row": np.arange(len(rows)), **parse(rows)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, row long, {schema}")


def read_idx_images(spark: SparkSession, path: str, pixels: int = 28 * 28) -> DataFrame:
    """(file, row, vec) of idx image files: a header of 16 bytes, then `pixels` bytes an image."""
    return _records(spark, path, 16, pixels, lambda x: {"vec": list(x.astype(float))}, "vec array<double>")


def read_idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, label) of idx label files: a header of 8 bytes, then a byte a label."""
    return _records(spark, path, 8, 1, lambda x: {"label": x[:, 0].astype(int)}, "label int")


def read_labelled_rows(spark: SparkSession, path: str, pixels: int = 3072) -> DataFrame:
    """(file, row, label, vec) of files with a label byte and `pixels` bytes an image."""
    return _records(spark, path, 0, pixels + 1, lambda x: {"label": x[:, 0].astype(int), "vec": list(x[:, 1:].astype(float))}, "label int, vec array<double>")


def image_features(images: DataFrame, model: Callable[[np.ndarray], np.ndarray] | None = None, batch_size: int = 128) -> DataFrame:
    """images (vec) with a column features: the model's output, computed in batches on the executors.

    No network ships with this package; pass a callable from a batch of rows to a batch of features.
    """
    if model is None:
        raise NotImplementedError("pass a feature model: none is bundled")

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            x = np.array(s.to_list(), float)
            out = [model(x[i : i + batch_size]) for i in range(0, len(x), batch_size)]
            yield pd.Series(list(np.concatenate(out))) if out else pd.Series([], dtype=object)

    return images.withColumn("features", F.pandas_udf(run, "array<double>")("vec"))
