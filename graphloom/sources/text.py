"""Text sources: edge lists, triplets, corpora, vectors and evaluation files.

One tokeniser serves all: a line is cut at the first comment string, then split at runs of delimiters; lines without tokens are skipped. Schemas
are fixed, nothing is inferred. Every reader keeps the line's place in the input (line) so that ids can follow first appearance.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextFormat:
    """Delimiter characters and the prefix of comments."""

    delimiters: str = " \t\r\n"
    comment: str = "#"

    def tokens(self, line: Column) -> Column:
        """Tokens of a line, an array<string> without empty ones."""
        if self.comment:
            line = F.substring_index(line, self.comment, 1)
        inside = "".join("\\" + c if c in "\\^]-[&" else c for c in self.delimiters)
        return F.filter(F.split(line, f"[{inside}]+"), lambda x: x != "")


def read_tokens(spark: SparkSession, path: str | list[str], fmt: TextFormat = TextFormat(), keep_blank: bool = False) -> DataFrame:
    """(line, tokens) of all text files at path; line grows along each file, so it orders rows and tells them apart.

    Null lines can't occur; blank lines and lines of comments are dropped unless keep_blank.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), fmt.tokens(F.col("value")).alias("tokens"))
    return lines if keep_blank else lines.where(F.size("tokens") > 0)


def _sized(rows: DataFrame, least: int, most: int, what: str) -> DataFrame:
    """rows, failing at run time on a line with another number of tokens."""
    fine = F.size("tokens").between(least, most)
    wrong = F.raise_error(F.concat(F.lit(f"invalid {what}, {least} to {most} tokens are wanted: "), F.concat_ws(" ", "tokens")))
    return rows.withColumn("tokens", F.when(fine, F.col("tokens")).otherwise(wrong.cast("array<string>")))


def _weight(at: int) -> Column:
    return F.coalesce(F.get("tokens", F.lit(at)).cast("double"), F.lit(1.0)).alias("weight")


def read_edges(spark: SparkSession, path: str | list[str], fmt: TextFormat = TextFormat()) -> DataFrame:
    """(line, src, dst, weight) of lines `head tail [weight]`; the weight is 1 where it is left out."""
    rows = _sized(read_tokens(spark, path, fmt), 2, 3, "edge")
    return rows.select("line", F.get("tokens", F.lit(0)).alias("src"), F.get("tokens", F.lit(1)).alias("dst"), _weight(2))


def read_triplets(spark: SparkSession, path: str | list[str], fmt: TextFormat = TextFormat()) -> DataFrame:
    """(line, h, r, t, weight) of lines `head relation tail [weight]`."""
    rows = _sized(read_tokens(spark, path, fmt), 3, 4, "triplet")
    return rows.select("line", *[F.get("tokens", F.lit(i)).alias(c) for i, c in enumerate("hrt")], _weight(3))


def read_queries(spark: SparkSession, path: str, target: str = "tail", fmt: TextFormat = TextFormat()) -> DataFrame:
    """(line, h, r, t) for entity prediction: full triplets, or two tokens with the target left out (null)."""
    if target not in ("head", "tail"):
        raise ValueError(f"target must be head or tail, not `{target}`")
    rows = _sized(read_tokens(spark, path, fmt), 2, 4, "entity query")
    at = lambda i: F.get("tokens", F.lit(i))
    full = F.size("tokens") >= 3
    if target == "head":
        cols = F.when(full, at(0)).alias("h"), F.when(full, at(1)).otherwise(at(0)).alias("r"), F.when(full, at(2)).otherwise(at(1)).alias("t")
    else:
        cols = at(0).alias("h"), at(1).alias("r"), F.when(full, at(2)).alias("t")
    return rows.select("line", *cols)


def read_corpus(spark: SparkSession, path: str | list[str], fmt: TextFormat = TextFormat()) -> DataFrame:
    """(line, tokens): one sentence a line."""
    return read_tokens(spark, path, fmt)


def read_vectors(spark: SparkSession, path: str, fmt: TextFormat = TextFormat()) -> DataFrame:
    """(id, vec) of a text matrix; rows are numbered in file order, and all must have the width of the first."""
    rows = read_tokens(spark, path, fmt)
    numbered = rows.select("line", F.transform("tokens", lambda x: x.cast("double")).alias("vec"))
    width = numbered.orderBy("line").select(F.size("vec")).first()
    width = width[0] if width else 0
    same = F.when(F.size("vec") == width, F.col("vec")).otherwise(F.raise_error(F.lit(f"all rows of a matrix need {width} numbers")).cast("array<double>"))
    return with_ordinal(numbered.select("line", same.alias("vec")), "id").select("id", "vec")


def with_ordinal(rows: DataFrame, name: str, order: str = "line") -> DataFrame:
    """rows with a dense number from 0 in the order of a line column made by these readers.

    Counts per partition are added up (a row a partition), so no task sorts all rows.
    """
    part = F.shiftright(F.col(order), 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return rows.withColumn("__part", part).withColumn("__at", inside).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def read_labels(spark: SparkSession, path: str, fmt: TextFormat = TextFormat()) -> DataFrame:
    """(line, node, label) of lines `node label`; several lines for a node make it multi-label."""
    rows = _sized(read_tokens(spark, path, fmt), 2, 2, "node label")
    return rows.select("line", F.get("tokens", F.lit(0)).alias("node"), F.get("tokens", F.lit(1)).alias("label"))


def read_test_edges(spark: SparkSession, path: str, fmt: TextFormat = TextFormat()) -> DataFrame:
    """(line, src, dst, y) of lines `head tail 0|1`."""
    rows = _sized(read_tokens(spark, path, fmt), 3, 3, "labelled edge")
    return rows.select("line", F.get("tokens", F.lit(0)).alias("src"), F.get("tokens", F.lit(1)).alias("dst"), F.get("tokens", F.lit(2)).cast("int").alias("y"))


def read_point_labels(spark: SparkSession, path: str, fmt: TextFormat = TextFormat()) -> DataFrame:
    """(id, path): the label or labels (root first) of the points, by row."""
    return with_ordinal(read_tokens(spark, path, fmt), "id").select("id", F.col("tokens").alias("path"))


def read_communities(spark: SparkSession, path: str, fmt: TextFormat = TextFormat()) -> DataFrame:
    """(node, label) of lines that list the nodes of one community; its label is the number of its line, from 0."""
    rows = with_ordinal(read_tokens(spark, path, fmt, keep_blank=True), "label")
    return rows.select(F.explode("tokens").alias("node"), F.col("label").cast("string").alias("label"))


def read_aliases(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """(object, aliases) of lines `object<TAB>alias<TAB>alias ...`."""
    parts = F.split(F.col("value"), re.escape(delimiter))
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("object"), F.slice(parts, F.lit(2), F.size(parts)).alias("aliases"))


def edges_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """An in-memory list of (src, dst) or (src, dst, weight)."""
    data = [(i, str(r[0]), str(r[1]), float(r[2]) if len(r) > 2 else 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "line long, src string, dst string, weight double")


def triplets_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """An in-memory list of (h, r, t) or (h, r, t, weight)."""
    data = [(i, str(r[0]), str(r[1]), str(r[2]), float(r[3]) if len(r) > 3 else 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "line long, h string, r string, t string, weight double")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of a two-dimensional .npy matrix, memory-mapped and read block by block in tasks."""
    import numpy as np

    whole = np.load(path, mmap_mode="r")
    if whole.ndim != 2:
        raise ValueError("a matrix with two dimensions is wanted")
    n, step = whole.shape[0], max(1, (4 << 20) // max(1, whole.shape[1]))

    def load(batches):
        import pandas as pd

        m = np.load(path, mmap_mode="r")
        for pdf in batches:
            for s in pdf["id"]:
                block = np.asarray(m[s : s + step], float)
                yield pd.DataFrame({"id": np.arange(s, s + len(block)), "vec": list(block)})

    return spark.range(0, n, step, numPartitions=max(1, min(n // step, 1024))).mapInPandas(load, "id long, vec array<double>")


def read_vector_file(spark: SparkSession, path: str, fmt: TextFormat = TextFormat()) -> DataFrame:
    """.npy or .txt vectors; other extensions are refused."""
    if path.endswith(".npy"):
        return read_npy(spark, path)
    if path.endswith(".txt"):
        return read_vectors(spark, path, fmt)
    raise ValueError(f"unknown vector file `{path}`: .npy and .txt are known")
