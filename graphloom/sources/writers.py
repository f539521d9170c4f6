"""Sinks: graph dumps, model dumps aligned by name, predictions, word-vector text."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import get_mapping


def save_edges(adjacency: DataFrame, path: str, names: DataFrame | None = None, weighted: bool = True) -> None:
    """Tab-separated adjacency entries; ids become names where a dictionary is given, weights have six decimals."""
    rows = adjacency
    if names is not None:
        for c in ("src", "dst"):
            rows = rows.join(names.select(F.col("id").alias(c), F.col("name").alias(f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
    cols = [F.col("src").cast("string"), F.col("dst").cast("string")] + ([F.format_string("%f", "weight")] if weighted else [])
    rows.select(F.concat_ws("\t", *cols).alias("value")).write.text(path)


def save_triplets(triplets: DataFrame, path: str, entities: DataFrame | None = None, relations: DataFrame | None = None) -> None:
    """Tab-separated h, r, t, which read_triplets() reads back."""
    rows = triplets
    for c, names in (("h", entities), ("t", entities), ("r", relations)):
        if names is not None:
            rows = rows.join(names.select(F.col("id").alias(c), F.col("name").alias(f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in "hrt"]).alias("value")).write.text(path)


def save_word_vectors(embeddings: DataFrame, names: DataFrame, path: str) -> None:
    """Lines `name x1 x2 ...`; a file `header` beside them holds the number of rows and the dimension."""
    rows = embeddings.join(names, "id").select("name", F.col("vec").cast("array<double>").alias("vec"))
    facts = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    rows.select(F.concat_ws(" ", "name", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    spark = embeddings.sparkSession
    spark.createDataFrame([(f"{facts[0]} {facts[1] or 0}",)], "value string").coalesce(1).write.text(os.path.join(path, "header"))


def save_model(path: str, tables: dict[str, DataFrame], hyperparameters: dict | None = None) -> None:
    """A Parquet folder per table (names and matrices), and the hyper-parameters as JSON."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(os.path.join(path, name))
    if hyperparameters is not None:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(hyperparameters, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "hyperparameters"))


def load_matrix(spark: SparkSession, path: str, names: str, matrix: str, onto: DataFrame) -> DataFrame:
    """(id, vec) of a saved matrix with the ids of another dictionary (name, id): rows meet by name; a name that is missing fails."""
    saved = spark.read.parquet(os.path.join(path, names)).withColumnRenamed("id", "__old").join(spark.read.parquet(os.path.join(path, matrix)).withColumnRenamed("id", "__old"), "__old").drop("__old")
    wanted = onto.join(saved, "name", "left")
    whole = F.coalesce("vec", F.raise_error(F.concat(F.lit("the model has no row for "), "name")).cast("array<double>"))
    return wanted.select("id", whole.alias("vec"))


def load_hyperparameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(os.path.join(path, "hyperparameters")).first()["value"])


def save_predictions(predictions: DataFrame, entities: DataFrame, path: str) -> None:
    """Lines of `name: score`, tab-joined, best first, a line a query in the order of q (.txt), or the rows as Parquet."""
    named = predictions.join(entities.select(F.col("id").alias("entity"), "name"), "entity")
    if path.endswith(".txt"):
        row = F.sort_array(F.collect_list(F.struct("rank", F.concat("name", F.lit(": "), F.col("score").cast("float").cast("string")).alias("s"))))
        named.groupBy("q").agg(row.alias("r")).orderBy("q").select(F.array_join(F.transform("r", lambda x: x["s"]), "\t").alias("value")).write.text(path)
    elif path.endswith(".parquet"):
        named.select("q", "rank", "name", "score").write.parquet(path)
    else:
        raise ValueError(f"unknown extension of `{path}`: .txt and .parquet are known")


def map_names(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    return get_mapping(rows, column, names)
