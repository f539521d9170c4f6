"""Sharding by vector bin packing (operator 1).

Items are groups of equal texts with the vector (bytes, tokens, rows); an item is placed in the shard where the dot product of its share with
the residual capacity is highest. The few groups that fill a good part of a shard are placed first, all together: their number is bounded.
All others are hashed into parts of bounded size, and every part packs its own items into its portion of
what is left of each shard, so neither a task nor the driver holds all groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, n_words, read

DIMS = ("bytes", "tokens", "rows")
PART_ITEMS = 50_000
BIG = 4


def place(items: np.ndarray, room: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Shard of each row of items (n x dims): largest first, each where its dot product with the residual capacity is highest.

    room (shards x dims) is what each shard has left; it is scaled to the total, which is the sum of the items if these fill it all.
    """
    total = items.sum(0) if total is None else total
    n = len(room)
    share = items / np.where(total > 0, total, 1) * n
    residual = np.maximum(room, 0)
    residual = residual / np.where(residual.sum(0) > 0, residual.sum(0), 1) * n
    out = np.empty(len(items), np.int32)
    for i in np.argsort(-share.max(1), kind="stable"):
        b = int(np.argmax(residual @ share[i]))
        out[i] = b
        residual[b] -= share[i]
    return out


def _pack(room: np.ndarray):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "chunk"], kind="stable")
        return pdf.assign(shard=place(pdf[list(DIMS)].to_numpy(float), room))

    return go


def shard(docs: DataFrame, n_shards: int = 40, part_items: int = PART_ITEMS) -> DataFrame:
    """Shard and slot of every document, balancing bytes, tokens and rows.

    docs: doc_id, text. Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, tokens, shard and slot. Equal sizes come first: a group of
    equal texts goes to one shard if it fits into one; one that holds more bytes, tokens or rows than a shard is cut into chunks of about a quarter of a shard, by a hash of
    doc_id, whatever its number of rows. Null text counts as empty. Repeated rows are placed each; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sized = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            n_words(F.col("text")).alias("tokens"), F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("__row"),
        ),
        "shard-sizes",
    )
    vector = (F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = sized.agg(*vector).first()
    groups = sized.groupBy("key").agg(*vector)
    of_shard = F.greatest(*[F.col(c) / F.lit(float(max(total[c] or 0, 1))) for c in DIMS]) * F.lit(float(n_shards))
    # Each of these groups holds over 1 / (BIG * n_shards) of one of three totals: at most 3 * BIG * n_shards of them, a bounded broadcast.
    big = groups.where(of_shard > 1 / BIG).select("key", F.when((of_shard > 1) & (F.col("rows") > 1), F.ceil(of_shard * BIG)).otherwise(1).alias("chunks"))
    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).otherwise(0).cast("int").alias("chunk")
    cut = sized.join(F.broadcast(big), "key", "left").select("*", chunk)
    items = materialize(cut.groupBy("key", "chunk").agg(*vector, F.max(F.col("chunks").isNotNull()).alias("first")), "shard-items")
    early = items.where("first").toPandas().sort_values(["key", "chunk"])  # at most twice as many rows as there are big groups plus BIG * n_shards * 3
    capacity = np.array([[(total[c] or 0) / n_shards for c in DIMS]] * n_shards)
    early["shard"] = place(early[list(DIMS)].to_numpy(float), capacity, np.array([float(total[c] or 0) for c in DIMS])) if len(early) else np.zeros(0, np.int32)
    room = capacity.copy()
    np.subtract.at(room, early["shard"].to_numpy(int), early[list(DIMS)].to_numpy(float))
    n_items = total["rows"]
    parts = max(1, -(-n_items // part_items))
    late = items.where("NOT first").withColumn("part", F.pmod(F.xxhash64("key", "chunk"), F.lit(parts))).withColumn("shard", F.lit(0))
    placed = late.groupBy("part").applyInPandas(_pack(room), late.schema).select("key", "chunk", "shard")
    known = spark.createDataFrame([(bytes(k), int(c), int(z)) for k, c, z in zip(early["key"], early["chunk"], early["shard"])], "key binary, chunk int, shard int")
    placed = placed.unionByName(known)
    rows = materialize(cut.join(placed, ["key", "chunk"]).select("doc_id", "size", "text_crc32", "tokens", "shard", "__row"), "shard-rows")
    discard(sized)
    discard(items)
    return _slots(rows, max(1, -(-n_items // (n_shards * 200_000))))


def _slots(rows: DataFrame, buckets: int) -> DataFrame:
    """Gapless slots from 0 in each shard, numbered bucket by bucket so that no task sorts a whole shard."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "__row")
    return rows.withColumn("at", F.row_number().over(inside) - 1).join(start, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("at")).cast("long")).drop("bucket", "start", "at", "__row")


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
