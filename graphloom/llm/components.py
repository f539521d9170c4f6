"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node u of directed edges (u, v): the smallest of u and its neighbours. A partial aggregate, so hot nodes don't gather."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Self-loops and repeated or reversed edges are fine; null ends are ignored; no edges give no rows. Every round is written to the shared folder.
    """
    und = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(und, "cc")
    last = None
    for _ in range(max_rounds):
        # Large-star: every node links its larger neighbours to its smallest one.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        # Small-star: every node links itself and its smaller neighbours to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = materialize(small, "cc-small")
        sign = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(now)
        now = nxt
        if tuple(sign) == last:
            break
        last = tuple(sign)
    else:
        raise RuntimeError(f"connected components didn't settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
