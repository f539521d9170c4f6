"""Mixing sources to target weights by pivotal dependent rounding (operator 10).

Every document of a source starts with the same fractional number of copies, target / source size. The whole
part is taken at once; the fractional parts of a source are then rounded together: two documents exchange
mass (probability times size) at random, without drift, until one of them is integral, and the other one goes
on to the next document. As mass is conserved in every exchange, the words taken differ from the target only by the rounding of
the one document that is left. Hot sources are cut into buckets by a hash of the id; each bucket
leaves one document, and the left-overs meet in a reduction tree, so no task sees a whole source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, n_words, read

CAP = 3.0
BUCKET_ROWS = 50_000
FAN_IN = 64
EPS = 1e-9


def source_targets(sized: DataFrame, cap: float = CAP) -> DataFrame:
    """Per source: n_docs, source_size, weight (1, 2, 3, repeating by code point, null last) and target.

    target = min(cap * source_size, level * weight) with the one level at which targets sum to all sizes: what
    is cut off by the cap is shared again by weight until no target is above its cap. The table has one row a
    source, and the window that finds the level runs over that table only.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    ratio = F.lit(cap) * F.col("source_size") / F.col("weight")
    rising = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("capped_before", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(rising), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(rising), F.lit(0)))
        .withColumn("level_here", (F.sum("source_size").over(everything) - F.col("capped_before")) / (F.sum("weight").over(everything) - F.col("weight_before")))
        .withColumn("level", F.max(F.when(F.col("level_here") <= ratio, F.col("level_here"))).over(everything))
    )
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).cast("double")
    return per.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round p in order by exchanging mass p * size between neighbours; at most one entry stays fractional."""
    p, carry = p.astype(float).copy(), -1
    for j in range(len(p)):
        if size[j] <= 0:
            p[j] = 0.0
            continue
        if p[j] <= EPS or p[j] >= 1 - EPS:
            p[j] = round(p[j])
            continue
        if carry < 0:
            carry = j
            continue
        i = carry
        give, take = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        m = give if u[j] * (give + take) < take else -take
        p[i], p[j] = p[i] + m / size[i], p[j] - m / size[j]
        open_ = []
        for k in (i, j):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = round(p[k])
            else:
                open_.append(k)
        carry = max(open_, key=lambda k: size[k]) if open_ else -1
    return p


def _round_level(last: bool):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "u", "doc_id"], ascending=[False, True, True], kind="stable")
        p = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy(), pdf["u"].to_numpy())
        if last:
            left = (p > 0) & (p < 1)
            p[left] = (pdf["u2"].to_numpy()[left] < p[left]).astype(float)
        return pdf.assign(p=p)

    return go


def mix(docs: DataFrame, cap: float = CAP, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Copies of every document so that sources reach their targets.

    docs: doc_id, source, text. Returns doc_id, size, source, source_size, target, copies (int, at most cap) and taken =
    copies * size, a row per row of docs. Null text has size 0 and is never taken by chance; null sources form one source; repeated rows
    count each by itself; an empty table gives an empty table. Deterministic: every draw is a hash of doc_id and seed.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized, cap)
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(copies + EPS)
    draw = lambda k: (F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias(f"u{k}")
    first = joined.select(
        "d.doc_id", "d.source", "d.size", "source_size", "target", whole.cast("int").alias("whole"),
        F.greatest(F.lit(0.0), copies - whole).alias("p"), draw(1).alias("u"), draw(2).alias("u2"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n_docs") / F.lit(float(bucket_rows)))).alias("bucket"),
    )
    spread = targets.agg(F.max(F.ceil(F.col("n_docs") / F.lit(float(bucket_rows))))).first()[0] or 1
    done, width = [], int(spread)
    level = first
    while True:
        last = width <= 1
        out = materialize(level.groupBy("source", "bucket").applyInPandas(_round_level(last), level.schema), "mix-level")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out if last else out.where(~fractional))
        if last:
            break
        level = out.where(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        width = -(-width // FAN_IN)
    discard(sized)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    total = F.col("whole") + F.round("p").cast("int")
    return rows.select("doc_id", "size", "source", "source_size", "target", total.alias("copies"), (total * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of docs as often as mix() says. Rows are told apart by doc_id; rows that share one share its largest count."""
    copies = mix(docs, seed=seed).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    return docs.join(copies, docs["doc_id"].eqNullSafe(copies["__id"])).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
