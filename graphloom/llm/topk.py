"""Exact top-k inner-product search over norm-sorted blocks (operator 4).

Vectors are sorted by descending length and cut into blocks. Queries form blocks too; pairs of a query block and a vector block are
scored with matrix products. The first block of longest vectors gives every query a k-th best score; from then on a
block is opened only for the queries whose length times the block's greatest length can still reach it. Inside a block the vectors
are turned by the singular vectors of the whole table, so that the leading coordinates hold most of the product:
products of those alone plus the Cauchy-Schwarz bound of the rest drop nearly all candidates, and only what is left is
scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, read

BLOCK = 8192
QUERY_BLOCK = 2048
K = 10
#: Partial sums of the Gram matrix that reach the driver, and the most range partitions (blocks in them stay as small as ever).
SUMS, MAX_PARTS = 8, 1 << 16
_EXACT = float(1 << 53)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))


def _matrix(values, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _blocks(size: int, dim: int, turn: np.ndarray):
    """Rows of a partition, already by descending length, into blocks of ids, vectors and turned vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        vecs: list = []

        def flush():
            x = _matrix(vecs, dim)
            norm = np.sqrt((x * x).sum(1))
            order = np.lexsort((np.array(ids), -norm))
            x, norm, named = x[order], norm[order], np.array(ids, np.int64)[order]
            return pd.DataFrame({"ids": [named.tobytes()], "x": [x.tobytes()], "n": [len(named)], "longest": [float(norm[0])]})

        for pdf in batches:
            for i, v in zip(pdf["vec_id"], pdf["vec"]):
                ids.append(i)
                vecs.append(v)
                if len(ids) == size:
                    yield flush()
                    ids, vecs = [], []
        if ids:
            yield flush()

    return run


BLOCK_SCHEMA = "ids binary, x binary, n int, longest double"


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def score_pair(qid, q, qfloor, ids, x, k: int, turn: np.ndarray, lead: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in a block that can reach qfloor (the k-th best so far)."""
    qt, xt = q @ turn, x @ turn
    qrest, xrest = np.sqrt((qt[:, lead:] ** 2).sum(1)), np.sqrt((xt[:, lead:] ** 2).sum(1))
    qlen, xlen = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    top = np.argsort(-xlen, kind="stable")[: 8 * k]
    small = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]) < _EXACT
    exact = lambda a, b: (b @ a) if small else np.array([sum(int(u) * int(v) for u, v in zip(a, w)) for w in b], object)
    out = []
    for i in range(len(qid)):
        reach = np.searchsorted(-xlen, -(qfloor[i] / qlen[i]) * (1 - 1e-9), side="right") if qlen[i] > 0 and qfloor[i] > 0 else len(ids)
        if not reach:
            continue
        floor = qfloor[i]
        first = exact(q[i], x[top])[ids[top] != qid[i]]
        if len(first) >= k:
            floor = max(floor, float(np.sort(first.astype(float))[-k]))
        slack = 1e-9 * (qlen[i] * xlen[0] + 1)
        bound = xt[:reach, :lead] @ qt[i, :lead] + xrest[:reach] * qrest[i]
        left = np.flatnonzero(bound >= floor - slack)
        left = left[ids[left] != qid[i]]
        s = exact(q[i], x[left])
        for j in _best(s.astype(float), ids[left], k) if small else np.array(sorted(range(len(left)), key=lambda j: (-s[j], ids[left[j]]))[:k], int):
            if s[j] >= floor - slack:
                out.append((int(qid[i]), int(ids[left[j]]), int(s[j])))
    return out


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k best other vectors of every query row by inner product of floor(scale * x), ties to smaller ids.

    Returns query_id, rank, vec_id, score. is_query: a condition on vec_id. Vectors that are null or hold null or non-finite
    components take no part, neither do rows without id; a shorter vector counts as padded with zeros; an id that occurs several times is
    a candidate that often, but never of its own id. Scores are exact: in doubles while all sums fit 53 bits, else in
    Python integers (they must fit a long). Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    base = _usable(vectors, id_col, vec_col).select("vec_id", F.transform("vec", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    base = base.withColumn("norm", norm)
    facts = base.agg(F.max(F.size("vec")).alias("dim"), F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"] or not facts["dim"]:
        if not facts["n"]:
            return spark.createDataFrame([], schema)
    dim = max(1, facts["dim"])

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((dim, dim))
        for pdf in batches:
            x = _matrix(pdf["vec"], dim)
            g += x.T @ x
        yield pd.DataFrame({"g": [g.tobytes()]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((dim, dim))
        for pdf in batches:
            for one in pdf["g"]:
                g += np.frombuffer(one).reshape(dim, dim)
        yield pd.DataFrame({"g": [g.tobytes()]})

    # One dim x dim matrix a task, added up in SUMS tasks; the driver gets one matrix of each.
    grams = base.select("vec").mapInPandas(gram, "g binary").repartition(SUMS).mapInPandas(add_up, "g binary").collect()
    total = sum((np.frombuffer(row["g"]).reshape(dim, dim) for row in grams), np.zeros((dim, dim)))
    values, turn = np.linalg.eigh(total)
    turn = turn[:, ::-1].copy()
    energy = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
    lead = int(min(dim, max(1, np.searchsorted(energy, 0.7) + 1)))

    parts = max(1, min(-(-facts["n"] // block), MAX_PARTS))
    ordered = base.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id") if parts > 1 else base.coalesce(1).sortWithinPartitions(F.desc("norm"), "vec_id")
    cands = materialize(ordered.select("vec_id", "vec").mapInPandas(_blocks(block, dim, turn), BLOCK_SCHEMA).withColumn("cb", F.monotonically_increasing_id()), "topk-blocks")
    asked = base.where(is_query(F.col("vec_id")))
    n_q = asked.count()
    qparts = max(1, min(-(-n_q // QUERY_BLOCK), MAX_PARTS))
    q = materialize(asked.repartition(qparts, "vec_id").select("vec_id", "vec").mapInPandas(_blocks(QUERY_BLOCK, dim, turn), BLOCK_SCHEMA).withColumn("qb", F.monotonically_increasing_id()), "topk-queries")
    # First look: every query block against the block of the longest vectors sets the floors.
    longest = cands.orderBy(F.desc("longest"), "cb").limit(1).select(F.col("cb").alias("c_cb"))
    left = lambda df: df.select("qb", F.col("ids").alias("qids"), F.col("x").alias("qx"), F.col("longest").alias("qlongest"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                qid, ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                qm, x = np.frombuffer(r.qx).reshape(-1, dim), np.frombuffer(r.x).reshape(-1, dim)
                floors = np.frombuffer(r.floors) if r.floors is not None else np.full(len(qid), -np.inf)
                rows = score_pair(qid, qm, floors, ids, x, k, turn, lead)
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = "query_id long, vec_id long, score long"
    first_pairs = left(q).join(F.broadcast(longest), F.lit(True)).join(cands.withColumnRenamed("cb", "c_cb"), "c_cb").withColumn("floors", F.lit(None).cast("binary"))
    seen = materialize(first_pairs.select("qids", "qx", "ids", "x", "floors").mapInPandas(look, found), "topk-first")
    kth = seen.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") == k).select("query_id", F.col("score").cast("double").alias("floor"))

    def with_floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                known = dict(zip(r.q, r.f)) if r.q is not None else {}
                floors = np.array([known.get(i, -np.inf) for i in ids.tolist()])
                lengths = np.sqrt((np.frombuffer(r.x).reshape(-1, dim) ** 2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(lengths > 0, floors / np.where(lengths > 0, lengths, 1), np.where(floors <= 0, -np.inf, np.inf))
                yield pd.DataFrame({"qb": [r.qb], "qids": [r.ids], "qx": [r.x], "floors": [floors.tobytes()], "need": [float(need.min(initial=np.inf))]})

    def explode_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"query_id": ids, "qb": r.qb})

    of_block = q.select("qb", "ids").mapInPandas(explode_ids, "query_id long, qb long").distinct().join(kth, "query_id").groupBy("qb").agg(F.collect_list("query_id").alias("q"), F.collect_list("floor").alias("f"))
    ready = materialize(q.join(of_block, "qb", "left").select("qb", "ids", "x", "q", "f").mapInPandas(with_floors, "qb long, qids binary, qx binary, floors binary, need double"), "topk-floors")
    # The stated query set against all rows, in blocks: a block of vectors meets a block of queries only if its longest vector can reach a floor.
    other = cands.join(longest, cands["cb"] == longest["c_cb"], "left_anti")
    pairs = ready.select("qb", "need").join(other.select("cb", "longest"), F.col("longest") * (1 + 1e-9) >= F.col("need")).select("qb", "cb")
    rest = pairs.join(ready.drop("need"), "qb").join(other.select("cb", "ids", "x"), "cb").select("qids", "qx", "ids", "x", "floors").mapInPandas(look, found)
    every = seen.unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, K)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
