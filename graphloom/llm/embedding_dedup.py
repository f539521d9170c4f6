"""Embedding near-duplicates with an inverted multi-index (operator 5).

Two codebooks, one for each half of the vectors, form a product grid; every vector lies in the cell of its nearest two centroids. A vector visits the cells of the grid
in the order of how far it would have to move to get there (the multi-sequence order over both halves), until the wanted recall of
links is reached, and verifies what lies in them. Only vectors with a larger id are compared, so each pair is met once.
Blocks of vectors are compared by matrix products; a block emits link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, read
from .components import connected_components

SAMPLE = 20_000
TARGET_RECALL = 0.999
CHUNK = 4096


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


class Grid:
    """Codebooks of both halves, and how far a vector may have to move (squared) into a cell to find its links."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [k_means(sample[:, : self.half], k), k_means(sample[:, self.half :], k)]
        self.gaps = [np.sqrt(np.maximum(((c * c).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * c @ c.T), 1e-12)) for c in self.books]
        self.reach = self._calibrate(sample, cosine, recall)

    def _parts(self, x: np.ndarray):
        for part, c, gap in ((x[:, : self.half], self.books[0], self.gaps[0]), (x[:, self.half :], self.books[1], self.gaps[1])):
            yield (part * part).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * part @ c.T, gap

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        return [d.argmin(1) for d, _ in self._parts(x)]

    def moves(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance from each vector's half to the plane between its nearest centroid and each other one: no less lies between it and the cell."""
        out = []
        for d, gap in self._parts(x):
            near = d.argmin(1)
            out.append((np.maximum(d - d[np.arange(len(d)), near][:, None], 0) / (2 * gap[near])) ** 2)
        return out

    def _calibrate(self, sample: np.ndarray, cosine: float, recall: float) -> float:
        """The squared move that suffices for the wanted share of partners at just the least cosine, in random directions, around sampled vectors."""
        rng = np.random.default_rng(5)
        x = sample[rng.integers(0, len(sample), 4000)]
        e = rng.normal(size=x.shape)
        e -= (e * x).sum(1)[:, None] * x
        e /= np.maximum(np.sqrt((e * e).sum(1))[:, None], 1e-12)
        y = cosine * x + np.sqrt(1 - cosine * cosine) * e
        near, moves = self.cells(y), self.moves(x)
        need = sum(m[np.arange(len(x)), n] for m, n in zip(moves, near))
        return float(np.quantile(need, recall)) * 1.05 + 1e-9

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, first centroid, second centroids): the cells each row visits until the reach is used up."""
        first, second = self.moves(x)
        by_first, by_second = np.argsort(first, 1), np.argsort(second, 1)
        for i in range(len(x)):
            left = np.sort(second[i])
            for a in by_first[i]:
                rest = self.reach - first[i, a]
                if rest < 0:
                    break
                yield i, int(a), by_second[i, : np.searchsorted(left, rest, side="right")].astype(np.int32)


def _unit(pdf_vec) -> np.ndarray:
    """Rows of length 1 from arrays, or from the bytes of such rows in their own precision."""
    x = np.array([np.asarray(v, np.float64) for v in pdf_vec])
    # Scaled by a power of two first, which is exact, so that squares neither vanish nor overflow.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (u[i], v[i])."""
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    out = []
    for a, b in zip(u.tolist(), v.tolist()):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


class _Block:
    """The vectors of one chunk of a grid column, by second centroid, and the links found for them so far."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.ready = False

    def add(self, pdf: pd.DataFrame, kind: str) -> None:
        self.rows.append((pdf["vec_id"].to_numpy(), pdf["many"].to_numpy(), np.array([np.frombuffer(j, np.int32)[0] for j in pdf["js"]]), _unit(np.frombuffer(v, kind) for v in pdf["vec"])))

    def close(self) -> None:
        if not self.ready:
            parts = [np.concatenate(p) for p in zip(*self.rows)] if self.rows else [np.zeros(0, np.int64)] * 3 + [np.zeros((0, 1))]
            order = np.argsort(parts[2], kind="stable")
            self.ids, self.many, self.js, self.x = (p[order] for p in parts)
            self.found, self.ready = np.zeros(len(self.ids), np.int64), True

    def meet(self, pdf: pd.DataFrame, cosine: float, kind: str) -> list[tuple[int, int, int, bool]]:
        """(vector, links, other, edge): link counts of the visitors, and edges of a forest."""
        self.close()
        if not len(self.ids):
            return []
        qid, qmany, q = pdf["vec_id"].to_numpy(), pdf["many"].to_numpy(), _unit(np.frombuffer(v, kind) for v in pdf["vec"])
        js = [np.frombuffer(j, np.int32) for j in pdf["js"]]
        who, where = np.repeat(np.arange(len(js)), [len(j) for j in js]), np.concatenate(js)
        order = np.argsort(where, kind="stable")
        who, where = who[order], where[order]
        edges = np.flatnonzero(np.diff(where)) + 1
        count, us, vs = np.zeros(len(qid), np.int64), [], []
        for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(where)]])):
            a, b = np.searchsorted(self.js, [where[lo], where[lo] + 1])
            if a == b:
                continue
            at = who[lo:hi]
            i, j = np.nonzero((q[at] @ self.x[a:b].T >= cosine) & (self.ids[None, a:b] > qid[at][:, None]))
            i, j = at[i], j + a
            np.add.at(count, i, self.many[j])
            np.add.at(self.found, j, qmany[i])
            us.append(qid[i])
            vs.append(self.ids[j])
        out = [(int(a), int(n), 0, False) for a, n in zip(qid, count) if n]
        return out + [(a, 0, b, True) for a, b in _forest(np.concatenate(us), np.concatenate(vs))] if us else out

    def end(self) -> list[tuple[int, int, int, bool]]:
        self.close()
        return [(int(a), int(n), 0, False) for a, n in zip(self.ids, self.found) if n]


def _compare(cosine: float, kind: str):
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["vec_id", "links", "other", "edge"]).astype({"vec_id": "int64", "links": "int64", "other": "int64", "edge": "bool"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, _Block()
        for pdf in batches:
            for key, part in pdf.groupby(["region", "chunk"], sort=False):
                if key != at:
                    yield frame(block.end())
                    at, block = key, _Block()
                own, visitors = part[part["side"] == 0], part[part["side"] == 1]
                if len(own):
                    block.add(own, kind)
                for i in range(0, len(visitors), 2048):
                    yield frame(block.meet(visitors.iloc[i : i + 2048], cosine, kind))
        yield frame(block.end())

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = TARGET_RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    A link joins two vectors with cosine >= `cosine` in double precision. Vectors that are null, zero or hold null or
    non-finite components, or whose dimension isn't the most common one, link with nothing. Equal vectors form a class: one of them
    is indexed, all are counted. Rows with the same id are linked as rows of their own. The codebooks are fitted on at most SAMPLE classes; all are indexed.
    """
    spark = vectors.sparkSession
    # Vectors travel in their own precision; what is computed is computed in doubles.
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    array, kind = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    v = F.col(vec_col).cast(array)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("vec"))
    dim = base.where("vec IS NOT NULL").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    nothing = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if dim is None:
        return nothing
    base = base.withColumn("vec", F.when(F.size("vec") == dim["d"], F.col("vec")))
    keyed = base.withColumn("h1", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("h2", F.when(F.col("vec").isNotNull(), F.xxhash64(F.reverse("vec"), F.lit(1))))
    classes = keyed.where("vec IS NOT NULL AND vec_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("vec").alias("vec"))
    classes = materialize(classes, "embed-classes")
    n = classes.count()
    sample = classes.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toPandas()
    x = _unit(sample.sort_values("rep")["vec"])
    if x.shape[1] < 2:
        x = np.hstack([x, np.zeros((len(x), 1))])
    grid = spark.sparkContext.broadcast(Grid(x, int(np.clip(np.sqrt(n / 16), 1, 1024)), cosine, recall))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = grid.value
        for pdf in batches:
            for s in range(0, len(pdf), 1024):
                part = pdf.iloc[s : s + 1024]
                y = _unit(part["vec"])
                y = y if y.shape[1] > 1 else np.hstack([y, np.zeros((len(y), 1))])
                a, b = g.cells(y)
                ids, many, vecs = part["rep"].to_numpy(), part["many"].to_numpy(), [np.asarray(x, kind).tobytes() for x in part["vec"]]
                rows = [(int(a[i]), 0, ids[i], many[i], vecs[i], np.int32(b[i]).tobytes()) for i in range(len(part))]
                rows += [(region, 1, ids[i], many[i], vecs[i], js.tobytes()) for i, region, js in g.visits(y)]
                yield pd.DataFrame(rows, columns=["region", "side", "vec_id", "many", "vec", "js"])

    entries = classes.select("rep", "many", "vec").mapInPandas(index, "region int, side int, vec_id long, many long, vec binary, js binary")
    # A grid column that holds many vectors is cut into chunks; every visitor of the column visits all of them. At most 1024 columns: a bounded list.
    sizes = {r["region"]: r["n"] for r in classes.select("rep", "many", "vec").mapInPandas(_columns(grid), "region int, n long").groupBy("region").agg(F.sum("n").alias("n")).collect()}
    chunks = F.create_map(*[F.lit(z) for r, m in sizes.items() for z in (r, -(-m // CHUNK))])
    many_chunks = F.coalesce(F.try_element_at(chunks, F.col("region")), F.lit(1))
    own = F.array(F.pmod(F.xxhash64("vec_id"), many_chunks).cast("int"))
    entries = entries.withColumn("chunk", F.explode(F.when(F.col("side") == 0, own).otherwise(F.sequence(F.lit(0), (many_chunks - 1).cast("int")))))
    rows = entries.repartition("region", "chunk").sortWithinPartitions("region", "chunk", "side", "vec_id").select("region", "chunk", "side", "vec_id", "many", "vec", "js")
    found = materialize(rows.mapInPandas(_compare(cosine, kind), "vec_id long, links long, other long, edge boolean"), "embed-links")
    links = found.where("NOT edge").groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("edge").select(F.col("vec_id").alias("u"), F.col("other").alias("v")))
    of_class = classes.select("h1", "h2", "rep", "many").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = keyed.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _columns(grid):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = _unit(pdf["vec"])
                region, n = np.unique(grid.value.cells(y if y.shape[1] > 1 else np.hstack([y, np.zeros((len(y), 1))]))[0], return_counts=True)
                yield pd.DataFrame({"region": region.astype(np.int32), "n": n.astype(np.int64)})

    return run


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), 0.9)
