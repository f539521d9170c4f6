"""Solvers: partitioned embedding tables trained by a schedule of Spark jobs.

Vertices are dealt to P parts by weight. A round is a set of blocks (head part, tail part) in which no part occurs twice, so its workers
never write the same row; one grouped job trains a round, and the state is checkpointed after it. Relations are
global: every worker trains a copy, and the copies' changes are summed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import auto_augmentation_step, draw
from ..functions.optim import Optimizer
from ..functions.scores import MODELS
from ..operators import graph as G
from ..operators import sampling as R
from ..operators.evaluate import predict
from ..operators.kernels import Settings, kg_step, node_step, vis_step
from ..scratch import settle

PART_BYTES = 256 << 20
STATE = "mat int, part int, id long, weight double, vec array<double>, m1 array<double>, m2 array<double>"


def schedule(parts: int, tied: bool) -> list[list[tuple[int, int]]]:
    """Rounds of blocks that cover all parts x parts once, with no part twice in a round.

    Untied (heads and tails are different tables): a Latin square. Tied: the diagonal first, then the rounds of a round-robin tournament; there a
    worker trains (a, b) and (b, a).
    """
    if not tied:
        return [[(i, (i + r) % parts) for i in range(parts)] for r in range(parts)]
    rounds = [[(i, i) for i in range(parts)]]
    ring = list(range(parts)) + ([-1] if parts % 2 else [])
    for _ in range(len(ring) - 1 if parts > 1 else 0):
        rounds.append([(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :])) if a >= 0 and b >= 0])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


class Solver:
    """State and loop shared by all solvers."""

    tied = True
    default_optimizer = Optimizer("SGD", 1e-4)
    default_negative = 1

    def __init__(self, spark: SparkSession, dim: int, seed: int = 0):
        self.spark, self.dim, self.seed = spark, dim, seed
        self.state: DataFrame | None = None
        self.history: list[tuple[int, float]] = []
        self.batch_id = 0

    # -- build --------------------------------------------------------------------------------------------------------
    def build(self, graph: "object", optimizer=None, num_partition="auto", num_negative="auto", batch_size: int = 100_000, episode_size="auto", minibatch="auto"):
        """Fix parameters and deal vertices to parts. graph has edges, weights (id, weight), num_vertex and num_edge.

        Samples of a minibatch step together and their steps for one row add up, so a minibatch should touch a row a few times at most: by default it
        grows with the vertices a worker holds.
        """
        self.graph = graph
        self.optimizer = Optimizer.make(optimizer, self.default_optimizer)
        self.num_negative = self.default_negative if num_negative in (None, "auto") else int(num_negative)
        if self.num_negative < 1 or batch_size < 1 or (minibatch not in (None, "auto") and minibatch < 1):
            raise ValueError("num_negative, batch_size and minibatch must be positive")
        row = 8 * self.dim * (1 + self.optimizer.n_moments)
        need = max(1, math.ceil(graph.num_vertex * row / PART_BYTES))
        self.num_partition = max(need, 1) if num_partition in (None, "auto") else int(num_partition)
        if self.num_partition < 1:
            raise ValueError("num_partition must be positive")
        held = graph.num_vertex // self.num_partition
        self.batch_size, self.minibatch = batch_size, int(np.clip(held // 2, 16, 1024)) if minibatch in (None, "auto") else int(minibatch)
        self.episode_size = max(1, min(100, math.ceil(graph.num_edge / batch_size))) if episode_size in (None, "auto") else int(episode_size)
        self.parts = settle(G.zigzag_partition(graph.weights, self.num_partition)) if self.num_partition > 1 else graph.weights.withColumn("part", F.lit(0))
        self.state, self.batch_id, self.history = None, 0, []
        return self

    def uniform(self, ids: DataFrame, mat: int, bound: float, used: int | None = None) -> DataFrame:
        """State rows with components uniform in (-bound, bound), a function of seed and id; components from `used` on are 0."""
        used = self.dim if used is None else used
        at = lambda i: draw(F.col("id") * self.dim + i, mat, self.seed)
        v = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.when(i < used, (at(i) * 2 - 1) * F.lit(float(bound))).otherwise(F.lit(0.0)))
        return self._rows(ids, mat, v)

    def _rows(self, ids: DataFrame, mat: int, v) -> DataFrame:
        zero = F.array_repeat(F.lit(0.0), self.dim)
        none = F.lit(None).cast("array<double>")
        n = self.optimizer.n_moments
        return ids.select(F.lit(mat).alias("mat"), "part", "id", "weight", v.alias("vec"), (zero if n > 0 else none).alias("m1"), (zero if n > 1 else none).alias("m2"))

    def matrix(self, mat: int) -> DataFrame:
        """(id, vec) of one table of the state."""
        return self.state.where(F.col("mat") == mat).select("id", "vec")

    def load_matrix(self, mat: int, rows: DataFrame) -> None:
        """Take over vectors (id, vec) for one table; moments stay."""
        new = rows.select("id", F.col("vec").cast("array<double>").alias("__new"))
        own = self.state.where(F.col("mat") == mat).join(new, "id", "left").withColumn("vec", F.coalesce("__new", "vec")).drop("__new")
        self.state = settle(self.state.where(F.col("mat") != mat).unionByName(own.select(*self.state.columns)))

    # -- train --------------------------------------------------------------------------------------------------------
    def init_state(self) -> DataFrame:
        raise NotImplementedError

    def samples(self, n: int, episode: int) -> DataFrame:
        """(ord, a, b, c): n positive samples; c is the relation, or null."""
        raise NotImplementedError

    def kernel(self, tables: dict[int, tuple], a, b, c, rng, lr: float) -> float:
        raise NotImplementedError

    def _loop(self, num_epoch: float, resume: bool, settings: Settings, positive_reuse: int = 1) -> list[tuple[int, float]]:
        self.settings, self.positive_reuse = settings, positive_reuse
        MODELS[settings.model].check(self.dim)
        if not resume or self.state is None:
            self.batch_id, self.history = 0, []
            self.state = settle(self.init_state())
        goal = self.batch_id + max(1, math.ceil(num_epoch * self.graph.num_edge / self.batch_size))
        while self.batch_id < goal:
            n = min(self.episode_size, goal - self.batch_id)
            wanted = max(1, n * self.batch_size // positive_reuse)
            drawn = self.samples(wanted, self.batch_id)
            part = self.parts.select(F.col("id").alias("__id"), F.col("part").alias("__part"))
            drawn = drawn.join(part, F.col("a") == F.col("__id")).drop("__id").withColumnRenamed("__part", "hp").join(part, F.col("b") == F.col("__id")).drop("__id").withColumnRenamed("__part", "tp")
            drawn = settle(drawn) if self.num_partition > 1 else drawn
            losses = [self._round(drawn, blocks, k, goal) for k, blocks in enumerate(schedule(self.num_partition, self.tied))]
            self.batch_id += n
            total = sum(m for _, m in losses)
            self.history.append((self.batch_id, sum(x * m for x, m in losses) / total if total else float("nan")))
        return self.history

    def _round(self, drawn: DataFrame, blocks: list[tuple[int, int]], k: int, goal: int) -> tuple[float, int]:
        head, tail = {a: i for i, (a, _) in enumerate(blocks)}, {b: i for i, (_, b) in enumerate(blocks)}
        of = lambda m: F.try_element_at(F.create_map(*[F.lit(z) for kv in m.items() for z in kv]), F.col("part"))
        if self.tied:
            both = head | tail
            own = self.state.where("mat = 0").withColumn("worker", of(both))
            shared = self.state.where("mat = 1").withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))
        else:
            own = self.state.withColumn("worker", F.when(F.col("mat") == 0, of(head)).otherwise(of(tail)))
            shared = None
        idle = own.where("worker IS NULL").drop("worker")
        busy = own.where("worker IS NOT NULL")
        cols = ["worker", "mat", "part", "id", "weight", "vec", "m1", "m2", "a", "b", "c"]
        none = lambda df: df.select("worker", "mat", "part", "id", "weight", "vec", "m1", "m2", *[F.lit(None).cast("long").alias(c) for c in "abc"])
        pair = F.create_map(*[F.lit(z) for i, (a, b) in enumerate(blocks) for z in (f"{a}-{b}", i)])
        name = F.concat_ws("-", F.least("hp", "tp"), F.greatest("hp", "tp")) if self.tied else F.concat_ws("-", "hp", "tp")
        s = drawn.withColumn("worker", F.try_element_at(pair, name)).where("worker IS NOT NULL")
        empty = F.lit(None).cast("array<double>")
        s = s.select("worker", F.lit(-1).alias("mat"), F.lit(None).cast("int").alias("part"), F.col("ord").alias("id"), F.lit(None).cast("double").alias("weight"), empty.alias("vec"), empty.alias("m1"), empty.alias("m2"), "a", "b", "c")
        rows = none(busy).unionByName(s.select(*cols))
        if shared is not None:
            rows = rows.unionByName(none(shared))
        out = settle(rows.groupBy("worker").applyInPandas(self._worker(k, goal), f"worker int, {STATE}"))
        loss = out.where("mat = -1").agg(F.sum(F.col("weight") * F.col("id")), F.sum("id")).first()
        new = out.where("mat = 0" if self.tied else "mat >= 0").drop("worker").unionByName(idle)
        if shared is not None:
            new = new.unionByName(self._summed(out.where("mat = 1")))
        self.state = settle(new)
        return (float(loss[0] / loss[1]), int(loss[1])) if loss[1] else (0.0, 0)

    def _summed(self, copies: DataFrame) -> DataFrame:
        """Global rows: what they were plus the sum of all workers' changes; moments are averaged."""
        old = self.state.where("mat = 1")
        long = copies.select("id", F.posexplode(F.arrays_zip("vec", F.coalesce("m1", "vec").alias("m1"), F.coalesce("m2", "vec").alias("m2"))).alias("i", "x"))
        by = long.groupBy("id", "i").agg(F.sum("x.vec").alias("v"), F.avg("x.m1").alias("p"), F.avg("x.m2").alias("q"), F.count("*").alias("n"))
        rows = by.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "v", "p", "q", "n"))).alias("z"))
        both = old.join(rows, "id", "left")
        vec = F.zip_with("vec", "z", lambda o, z: o + z["v"] - z["n"] * o)
        m = self.optimizer.n_moments
        return both.select("mat", "part", "id", "weight", F.when(F.col("z").isNull(), F.col("vec")).otherwise(vec).alias("vec"), (F.transform("z", lambda z: z["p"]) if m > 0 else F.col("m1")).alias("m1"), (F.transform("z", lambda z: z["q"]) if m > 1 else F.col("m2")).alias("m2"))

    def _worker(self, k: int, goal: int):
        # Only plain values travel with the closure, never the solver with its session.
        kernel, settings, opt, minibatch, reuse, negatives, seed = type(self).kernel, self.settings, self.optimizer, self.minibatch, self.positive_reuse, self.num_negative, self.seed
        batch_id, batch_size = self.batch_id, self.batch_size

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            worker = int(pdf["worker"].iloc[0])
            tables, meta = {}, {}
            for mat, part in pdf[pdf["mat"] >= 0].groupby("mat"):
                part = part.sort_values("id")
                grab = lambda c: np.array(part[c].to_list(), float)  # noqa: B023, E731
                moments = [grab(c) for c in ("m1", "m2")[: opt.n_moments]]
                tables[mat] = (part["id"].to_numpy(np.int64), part["weight"].to_numpy(float), grab("vec"), moments)
                meta[mat] = part
            s = pdf[pdf["mat"] == -1].sort_values("id")
            rng = np.random.default_rng([seed, batch_id, k, worker])
            a, b, c = (s[x].to_numpy() for x in "abc")
            loss, n = 0.0, 0
            for _ in range(reuse):
                order = rng.permutation(len(s))
                for i in range(0, len(order), minibatch):
                    at = order[i : i + minibatch]
                    lr = opt.rate(batch_id + (i // batch_size), goal)
                    rel = c[at].astype(np.int64) if 1 in tables and not pd.isna(c[at]).all() else None
                    loss += kernel(settings, opt, negatives, tables, a[at].astype(np.int64), b[at].astype(np.int64), rel, rng, lr) * len(at)
                    n += len(at)
            out = []
            for mat, (_, _, vec, moments) in tables.items():
                m = meta[mat]
                out.append(pd.DataFrame({"worker": worker, "mat": mat, "part": m["part"].to_numpy(), "id": m["id"].to_numpy(), "weight": m["weight"].to_numpy(), "vec": list(vec), "m1": list(moments[0]) if moments else None, "m2": list(moments[1]) if len(moments) > 1 else None}))
            out.append(pd.DataFrame({"worker": [worker], "mat": [-1], "part": [0], "id": [n], "weight": [loss / n if n else 0.0], "vec": [None], "m1": [None], "m2": [None]}))
            return pd.concat(out)

        return run

    def info(self) -> str:
        """A report of resources, sampling and training."""
        lines = [f"<{type(self).__name__}>", f"#vertex: {self.graph.num_vertex}, #edge: {self.graph.num_edge}, dim: {self.dim}", f"#partition: {self.num_partition}, tied weights: {'yes' if self.tied else 'no'}", f"#negative: {self.num_negative}, batch size: {self.batch_size}, episode size: {self.episode_size}", f"optimizer: {self.optimizer.type}, learning rate: {self.optimizer.lr:g}, weight decay: {self.optimizer.weight_decay:g}", f"memory a partition: {self.memory_demand() >> 20} MiB"]
        return "\n".join(lines)

    def memory_demand(self) -> int:
        """Bytes of embeddings and moments that one worker holds."""
        return 2 * math.ceil(self.graph.num_vertex / self.num_partition) * self.dim * 8 * (1 + self.optimizer.n_moments)


def _index(table: tuple, ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(table[0], ids)


def _weighted(rng, weights: np.ndarray, exponent: float, shape) -> np.ndarray:
    c = np.cumsum(np.power(np.maximum(weights, 0), exponent))
    if c[-1] <= 0:
        return rng.integers(0, len(weights), shape)
    return np.minimum(np.searchsorted(c, rng.random(shape) * c[-1], side="right"), len(weights) - 1)


class GraphSolver(Solver):
    """DeepWalk, LINE and node2vec: vertex and context tables."""

    tied = False
    default_optimizer = Optimizer("SGD", 0.025, 5e-3)

    def init_state(self) -> DataFrame:
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return self.uniform(self.parts, 0, 0.5 / self.dim).unionByName(self._rows(self.parts, 1, zero))

    def train(self, model: str = "LINE", num_epoch: float = 2000, resume: bool = False, augmentation_step="auto", random_walk_length: int = 40, random_walk_batch_size: int = 100, shuffle_base="auto", p: float = 1, q: float = 1, positive_reuse: int = 1, negative_sample_exponent: float = 0.75, negative_weight: float = 5, log_frequency: int = 1000):
        """Train; with an augmentation step of 1 positives are edges, else pairs along random walks. Shuffling and walk batches are left to Spark."""
        if model not in ("LINE", "DeepWalk", "node2vec"):
            raise ValueError(f"unknown model `{model}` for node embedding")
        step = augmentation_step
        if step in (None, "auto"):
            step = auto_augmentation_step(self.graph.num_edge, self.graph.num_vertex)
            step = min(step, random_walk_length)
        if not 1 <= step <= random_walk_length:
            raise ValueError("augmentation_step must lie between 1 and random_walk_length")
        self.model, self.walk = model, (step, random_walk_length, p, q)
        return self._loop(num_epoch, resume, Settings(model=model, negative_weight=negative_weight, margin=negative_sample_exponent), positive_reuse)

    def samples(self, n: int, episode: int) -> DataFrame:
        step, length, p, q = self.walk
        seed = self.seed + episode
        adjacency = self.graph.adjacency
        if step == 1:
            drawn = R.positive_edges(adjacency, n, seed)
            return drawn.select(F.col("draw").alias("ord"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("long").alias("c"))
        walks = max(1, math.ceil(n / (length * step)))
        paths = R.biased_walks(adjacency, walks, length, p, q, seed) if self.model == "node2vec" else R.random_walks(adjacency, walks, length, seed)
        pairs = R.augmented_pairs(paths, step)
        return pairs.select((F.col("walk") * (1 << 20) + F.col("pos") * 1024 + F.col("k")).alias("ord"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("long").alias("c"))

    @staticmethod
    def kernel(s: Settings, opt, negatives, tables, a, b, c, rng, lr) -> float:
        v, ctx = tables[0], tables[1]
        neg = _weighted(rng, ctx[1], s.margin, (len(a), negatives))  # for node models the settings' margin holds the sampling exponent
        return node_step(v[2], ctx[2], [v[3], ctx[3]], _index(v, a), _index(ctx, b), neg, opt, lr, s)

    @property
    def vertex_embeddings(self) -> DataFrame:
        return self.matrix(0)

    @property
    def context_embeddings(self) -> DataFrame:
        return self.matrix(1)

    def predict(self, samples: DataFrame) -> DataFrame:
        """samples (ord, src, dst) with their logits."""
        return predict(samples, self.model, self.vertex_embeddings, self.context_embeddings)


class KnowledgeGraphSolver(Solver):
    """TransE, RotatE, DistMult, ComplEx, SimplE and QuatE: an entity table, and a relation table that all workers share."""

    default_optimizer = Optimizer("Adam", 5e-5, 0.0)
    default_negative = 64

    def init_state(self) -> DataFrame:
        s, rels = self.settings, self.graph.relations.select("id", F.lit(0).alias("part"), F.lit(0.0).alias("weight"))
        if s.model == "TransE":
            return self.uniform(self.parts, 0, s.margin / self.dim).unionByName(self.uniform(rels, 1, s.margin / self.dim))
        if s.model == "RotatE":
            return self.uniform(self.parts, 0, 2 * s.margin / self.dim).unionByName(self.uniform(rels, 1, math.pi, self.dim // 2))
        if s.model == "QuatE":
            return self._quaternions(self.parts, 0).unionByName(self._quaternions(rels, 1))
        return self.uniform(self.parts, 0, 0.5).unionByName(self.uniform(rels, 1, 0.5))

    def _quaternions(self, ids: DataFrame, mat: int) -> DataFrame:
        """Quaternions in polar form: a modulus of He scale, a phase, and a random direction of the imaginary part."""
        bound = 1 / math.sqrt(2 * self.dim)
        at = lambda g, k: draw(F.col("id") * self.dim + g * 4 + k, mat, self.seed)

        def group(g):
            modulus, phase = (at(g, 0) * 2 - 1) * F.lit(bound), (at(g, 1) * 2 - 1) * F.lit(math.pi)
            polar, z = at(g, 2) * F.lit(2 * math.pi), at(g, 3) * 2 - 1
            flat = F.sqrt(1 - z * z)
            return F.array(modulus * F.cos(phase), modulus * F.sin(phase) * flat * F.cos(polar), modulus * F.sin(phase) * flat * F.sin(polar), modulus * F.sin(phase) * z)

        return self._rows(ids, mat, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(self.dim // 4 - 1)), group)))

    def train(self, model: str = "RotatE", num_epoch: float = 2000, resume: bool = False, relation_lr_multiplier: float = 1, margin: float = 12, l3_regularization: float = 2e-3, sample_batch_size: int = 2000, positive_reuse: int = 1, adversarial_temperature: float = 2, log_frequency: int = 100):
        if model not in MODELS or not MODELS[model].relational:
            raise ValueError(f"unknown model `{model}` for knowledge graphs")
        self.model, self.margin = model, margin
        l3 = 0.0 if MODELS[model].uses_margin else l3_regularization
        return self._loop(num_epoch, resume, Settings(model=model, margin=margin, l3_regularization=l3, adversarial_temperature=adversarial_temperature, relation_lr_multiplier=relation_lr_multiplier), positive_reuse)

    def samples(self, n: int, episode: int) -> DataFrame:
        merged = self.graph.triplets.groupBy("h", "r", "t").agg(F.sum("weight").alias("weight"))
        drawn = R.weighted_draws(merged, "weight", ["h", "r", "t"], n, self.seed + episode)
        return drawn.select(F.col("draw").alias("ord"), F.col("h").alias("a"), F.col("t").alias("b"), F.col("r").alias("c"))

    @staticmethod
    def kernel(s: Settings, opt, negatives, tables, a, b, c, rng, lr) -> float:
        e, rel = tables[0], tables[1]
        h, t, r = _index(e, a), _index(e, b), _index(rel, c)
        drawn, heads = rng.integers(0, len(e[0]), (len(a), negatives)), rng.random((len(a), negatives)) < 0.5
        nh, nt = np.where(heads, drawn, h[:, None]), np.where(heads, t[:, None], drawn)
        return kg_step(e[2], rel[2], [e[3], rel[3]], h, r, t, nh, nt, opt, lr, s)

    @property
    def entity_embeddings(self) -> DataFrame:
        return self.matrix(0)

    @property
    def relation_embeddings(self) -> DataFrame:
        return self.matrix(1)

    def predict(self, samples: DataFrame) -> DataFrame:
        """samples (ord, src, dst, rel) with their logits."""
        return predict(samples, self.model, self.entity_embeddings, self.entity_embeddings, self.relation_embeddings, self.margin)


class VisualizationSolver(Solver):
    """LargeVis: one table of coordinates for both ends."""

    default_optimizer = Optimizer("Adam", 0.5, 1e-5)
    default_negative = 5

    def init_state(self) -> DataFrame:
        return self.uniform(self.parts, 0, 5e-5 / self.dim)

    def train(self, model: str = "LargeVis", num_epoch: float = 50, resume: bool = False, sample_batch_size: int = 2000, positive_reuse: int = 5, negative_sample_exponent: float = 0.75, negative_weight: float = 3, log_frequency: int = 1000):
        if model != "LargeVis":
            raise ValueError(f"unknown model `{model}` for visualization")
        self.model = model
        return self._loop(num_epoch, resume, Settings(model=model, negative_weight=negative_weight, margin=negative_sample_exponent), positive_reuse)

    def samples(self, n: int, episode: int) -> DataFrame:
        drawn = R.positive_edges(self.graph.adjacency, n, self.seed + episode)
        return drawn.select(F.col("draw").alias("ord"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("long").alias("c"))

    @staticmethod
    def kernel(s: Settings, opt, negatives, tables, a, b, c, rng, lr) -> float:
        x = tables[0]
        neg = _weighted(rng, x[1], s.margin, (len(a), negatives))
        return vis_step(x[2], [x[3]], _index(x, a), _index(x, b), neg, opt, lr, s)

    @property
    def coordinates(self) -> DataFrame:
        return self.matrix(0)

    def predict(self, samples: DataFrame) -> DataFrame:
        raise NotImplementedError("a layout predicts no edges")
