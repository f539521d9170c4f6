"""Applications: load a graph, build a solver, train, evaluate, save. `Application(type, spark, dim)` picks one by name."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import monitor
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import viz as V
from ..operators.knn import knn_graph
from ..operators.word_graph import word_graph
from ..scratch import settle
from ..sources import text as T
from ..sources import writers as W
from .solvers import GraphSolver, KnowledgeGraphSolver, VisualizationSolver

log = logging.getLogger("graphloom")


class LoadedGraph:
    """An encoded graph: names, adjacency, weights and counts; knowledge graphs also have triplets and relations."""

    def __init__(self, **tables):
        self.__dict__.update(tables)

    def info(self) -> str:
        own = {k: v for k, v in self.__dict__.items() if isinstance(v, (int, bool, str))}
        return ", ".join(f"#{k.removeprefix('num_')}: {v}" if k.startswith("num_") else f"{k}: {v}" for k, v in sorted(own.items()))


class ApplicationBase:
    solver_class = None

    def __init__(self, spark: SparkSession, dim: int, seed: int = 0):
        self.spark, self.dim, self.seed = spark, dim, seed
        self.format = T.TextFormat()
        self.graph = self.solver = None

    def set_format(self, delimiters: str = " \t\r\n", comment: str = "#") -> None:
        self.format = T.TextFormat(delimiters, comment)

    @monitor.time
    def build(self, **kwargs):
        self.solver = self.solver_class(self.spark, self.dim, self.seed).build(self.graph, **kwargs)

    @monitor.time
    def train(self, **kwargs):
        history = self.solver.train(**kwargs)
        for batch, loss in history:
            log.info("batch %d, loss %g", batch, loss)
        return history

    @monitor.time
    def evaluate(self, task: str, **kwargs):
        """Run an evaluation by name; a dict of metrics is logged in order."""
        f = getattr(self, task.replace(" ", "_"), None)
        if f is None or task.startswith("_"):
            raise ValueError(f"unknown task `{task}`")
        result = f(**kwargs)
        if isinstance(result, dict):
            for metric, value in sorted(result.items()):
                log.warning("%s: %g", metric, value)
        return result

    def tables(self) -> dict[str, DataFrame]:
        raise NotImplementedError

    def save_model(self, file_name: str, save_hyperparameter: bool = False) -> None:
        s = self.solver
        hyper = {"dim": s.dim, "model": getattr(s, "model", None), "num_negative": s.num_negative, "batch_size": s.batch_size, "optimizer": s.optimizer.type, "lr": s.optimizer.lr} if save_hyperparameter else None
        W.save_model(file_name, self.tables(), hyper)

    def _edges_graph(self, edges: DataFrame, as_undirected: bool, normalization: bool, by: str) -> LoadedGraph:
        names = settle(G.vertex_names(edges, by))
        adjacency = G.directed(G.encode(edges, names), as_undirected)
        if normalization:
            adjacency = G.normalize(adjacency)
        adjacency = settle(adjacency)
        return LoadedGraph(names=names, adjacency=adjacency, weights=settle(G.vertex_weights(adjacency)), num_vertex=names.count(), num_edge=edges.count(), as_undirected=as_undirected, normalization=normalization)


def _rows(spark, file_name, reader, frame, fmt):
    return frame if frame is not None else reader(spark, file_name, fmt=fmt)


class GraphApplication(ApplicationBase):
    """Node embedding on edge lists."""

    solver_class = GraphSolver

    def load(self, file_name: str | None = None, edge_list: list | None = None, edges: DataFrame | None = None, as_undirected: bool = True, normalization: bool = False):
        if edge_list is not None:
            edges = T.edges_from_rows(self.spark, edge_list)
        if edges is None:
            edges = T.read_edges(self.spark, file_name, self.format)
        self.graph = self._edges_graph(edges, as_undirected, normalization, "line" if "line" in edges.columns else "name")

    def tables(self):
        return {"names": self.graph.names, "vertex": self.solver.vertex_embeddings, "context": self.solver.context_embeddings}

    def load_model(self, file_name: str) -> None:
        """Take over a saved model; rows meet by name, a missing name fails."""
        self._ready()
        for mat, table in ((0, "vertex"), (1, "context")):
            self.solver.load_matrix(mat, W.load_matrix(self.spark, file_name, "names", table, self.graph.names))

    def _ready(self):
        if self.solver.state is None:
            self.solver.state, self.solver.model = settle(self.solver.init_state()), getattr(self.solver, "model", "LINE")

    def link_prediction(self, file_name: str | None = None, tests: DataFrame | None = None, filter_file: str | None = None, known: DataFrame | None = None) -> dict[str, float]:
        """AUC over labelled edges (src, dst, y) by name; rows with unknown names and filtered edges don't count."""
        rows = tests if tests is not None else T.read_test_edges(self.spark, file_name, self.format)
        maps = {"src": self.graph.names, "dst": self.graph.names}
        rows = E.name_map(rows.select("src", "dst", "y"), maps)
        if filter_file is not None:
            known = T.read_edges(self.spark, filter_file, self.format)
        if known is not None:
            known = E.name_map(known.select("src", "dst"), maps)
        return {"AUC": E.link_auc(rows, self.solver.vertex_embeddings, self.solver.context_embeddings, known).first()["auc"]}

    def node_classification(self, file_name: str | None = None, labels: DataFrame | None = None, portions=(0.02,), normalization: bool = False, times: int = 1, patience: int = 100, multi_hot: bool = False) -> dict[str, float]:
        rows = labels if labels is not None else T.read_labels(self.spark, file_name, self.format)
        rows = E.name_map(rows.select("node", "label"), {"node": self.graph.names})
        out = E.node_classification(self.solver.vertex_embeddings, rows, tuple(portions), normalization, times, patience, self.seed, multi_hot)
        means = out.groupBy("portion").agg(F.avg("macro_f1").alias("macro"), F.avg("micro_f1").alias("micro")).collect()  # a row a portion
        return {f"{kind}-F1@{r['portion'] * 100:g}%": r[kind] for r in means for kind in ("macro", "micro")}


class WordGraphApplication(GraphApplication):
    """Node embedding on word co-occurrence graphs."""

    def load(self, file_name: str | None = None, corpus: DataFrame | None = None, window: int = 5, min_count: int = 5, normalization: bool = False):
        rows = corpus if corpus is not None else T.read_corpus(self.spark, file_name, self.format)
        edges = settle(word_graph(rows, window, min_count))
        self.graph = self._edges_graph(edges, False, normalization, "name")


class KnowledgeGraphApplication(ApplicationBase):
    """Knowledge graph embedding on triplets."""

    solver_class = KnowledgeGraphSolver

    def load(self, file_name: str | None = None, triplet_list: list | None = None, triplets: DataFrame | None = None, normalization: bool = False):
        if triplet_list is not None:
            triplets = T.triplets_from_rows(self.spark, triplet_list)
        if triplets is None:
            triplets = T.read_triplets(self.spark, file_name, self.format)
        if "weight" not in triplets.columns:
            triplets = triplets.withColumn("weight", F.lit(1.0))
        entities, relations = (settle(d) for d in G.kg_names(triplets))
        encoded = G.encode_triplets(triplets.select("h", "r", "t", "weight"), entities, relations)
        encoded = settle(G.kg_normalize(encoded) if normalization else encoded.select("h", "r", "t", "weight"))
        weights = entities.select("id", F.lit(1.0).alias("weight"))
        self.graph = LoadedGraph(entities=entities, relations=relations, triplets=encoded, weights=weights, num_vertex=entities.count(), num_relation=relations.count(), num_edge=encoded.count(), normalization=normalization)

    def tables(self):
        return {"entities": self.graph.entities, "relations": self.graph.relations, "entity": self.solver.entity_embeddings, "relation": self.solver.relation_embeddings}

    def load_model(self, file_name: str, model: str = "RotatE", margin: float = 12.0) -> None:
        from ..operators.kernels import Settings

        s = self.solver
        if s.state is None:
            s.settings, s.model, s.margin = Settings(model=model, margin=margin), model, margin
            s.state = settle(s.init_state())
        s.load_matrix(0, W.load_matrix(self.spark, file_name, "entities", "entity", self.graph.entities))
        s.load_matrix(1, W.load_matrix(self.spark, file_name, "relations", "relation", self.graph.relations))

    def _maps(self):
        return {"h": self.graph.entities, "t": self.graph.entities, "r": self.graph.relations}

    def link_prediction(self, file_name: str | None = None, tests: DataFrame | None = None, filter_files: list[str] | None = None, known: DataFrame | None = None, target: str = "both", fast_mode: int | None = None) -> dict[str, float]:
        """Filtered MR, MRR and HITS of test triplets by name."""
        rows = tests if tests is not None else T.read_triplets(self.spark, file_name, self.format)
        rows = settle(E.name_map(rows.select("h", "r", "t"), self._maps()).withColumn("q", F.monotonically_increasing_id()))
        if fast_mode:
            rows = E.fast_mode(rows, fast_mode, self.seed)
        for f in filter_files or []:
            part = T.read_triplets(self.spark, f, self.format)
            known = part if known is None else known.select("h", "r", "t").unionByName(part.select("h", "r", "t"))
        known = E.name_map(known.select("h", "r", "t"), self._maps()) if known is not None else rows.limit(0)
        ranks = E.filtered_ranks(rows, known, self.solver.model, self.solver.entity_embeddings, self.solver.relation_embeddings, target, self.solver.margin)
        m = E.ranking_metrics(ranks).first()
        return {"MR": m["mr"], "MRR": m["mrr"], "HITS@1": m["hits_1"], "HITS@3": m["hits_3"], "HITS@10": m["hits_10"]}

    def entity_prediction(self, file_name: str | None = None, queries: DataFrame | None = None, target: str = "tail", k: int = 10, save_file: str | None = None):
        """The k best entities a query, as (q, rank, entity name, score), or written to save_file. Unknown names fail."""
        rows = queries if queries is not None else T.read_queries(self.spark, file_name, target, self.format)
        if "h" not in rows.columns:
            target, rows = "head", rows.withColumn("h", F.lit(None).cast("string"))
        if "t" not in rows.columns:
            target, rows = "tail", rows.withColumn("t", F.lit(None).cast("string"))
        given, other = ("t", "h") if target == "head" else ("h", "t")
        rows = E.get_mapping(E.get_mapping(rows, given, self.graph.entities), "r", self.graph.relations)
        order = "line" if "line" in rows.columns else "q"
        rows = rows.withColumn("q", F.col(order)).withColumn(other, F.lit(None).cast("long")).select("q", "h", "r", "t")
        out = E.entity_prediction(rows, self.solver.model, self.solver.entity_embeddings, self.solver.relation_embeddings, target, k, self.solver.margin)
        if save_file:
            return W.save_predictions(out, self.graph.entities, save_file)
        return out.join(self.graph.entities.select(F.col("id").alias("entity"), "name"), "entity").select("q", "rank", F.col("name").alias("entity"), "score")


class VisualizationApplication(ApplicationBase):
    """Layouts of graphs and of high-dimensional vectors."""

    solver_class = VisualizationSolver

    def load(self, file_name: str | None = None, edge_list: list | None = None, edges: DataFrame | None = None, vector_file: str | None = None, vectors: DataFrame | None = None, num_neighbor: int = 200, perplexity: float = 30, vector_normalization: bool = True, as_undirected: bool = True, normalization: bool = False):
        if edge_list is not None:
            edges = T.edges_from_rows(self.spark, edge_list)
        if file_name is not None:
            edges = T.read_edges(self.spark, file_name, self.format)
        if edges is not None:
            self.graph = self._edges_graph(edges, as_undirected, normalization, "line" if "line" in edges.columns else "name")
            return
        rows = vectors if vectors is not None else T.read_vector_file(self.spark, vector_file, self.format)
        adjacency = settle(knn_graph(rows, num_neighbor, perplexity, vector_normalization))
        ids = rows.select("id")
        self.graph = LoadedGraph(names=ids.select(F.col("id").cast("string").alias("name"), "id"), adjacency=adjacency, weights=ids.select("id", F.lit(1.0).alias("weight")), num_vertex=ids.count(), num_edge=adjacency.count())

    def tables(self):
        return {"names": self.graph.names, "coordinates": self.solver.coordinates}

    def load_model(self, file_name: str) -> None:
        """Rows meet by position."""
        if self.solver.state is None:
            self.solver.state = settle(self.solver.init_state())
        self.solver.load_matrix(0, self.spark.read.parquet(os.path.join(file_name, "coordinates")))

    def _points(self) -> DataFrame:
        return V.coordinates(self.solver.coordinates)

    def _labels(self, file_name, labels) -> DataFrame:
        if labels is not None:
            return labels
        if file_name is None:
            return self.graph.names.select("id", F.lit("").alias("label"))
        return T.read_point_labels(self.spark, file_name, self.format).select("id", F.element_at("path", 1).alias("label"))

    def visualization(self, file_name: str | None = None, labels: DataFrame | None = None, save_file: str | None = None, figure_size: int = 10, scale: float = 2) -> DataFrame:
        points = V.scatter_points(self._points(), self._labels(file_name, labels))
        if save_file:
            V.write_svg(points, save_file, size=80 * figure_size, radius=scale)
        return points

    def hierarchy(self, target: str, file_name: str | None = None, paths: DataFrame | None = None, save_file: str | None = None, figure_size: int = 10, scale: float = 2, duration: float = 3) -> DataFrame:
        """(depth, id, class, x, y): frames that zoom to a target; with save_file, a figure a depth (`name-depth.svg`)."""
        rows = paths if paths is not None else T.read_point_labels(self.spark, file_name, self.format)
        points = self._points()
        axes = [c for c in points.columns if c in "xyz"]
        frames = V.hierarchy_frames(rows, target).join(E.within_deviations(points, axes), "id")
        if save_file:
            base, ext = os.path.splitext(save_file)
            for d in range((frames.agg(F.max("depth")).first()[0] or 0) + 1):
                V.write_svg(frames.where(F.col("depth") == d), f"{base}-{d}{ext or '.svg'}", label="class", size=80 * figure_size, radius=scale)
        return frames

    def animation(self, file_name: str | None = None, labels: DataFrame | None = None, save_file: str | None = None, figure_size: int = 5, scale: float = 1, elevation: float = 30, num_frame: int = 700) -> DataFrame:
        """(frame, id, u, v, label): a turn around the vertical axis; with save_file, a figure of each frame (`name-frame.svg`)."""
        points = V.scatter_points(self._points(), self._labels(file_name, labels))
        frames = V.rotation_frames(points.drop("label"), num_frame, elevation).join(points.select("id", "label"), "id")
        if save_file:
            base, ext = os.path.splitext(save_file)
            for f in range(num_frame):
                V.write_svg(frames.where(F.col("frame") == f), f"{base}-{f:04d}{ext or '.svg'}", "u", "v", size=80 * figure_size, radius=scale)
        return frames


APPLICATIONS = {"graph": GraphApplication, "word graph": WordGraphApplication, "knowledge graph": KnowledgeGraphApplication, "visualization": VisualizationApplication}


def Application(type: str, spark: SparkSession, dim: int, **kwargs):  # noqa: N802
    """An application by the name of its type."""
    if type not in APPLICATIONS:
        raise ValueError(f"unknown application `{type}`: {', '.join(APPLICATIONS)} are known")
    return APPLICATIONS[type](spark, dim, **kwargs)
