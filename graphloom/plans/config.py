"""Experiment files: application / resource / format / graph / build / load / train / evaluate / save, and global settings."""

from __future__ import annotations

import copy
import logging
import os
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.optim import Optimizer
from ..sources.datasets import Registry
from .applications import Application

SECTIONS = ("application", "resource", "format", "graph", "build", "load", "train", "evaluate", "save")
DEFAULTS = {"dataset_path": os.path.expanduser("~/.graphloom/dataset"), "float_type": "float64", "index_type": "int64", "backend": "spark"}

#: Templates of experiment files, one an application.
TEMPLATES = {
    "graph": {"application": "graph", "resource": {"dim": 128}, "graph": {"file_name": "edges.txt", "as_undirected": True}, "build": {"optimizer": {"type": "SGD", "lr": 0.025, "weight_decay": 0.005}, "num_partition": "auto", "num_negative": 1, "batch_size": 100000, "episode_size": "auto"}, "train": {"model": "LINE", "num_epoch": 2000, "negative_weight": 5, "augmentation_step": "auto", "random_walk_length": 40}, "evaluate": [{"task": "link prediction", "file_name": "test.txt"}], "save": {"file_name": "model"}},
    "word graph": {"application": "word graph", "resource": {"dim": 128}, "graph": {"file_name": "corpus.txt", "window": 5, "min_count": 5}, "build": {"optimizer": "auto"}, "train": {"model": "LINE", "num_epoch": 80, "augmentation_step": 1}, "save": {"file_name": "model"}},
    "knowledge graph": {"application": "knowledge graph", "resource": {"dim": 512}, "graph": {"file_name": "<math.train>"}, "build": {"optimizer": {"type": "Adam", "lr": 0.005, "weight_decay": 0}, "num_negative": 8}, "train": {"model": "RotatE", "num_epoch": 2000, "margin": 9, "adversarial_temperature": 2}, "evaluate": [{"task": "link prediction", "file_name": "<math.test>", "filter_files": ["<math.train>", "<math.valid>", "<math.test>"], "target": "tail"}], "save": {"file_name": "model"}},
    "visualization": {"application": "visualization", "resource": {"dim": 2}, "graph": {"vector_file": "vectors.npy", "num_neighbor": 200, "perplexity": 30}, "build": {"optimizer": "auto"}, "train": {"model": "LargeVis", "num_epoch": 50}, "evaluate": [{"task": "visualization", "save_file": "figure.svg"}]},
}


def _kg(data: str, model: str, dim: int, kind: str, lr: float, epochs: int, **train) -> dict:
    return {"application": "knowledge graph", "resource": {"dim": dim}, "graph": {"file_name": f"<{data}.train>", **({"normalization": True} if data == "wikidata5m" else {})}, "build": {"optimizer": {"type": kind, "lr": lr, "weight_decay": 0}, "num_negative": 64}, "train": {"model": model, "num_epoch": epochs, **train}, "evaluate": [{"task": "link prediction", "file_name": f"<{data}.test>", "filter_files": [f"<{data}.{s}>" for s in ("train", "valid", "test")]}]}


def _node(data: str, model: str, dim: int, epochs: int, step: int, task: str = "node classification", split: str = "graph", **train) -> dict:
    check = {"task": task, "file_name": f"<{data}.label>", "portions": [0.01 * i for i in range(1, 11)], "times": 5} if task == "node classification" else {"task": task, "file_name": f"<{data}.pld_test>"}
    return {"application": "graph", "resource": {"dim": dim}, "graph": {"file_name": f"<{data}.{split}>", "as_undirected": True}, "build": {"optimizer": {"type": "SGD", "lr": 0.025, "weight_decay": 0.005}, "num_negative": 1}, "train": {"model": model, "num_epoch": epochs, "augmentation_step": step, "random_walk_length": 40, "negative_weight": 5, **train}, "evaluate": [check]}


def baselines() -> dict[str, dict]:
    """Bundled experiments by path-like name, with published hyper-parameters."""
    out = {
        "demo/math": TEMPLATES["knowledge graph"],
        "demo/quick_start": {**_node("blogcatalog", "LINE", 128, 2000, 2, split="train"), "evaluate": [{"task": "link prediction", "file_name": "<blogcatalog.test>", "filter_file": "<blogcatalog.train>"}, {"task": "node classification", "file_name": "<blogcatalog.label>", "portions": [0.2], "times": 1}]},
        "word_graph/line_wikipedia": {**TEMPLATES["word graph"], "graph": {"file_name": "<wikipedia.graph>", "window": 5, "min_count": 5}},
        "graph/node2vec_youtube": _node("youtube", "node2vec", 128, 4000, 5, p=4, q=2),
    }
    for model in ("DeepWalk", "LINE"):
        name = model.lower()
        out[f"graph/{name}_youtube"] = _node("youtube", model, 128, 4000, 5)
        out[f"graph/{name}_flickr"] = _node("flickr", model, 128, 2000, 1)
        out[f"graph/{name}_friendster-small"] = _node("friendster", model, 128, 2000, 1, split="small_graph")
        out[f"graph/{name}_friendster"] = _node("friendster", model, 96, 2000, 2)
        out[f"graph/{name}_hyperlink-pld"] = _node("hyperlink2012", model, 128, 2000, 2, "link prediction", "pld_train")
    for size, (perplexity, task) in {"mnist_2d": (20, "visualization"), "mnist_3d": (20, "animation"), "imagenet": (50, "hierarchy")}.items():
        out[f"visualization/largevis_{size}"] = {"application": "visualization", "resource": {"dim": 3 if size.endswith("3d") else 2}, "graph": {"vector_file": "<imagenet.train_feature_data>" if size == "imagenet" else "<mnist.train_image_data>", "num_neighbor": 200, "perplexity": perplexity}, "build": {"optimizer": {"type": "Adam", "lr": 0.5, "weight_decay": 1e-5}, "num_negative": 5}, "train": {"model": "LargeVis", "num_epoch": 50, "negative_weight": 3}, "evaluate": [{"task": task, **({"target": "english_setter", "file_name": "<imagenet.train_hierarchical_label>"} if task == "hierarchy" else {})}]}
    l3 = {
        "ComplEx": {"fb15k": (2048, "Adam", 2e-4, 1000, 1e-3), "fb15k237": (2048, "Adam", 2e-5, 1000, 5e-3), "wn18": (1024, "Adam", 1e-5, 4000, 5e-5), "wn18rr": (1024, "Adam", 1e-5, 6000, 5e-6), "wikidata5m": (512, "SGD", 0.1, 1000, 2e-3, 0.2, 1e-3)},
        "DistMult": {"fb15k": (2048, "Adam", 5e-5, 1000, 1e-3), "fb15k237": (2048, "Adam", 2e-5, 1000, 5e-3), "wn18": (1024, "Adam", 1e-4, 4000, 1e-3), "wn18rr": (1024, "Adam", 2e-5, 6000, 1e-2), "wikidata5m": (512, "SGD", 0.1, 2000, 2e-3, 2, 1e-4)},
        "QuatE": {"fb15k": (2048, "Adam", 5e-5, 1000, 1e-2), "fb15k237": (2048, "Adam", 1e-5, 1000, 5e-2), "wn18": (1024, "Adam", 1e-5, 4000, 1e-2), "wn18rr": (1024, "Adam", 5e-6, 6000, 5e-2), "wikidata5m": (512, "SGD", 1.0, 2000, 5e-3, 10, 1e-4)},
        "SimplE": {"fb15k": (2048, "Adam", 2e-5, 1000, 2e-3), "fb15k237": (2048, "Adam", 2e-5, 1000, 5e-3), "wn18": (1024, "Adam", 5e-5, 4000, 2e-3), "wn18rr": (1024, "Adam", 1e-4, 6000, 2e-3), "wikidata5m": (512, "SGD", 1.0, 2000, 2e-3, 2, 1e-4)},
    }
    margin = {
        "RotatE": {"fb15k": (2048, "Adam", 2e-4, 1000, 24), "fb15k237": (2048, "Adam", 2e-6, 1000, 9), "wn18": (1024, "Adam", 5e-6, 4000, 9), "wn18rr": (1024, "Adam", 5e-6, 6000, 6), "wikidata5m": (512, "SGD", 0.01, 1000, 6, 0.2, 1)},
        "TransE": {"fb15k": (1024, "Adam", 1e-5, 1000, 24), "fb15k237": (1024, "Adam", 2e-6, 1000, 9), "wn18": (512, "Adam", 5e-6, 4000, 12), "wn18rr": (512, "Adam", 1e-6, 6000, 6), "wikidata5m": (512, "SGD", 0.001, 1000, 12, 0.5, 0.01)},
    }
    for kind, table in (("l3_regularization", l3), ("margin", margin)):
        for model, sets in table.items():
            for data, (dim, opt, lr, epochs, value, *more) in sets.items():
                extra = {"relation_lr_multiplier": more[1]} if len(more) > 1 else {}
                out[f"knowledge_graph/{model.lower()}_{data}"] = _kg(data, model, dim, opt, lr, epochs, **{kind: value}, adversarial_temperature=more[0] if more else 2, **extra)
    return out


def find_baseline(keywords: list[str]) -> tuple[str, dict]:
    """The one bundled experiment whose name holds all keywords."""
    hits = {k: v for k, v in baselines().items() if all(w.lower() in k.lower() for w in keywords)}
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} baselines match {' '.join(keywords)}: {', '.join(sorted(hits)) or 'none'}")
    name, config = hits.popitem()
    return name, copy.deepcopy(config)


def recursive_map(value, f: Callable):
    if isinstance(value, dict):
        return {k: recursive_map(v, f) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [recursive_map(v, f) for v in value]
    return f(value)


def check_config(config: dict) -> dict:
    wrong = set(config) - set(SECTIONS)
    if wrong:
        raise ValueError(f"unknown sections: {', '.join(sorted(wrong))}")
    if "application" not in config:
        raise ValueError("the section `application` is missing")
    return config


def load_config(spark: SparkSession, path: str | dict, registry: Registry | None = None) -> dict:
    """An experiment with "auto" resolved to None, dataset references to files or tables, and the optimizer built."""
    config = path if isinstance(path, dict) else yaml.safe_load(open(path, encoding="utf-8"))
    registry = registry or Registry(spark, global_config()["dataset_path"])
    config = recursive_map(check_config(config), lambda v: None if v == "auto" else registry.resolve(v))
    spec = (config.get("build") or {}).get("optimizer")
    if isinstance(spec, dict):
        config["build"]["optimizer"] = Optimizer.make(spec, Optimizer())
    return config


def global_config(path: str | None = None) -> dict:
    """Settings of ~/.graphloom/config.yaml over the defaults."""
    path = path or os.path.expanduser("~/.graphloom/config.yaml")
    own = yaml.safe_load(open(path, encoding="utf-8")) if os.path.exists(path) else None
    wrong = set(own or {}) - set(DEFAULTS)
    if wrong:
        raise ValueError(f"unknown settings: {', '.join(sorted(wrong))}")
    return DEFAULTS | (own or {})


_TABLE_ARGUMENT = {"file_name": {"graph": "edges", "knowledge graph": "triplets", "word graph": "corpus", "visualization": "edges"}, "vector_file": {"visualization": "vectors"}}


def _arguments(section: dict | None, kind: str, evaluation: bool = False) -> dict:
    """Keyword arguments of a section; a split that is a table goes to the argument for tables."""
    out = {}
    for k, v in (section or {}).items():
        if isinstance(v, DataFrame):
            k = "tests" if evaluation and k == "file_name" else "known" if k == "filter_file" else _TABLE_ARGUMENT[k][kind]
        elif k == "filter_files" and any(isinstance(x, DataFrame) for x in v):
            known = None
            for x in v:
                x = x.select("h", "r", "t")
                known = x if known is None else known.unionByName(x)
            k, v = "known", known
        out[k] = v
    return out


def run_experiment(spark: SparkSession, path: str | dict, evaluate: bool = True, num_epoch: float | None = None, registry: Registry | None = None):
    """Load, build, train, evaluate and save as an experiment file says. Returns (application, results of its evaluations)."""
    config = load_config(spark, path, registry)
    kind = config["application"]
    app = Application(kind, spark, int((config.get("resource") or {}).get("dim") or 128))
    if config.get("format"):
        app.set_format(**config["format"])
    app.load(**_arguments(config.get("graph"), kind))
    app.build(**(config.get("build") or {}))
    if config.get("load"):
        app.load_model(**config["load"])
    train = dict(config.get("train") or {})
    if num_epoch is not None:
        train["num_epoch"] = num_epoch
    app.train(**{k: v for k, v in train.items() if v is not None})
    results = []
    tasks = config.get("evaluate") or []
    for task in (tasks if isinstance(tasks, list) else [tasks]) if evaluate else []:
        results.append(app.evaluate(**_arguments(task, kind, True)))
    if config.get("save"):
        app.save_model(**config["save"])
    return app, results


def write_template(kind: str, path: str, overwrite: bool = False) -> None:
    if kind not in TEMPLATES:
        raise ValueError(f"unknown application `{kind}`: {', '.join(TEMPLATES)} are known")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(f"{path} is there already")
    with open(path, "w", encoding="utf-8") as out:
        yaml.safe_dump(TEMPLATES[kind], out, sort_keys=False)


def init_logging(level: int | str = logging.INFO, directory: str | None = None, verbose: bool = False) -> None:
    """Log to the console, or to a file in a directory; verbose adds time and place."""
    form = "[%(asctime)s %(name)s %(filename)s:%(lineno)d] %(message)s" if verbose else "%(message)s"
    logging.basicConfig(level=level, format=form, filename=os.path.join(directory, "graphloom.log") if directory else None, force=True)
