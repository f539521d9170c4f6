"""Solvers, applications, experiments and the command line on toy graphs."""

import json

import pytest
import yaml

from graphloom.cli import main, tree
from graphloom.plans.applications import Application
from graphloom.plans.config import baselines, check_config, find_baseline, global_config, recursive_map, run_experiment
from graphloom.streaming.degrees import event_edges, read_events, windowed_degrees, write_degrees


def cliques(n=2, size=8):
    return [(f"{c}_{i}", f"{c}_{j}") for c in range(n) for i in range(size) for j in range(i + 1, size)]


@pytest.mark.parametrize("model,step,parts", [("LINE", 1, 1), ("DeepWalk", 2, 2), ("node2vec", 2, 1)])
def test_node_embedding_learns(spark, model, step, parts):
    app = Application("graph", spark, 8)
    app.load(edge_list=cliques())
    app.build(optimizer={"type": "SGD", "lr": 0.3, "weight_decay": 0}, batch_size=2000, num_partition=parts, num_negative=2)
    history = app.train(model=model, num_epoch=120, augmentation_step=step, random_walk_length=4, negative_weight=1)
    assert history and history[-1][0] > 0
    tests = spark.createDataFrame([(f"0_{i}", f"0_{(i + 3) % 8}", 1) for i in range(8)] + [(f"0_{i}", f"1_{i}", 0) for i in range(8)], "src string, dst string, y int")
    assert app.evaluate("link prediction", tests=tests)["AUC"] > 0.9
    assert "#vertex: 16" in app.solver.info()
    again = app.solver.train(model=model, num_epoch=20, resume=True, augmentation_step=step, random_walk_length=4)
    assert again[-1][0] > history[0][0]
    with pytest.raises(ValueError):
        app.evaluate("nonsense")


def test_node_classification(spark, tmp_path):
    app = Application("graph", spark, 8)
    app.load(edge_list=cliques())
    app.build(optimizer={"type": "SGD", "lr": 0.3, "weight_decay": 0}, batch_size=2000)
    app.train(model="LINE", num_epoch=120, augmentation_step=1, negative_weight=1)
    labels = spark.createDataFrame([(f"{c}_{i}", str(c)) for c in range(2) for i in range(8)], "node string, label string")
    got = app.evaluate("node classification", labels=labels, portions=(0.5,), times=2, patience=10)
    assert got["micro-F1@50%"] > 0.8
    app.save_model(str(tmp_path / "m"), True)
    other = Application("graph", spark, 8)
    other.load(edge_list=list(reversed(cliques())))
    other.build()
    other.load_model(str(tmp_path / "m"))
    a = {r["name"]: r["vec"] for r in app.solver.vertex_embeddings.join(app.graph.names, "id").collect()}
    b = {r["name"]: r["vec"] for r in other.solver.vertex_embeddings.join(other.graph.names, "id").collect()}
    assert a == b


@pytest.mark.parametrize("model", ["TransE", "RotatE", "DistMult", "ComplEx", "SimplE", "QuatE"])
def test_knowledge_graphs_learn(spark, model):
    triplets = [(f"x{i}", "next", f"x{(i + 1) % 12}") for i in range(12)] + [(f"x{i}", "far", f"x{(i + 5) % 12}") for i in range(12)]
    app = Application("knowledge graph", spark, 16)
    app.load(triplet_list=triplets)
    app.build(optimizer={"type": "Adam", "lr": 0.03, "weight_decay": 0, "beta1": 0.9, "beta2": 0.99}, batch_size=3000, num_negative=6, num_partition=2 if model == "TransE" else 1)
    app.train(model=model, num_epoch=500, margin=3, l3_regularization=0, adversarial_temperature=1)
    tests = spark.createDataFrame(triplets, "h string, r string, t string")
    m = app.evaluate("link prediction", tests=tests, known=tests, target="tail")
    assert m["MRR"] > 0.5
    q = spark.createDataFrame([(0, "x0", "next")], "q long, h string, r string")
    best = app.entity_prediction(queries=q, k=3).orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2, 3] and best[0]["score"] >= best[2]["score"]


def test_layout_separates_clusters(spark, tmp_path):
    rows = [(c * 20 + i, [10.0 * c + 0.01 * i, 0.02 * i, float(c)]) for c in range(2) for i in range(20)]
    app = Application("visualization", spark, 2)
    app.load(vectors=spark.createDataFrame(rows, "id long, vec array<double>"), num_neighbor=6, perplexity=3)
    app.build(batch_size=4000, optimizer={"type": "Adam", "lr": 0.1, "beta1": 0.9, "beta2": 0.99})
    app.train(num_epoch=150, positive_reuse=1)
    labels = spark.createDataFrame([(i, str(i // 20)) for i in range(40)], "id long, label string")
    points = app.evaluate("visualization", labels=labels, save_file=str(tmp_path / "f.svg"))
    got = points.orderBy("id").collect()
    nearest = [min((r for r in got if r["id"] != p["id"]), key=lambda r: (r["x"] - p["x"]) ** 2 + (r["y"] - p["y"]) ** 2) for p in got]
    assert sum(p["label"] == n["label"] for p, n in zip(got, nearest)) > 0.85 * len(got)
    assert (tmp_path / "f.svg").exists()
    with pytest.raises(ValueError):
        app.load(vectors=spark.createDataFrame(rows, "id long, vec array<double>"), num_neighbor=2, perplexity=3)


def test_word_graph_application(spark):
    app = Application("word graph", spark, 8)
    app.load(corpus=spark.createDataFrame([(i, ["a", "b", "c", "a"]) for i in range(6)], "line long, tokens array<string>"), window=2, min_count=5)
    assert app.graph.num_vertex == 3
    app.build(batch_size=100)
    app.train(num_epoch=5, augmentation_step=1)
    assert app.solver.vertex_embeddings.count() == 3


def test_unknown_names_fail():
    with pytest.raises(ValueError):
        Application("nothing", None, 8)
    with pytest.raises(ValueError):
        check_config({"application": "graph", "oops": 1})


def test_experiment_file_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "e.txt").write_text("\n".join(" ".join(e) for e in cliques()))
    (tmp_path / "t.txt").write_text("0_0 0_3 1\n0_0 1_3 0\n")
    config = {"application": "graph", "resource": {"dim": 8}, "format": {"delimiters": " ", "comment": "#"}, "graph": {"file_name": str(tmp_path / "e.txt")}, "build": {"optimizer": {"type": "SGD", "lr": 0.3, "weight_decay": 0}, "num_partition": "auto", "batch_size": 2000}, "train": {"model": "LINE", "num_epoch": 60, "augmentation_step": 1, "negative_weight": 1}, "evaluate": [{"task": "link prediction", "file_name": str(tmp_path / "t.txt")}], "save": {"file_name": str(tmp_path / "model")}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    assert main(["run", str(tmp_path / "c.yaml")], spark) == 0
    assert "AUC" in json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (tmp_path / "model" / "vertex").exists()
    assert main(["new", "knowledge", "graph", "--file", str(tmp_path / "k.yaml")]) == 0
    assert yaml.safe_load((tmp_path / "k.yaml").read_text())["application"] == "knowledge graph"
    assert main(["new", "graph", "--file", str(tmp_path / "k.yaml")]) == 1
    assert main(["list"]) == 0
    assert "knowledge_graph" in tree()


def test_math_experiment(spark):
    config = {"application": "knowledge graph", "resource": {"dim": 8}, "graph": {"file_name": "<math.valid>"}, "build": {"optimizer": "auto", "batch_size": 1000, "num_negative": 2}, "train": {"model": "RotatE", "num_epoch": 1, "margin": 9}, "evaluate": {"task": "link prediction", "file_name": "<math.valid>", "filter_files": ["<math.valid>"], "target": "tail", "fast_mode": 20}}
    _, results = run_experiment(spark, config)
    assert results[0]["MR"] >= 1


def test_configuration(tmp_path):
    assert len(baselines()) >= 45
    assert find_baseline(["rotate", "wn18rr"])[1]["train"]["margin"] == 6
    with pytest.raises(ValueError):
        find_baseline(["fb15k"])
    assert recursive_map({"a": [1, {"b": 2}]}, lambda x: x * 2) == {"a": [2, {"b": 4}]}
    (tmp_path / "g.yaml").write_text("dataset_path: /x\n")
    assert global_config(str(tmp_path / "g.yaml"))["dataset_path"] == "/x"


def test_streaming_equals_batch(spark, sf, tmp_path):
    import os
    import shutil

    os.makedirs(tmp_path / "in")
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "a.parquet")
    q = write_degrees(windowed_degrees(event_edges(read_events(spark, str(tmp_path / "in")))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = windowed_degrees(event_edges(spark.read.parquet(f"{sf}/events.parquet")))
    assert got.exceptAll(whole.select(*got.columns)).count() == 0
    assert 0 < got.count() <= whole.count()
