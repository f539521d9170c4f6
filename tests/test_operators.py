"""Properties of operators that SQL doesn't tell."""

import logging
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import monitor
from graphloom.functions.numeric import auto_augmentation_step, draw, draw_numpy
from graphloom.functions.optim import Optimizer
from graphloom.functions.scores import COLUMN_SCORES, MODELS, score_columns
from graphloom.operators import evaluate as E
from graphloom.operators import graph as G
from graphloom.operators import knn as K
from graphloom.operators import sampling as R
from graphloom.operators import transforms as T
from graphloom.operators import viz
from graphloom.operators import word_graph as WG
from graphloom.plans.solvers import schedule


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


@pytest.mark.parametrize("name", sorted(MODELS))
def test_gradients(name):
    rng = np.random.default_rng(1)
    m, (h, t, r) = MODELS[name], rng.normal(size=(3, 2, 8))
    grads = m.gradient(h, t, r, 9.0)
    fixed = np.sqrt((r.reshape(2, 2, 4) ** 2).sum(-1, keepdims=True))
    for k, x in enumerate((h, t, r)):
        if grads[k] is None:
            continue
        for i in range(8):
            step = np.zeros_like(x)
            step[:, i] = 1e-6
            args = [[h, t, r], [h, t, r]]
            args[0][k], args[1][k] = x + step, x - step
            if name == "QuatE" and k == 2:  # its gradient holds the norm fixed
                scale = lambda y: np.sqrt((y.reshape(2, 2, 4) ** 2).sum(-1, keepdims=True)) / fixed
                up, down = ((m.score(h, t, (y.reshape(2, 2, 4)).reshape(2, 8), 9.0)) for y in (x + step, x - step))
                hh = lambda y: m.score((h.reshape(2, 2, 4) * scale(y)).reshape(2, 8), t, y, 9.0)
                up, down = hh(x + step), hh(x - step)
            else:
                up, down = m.score(*args[0], 9.0), m.score(*args[1], 9.0)
            numeric = (up - down) / 2e-6
            factor = 2 if name == "LargeVis" else 1
            assert np.allclose(numeric, factor * grads[k][:, i], atol=1e-5)


@pytest.mark.parametrize("name", sorted(COLUMN_SCORES))
def test_columns_equal_numpy(spark, name):
    rng = np.random.default_rng(2)
    h, t, r = rng.normal(size=(3, 8))
    df = spark.createDataFrame([(h.tolist(), t.tolist(), r.tolist())], "h array<double>, t array<double>, r array<double>")
    got = df.select(score_columns(name, F.col("h"), F.col("t"), F.col("r"), 9.0)).first()[0]
    assert got == pytest.approx(float(MODELS[name].score(h, t, r, 9.0)))


def test_dimension_checks():
    with pytest.raises(ValueError):
        MODELS["QuatE"].check(6)
    MODELS["RotatE"].check(6)


def test_optimizers():
    x, g = np.array([1.0]), np.array([2.0])
    assert Optimizer("SGD", 0.1, 0.5).step(x, g, [])[0] == pytest.approx(0.25)
    m = [np.zeros(1), np.zeros(1)]
    assert Optimizer("Adam", 0.1).step(x, g, m)[0] == pytest.approx(0.1 * 0.002 / (math.sqrt(4e-5) + 1e-8))
    assert Optimizer.make(0.5, Optimizer("Adam", 0.1)).lr == 0.5
    assert Optimizer.make({"type": "RMSprop", "lr": 1, "alpha": 0.5}, Optimizer()).options == {"alpha": 0.5}
    with pytest.raises(ValueError):
        Optimizer("Nope")
    with pytest.raises(ValueError):
        Optimizer("SGD", options={"alpha": 1})
    assert Optimizer("SGD", 1.0).rate(50, 100) == 0.5
    assert Optimizer("SGD", 1.0, schedule=lambda b, n: 7).rate(1, 2) == 7


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("tied", [False, True])
def test_schedule(parts, tied):
    seen = set()
    for blocks in schedule(parts, tied):
        used = [x for b in blocks for x in (set(b) if tied else {("h", b[0]), ("t", b[1])})]
        assert len(used) == len(set(used))
        for a, b in blocks:
            seen |= {(a, b), (b, a)} if tied else {(a, b)}
    assert seen == {(a, b) for a in range(parts) for b in range(parts)}


def test_draws_are_uniform_and_independent(spark):
    got = np.array([r[0] for r in spark.range(20000).select(draw(F.col("id"), 3, 4)).collect()])
    assert np.array_equal(got, draw_numpy(np.arange(20000), 3, 4))
    counts = np.histogram(got, 100, (0, 1))[0]
    assert ((counts - 200) ** 2 / 200).sum() < 150
    assert abs(np.corrcoef(got, draw_numpy(np.arange(20000), 4, 4))[0, 1]) < 0.03


def test_alias_table():
    w = np.array([1.0, 2.0, 5.0, 0.0])
    rng = np.random.default_rng(3)
    n = np.bincount(R.AliasTable(w).sample(rng.random(80000), rng.random(80000)), minlength=4)
    assert np.allclose(n / 80000, w / 8, atol=0.01)
    with pytest.raises(ValueError):
        R.AliasTable([0.0])


def test_edges_drawn_by_weight(spark):
    got = R.positive_edges(edges(spark, [("a", "b", 1), ("b", "c", 3), ("c", "d", 0)]), 4000, 1)
    n = {r["src"]: r["count"] for r in got.groupBy("src").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["b"] / 4000 - 0.75) < 0.03
    assert sum(n.values()) == 4000


def test_walks_follow_edges(spark):
    g = G.directed(edges(spark, [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("c", "d", 1)]))
    known = {(r.src, r.dst) for r in g.collect()}
    for walks in (R.random_walks(g, 40, 6, 1), R.biased_walks(g, 40, 6, 0.5, 2.0, 1)):
        paths = [r.path for r in walks.collect()]
        assert len(paths) == 40
        assert all((a, b) in known for p in paths for a, b in zip(p, p[1:]))
        assert all(len(p) == 7 for p in paths)


def test_walk_stops_at_a_sink(spark):
    walks = R.random_walks(edges(spark, [("a", "b", 1)]), 3, 5, 1)
    assert [r.path for r in walks.collect()] == [["a", "b"]] * 3


def test_second_order_bias(spark):
    g = G.directed(edges(spark, [("u", "v", 1), ("v", "x", 1), ("x", "u", 1), ("v", "y", 1)]))
    states = spark.createDataFrame([(0, "u", "v")], "walk long, prev string, cur string")
    got = {r.dst: r.weight for r in R.second_order_weights(states, g, 4.0, 2.0).collect()}
    assert got == {"u": 0.25, "x": 1.0, "y": 0.5}


def test_auto_augmentation():
    assert auto_augmentation_step(4_900_000, 1_100_000) == 4
    with pytest.raises(ValueError):
        auto_augmentation_step(5, 5)


def test_word_graph(spark):
    corpus = spark.createDataFrame([(0, ["a", "b", "a", "rare"]), (1, ["b", "a"])], "line long, tokens array<string>")
    got = {(r.src, r.dst): r.weight for r in WG.word_graph(corpus, 2, 2).collect()}
    assert got == {("a", "b"): 3.0, ("b", "a"): 3.0, ("a", "a"): 2.0}


def test_knn_and_perplexity(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(40, 3)), np.zeros((2, 3))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    near = K.knn(v, 8, block_rows=10)
    got = {(r.src, r.dst) for r in near.collect()}
    assert all(a != b for a, b in got) and len(got) == 42 * 8
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(42) for j in np.lexsort((np.arange(42), d[i]))[:8]}
    w = K.perplexity_weights(near.drop("rank"), 4.0).toPandas()
    for _, p in w.groupby("src")["weight"]:
        assert p.sum() == pytest.approx(1)
        assert -(p * np.log(p)).sum() == pytest.approx(math.log(4.0), abs=1e-4)
    s = G.symmetrize(K.perplexity_weights(near.drop("rank"), 4.0))
    again = G.symmetrize(s)
    assert s.exceptAll(again).count() == 0


def test_zigzag_balances(spark):
    w = spark.createDataFrame([(i, float(100 - i)) for i in range(16)], "id long, weight double")
    sums = [r[1] for r in G.zigzag_partition(w, 4).groupBy("part").agg(F.sum("weight")).collect()]
    assert len(set(sums)) == 1


def test_negative_edges(spark):
    e = edges(spark, [(f"n{i}", f"n{(i * 7 + 1) % 30}", 1) for i in range(30)])
    bad = T.negative_edges(e, 50, 3)
    known = {(r.src, r.dst) for r in e.collect()}
    got = [(r.src, r.dst) for r in bad.collect()]
    assert len(got) == len(set(got)) == 50
    assert all(a != b and (a, b) not in known and (b, a) not in known for a, b in got)


def test_link_prediction_split(spark):
    e = edges(spark, [(f"n{i}", f"n{(i * 7 + 1) % 90}", 1) for i in range(90)]).withColumn("line", F.monotonically_increasing_id())
    train, tests = T.link_prediction_split(e, [0.8, 0.2])
    y = tests[0].groupBy("y").count().collect()
    assert train.count() + sum(r["count"] for r in y if r["y"] == 1) == 90
    assert len({r["count"] for r in y}) == 1


def test_f1_and_auc(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (3, "c")], "node long, label string")
    scores = spark.createDataFrame([(n, c, s) for n, row in {1: "aab", 2: "bca", 3: "bac"}.items() for c, s in zip(row[:3], (3.0, 2.0, 1.0))], "node long, label string, score double").dropDuplicates(["node", "label"])
    got = {(r.node, r.label) for r in E.top_n_labels(scores, truth).collect()}
    assert {(1, "a"), (2, "b"), (3, "b"), (3, "a")} == got
    f = E.f1_scores(truth, E.top_n_labels(scores, truth)).first()
    assert f.micro_f1 == pytest.approx(6 / 8)
    assert f.macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, score double")
    assert E.auc(scored).first().auc == pytest.approx(3.5 / 4)


def test_filtered_rank_with_ties(spark):
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 1, 2, 5])], "id long, vec array<double>")
    rel = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(0, 0, 0, 1)], "q long, h long, r long, t long")
    none = q.select("h", "r", "t").limit(0)
    rank = lambda known: E.filtered_ranks(q, known, "TransE", v, rel, "tail").first()["rank"]
    assert rank(none) == 2  # a tie counts against the truth
    assert rank(spark.createDataFrame([(0, 0, 2), (0, 0, 1)], "h long, r long, t long")) == 1


def test_name_maps(spark):
    names = spark.createDataFrame([("a", 0)], "name string, id long")
    e = edges(spark, [("a", "a", 1), ("a", "z", 1)])
    assert E.name_map(e, {"src": names, "dst": names}).count() == 1
    with pytest.raises(Exception, match="unknown name"):
        E.get_mapping(e, "dst", names).collect()


def test_scatter(spark):
    t = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 2.0])], "id long, vec array<double>")
    u = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.5, 1.0])], "id long, vec array<double>")
    assert {r.id: r.vec for r in E.scatter_sum(t, u, -1.0).collect()} == {0: [1.0, 1.0], 1: [0.5, 1.0]}
    assert {r.id: r.vec for r in E.scatter(t, u.limit(1)).collect()} == {0: [1.0, 1.0], 1: [1.0, 0.0]}


def test_svg(spark, tmp_path):
    p = spark.createDataFrame([(0, 0.0, 1.0, "a<b"), (1, 1.0, 0.0, "c")], "id long, x double, y double, label string")
    viz.write_svg(p, str(tmp_path / "f.svg"))
    text = (tmp_path / "f.svg").read_text()
    assert text.count("<circle") == 2 and "a&lt;b" in text
    with pytest.raises(ValueError):
        viz.write_svg(p, str(tmp_path / "g.svg"), most=1)


def test_labels_lift_to_the_root(spark):
    parents = spark.createDataFrame([("root", None), ("a", "root"), ("aa", "a"), ("b", "root")], "child string, parent string")
    labels = spark.createDataFrame([(0, "aa"), (1, "b")], "id long, label string")
    assert {r.id: r.path for r in T.readable_labels(labels, parents, True).collect()} == {0: ["root", "a", "aa"], 1: ["root", "b", "b"]}
    assert {r.label for r in T.readable_labels(labels, parents).collect()} == {"root"}
    with pytest.raises(ValueError):
        viz.hierarchy_frames(T.readable_labels(labels, parents, True), "nowhere")


def test_monitor(caplog):
    with caplog.at_level(logging.INFO, "graphloom"):
        assert monitor.time(monitor.call(monitor.result(lambda x, y=1: x + y)))(2, y=3) == 5
    text = caplog.text
    assert "= 5" in text and "(2, y=3)" in text and " s" in text
