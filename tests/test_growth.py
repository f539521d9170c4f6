"""What queries move and hold as their tables grow, on small tables."""

import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from graphloom.functions.scores import MODELS
from graphloom.operators import evaluate as E
from graphloom.operators import graph as G
from graphloom.operators import knn as K
from graphloom.operators import sampling as R
from graphloom.operators import word_graph as WG
from graphloom.plans import catalogue as C


def top_join(df) -> str:
    """The keys of the join that makes a result's rows."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.search(r"Join \[([^\]]*)\]", plan)[1]


@pytest.mark.parametrize("candidates", [30, 4_000_000])
def test_second_order_candidates_are_not_shuffled(spark, monkeypatch, candidates):
    monkeypatch.setattr(R, "CANDIDATES", candidates, raising=False)
    rng = np.random.default_rng(5)
    pairs = {(0, int(b)) for b in range(1, 25)} | {(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2))}
    pairs |= {(b, a) for a, b in pairs if (a + b) % 3}
    w = {e: float(i % 5 + 1) for i, e in enumerate(sorted(pairs))}
    adjacency = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, weight double")
    states = sorted(pairs)
    got = R.second_order_weights(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(states)], "walk long, prev long, cur long"), adjacency, 4.0, 2.0)
    want = {(i, prev, cur, d, w[cur, d] / (4 if d == prev else 1 if (d, prev) in w else 2)) for i, (prev, cur) in enumerate(states) for d in range(30) if (cur, d) in w}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_join(got).startswith("cur#")


def test_exact_neighbours_with_ties_offsets_and_copies(spark):
    """Far from the origin single precision says little: the exact distances still decide, and copies tie to smaller ids."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=(60, 8)) + 3e4, np.repeat(rng.normal(size=(2, 8)), 20, 0)])
    near = K.Nearest(np.arange(160), x, 5)
    for s in (slice(0, 70), slice(70, 75), slice(75, 160)):
        near.show(np.arange(160)[s], x[s], rows=16, width=32)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(160), d.shape), d), axis=1)[:, :5]
    assert (near.near == want).all() and np.array_equal(near.d2, np.take_along_axis(d, want, 1))


def test_neighbours_are_searched_once_for_both_directions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "settle", lambda df: seen.append(1) or df.checkpoint())
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = spark.createDataFrame([(1, 2, 4.0), (2, 1, 2.0), (2, 3, 5.0)], "src long, dst long, weight double")
    assert {tuple(r) for r in G.symmetrize(rows).collect()} == {(1, 2, 3.0), (2, 1, 3.0), (2, 3, 5.0)} and seen == [1]


@pytest.mark.parametrize("side", ["head", "tail"])
def test_blocks_of_ranks_are_counted_exactly(side):
    """Ties with the truth, copies of it, and candidates next to it in single precision."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).round(1)
    x[50:60], x[60:64] = x[7], x[7] + 1e-9
    g, r, truth = rng.normal(size=(40, 6)).round(1), rng.normal(size=(40, 6)).round(1), np.arange(40)
    floor = MODELS["TransE"].score(*((x[:40], g) if side == "head" else (g, x[:40])), r, 12.0)
    pair = SimpleNamespace(q=truth.tobytes(), truth=truth.tobytes(), ids=np.arange(300).tobytes(), g=g.tobytes(), r=r.tobytes(), s=floor.tobytes(), x=x.tobytes(), m=40, n=300)
    want = [sum(e != i and E._scores("TransE", 12.0, side, g[i], r[i], x[e : e + 1])[0] >= floor[i] for e in range(300)) for i in range(40)]
    assert E._count_above("TransE", 12.0, side, pair).tolist() == want


def test_ranking_is_spread_over_tasks(spark):
    """Few rows were a task or two, and one side was broadcast: all pairs of blocks ran on a core or two."""
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(2000)], "id long, vec array<double>").coalesce(1)
    q = spark.range(2000).selectExpr("id AS q", "id AS h", "id % 5 AS r", "(id * 11 + 5) % 2000 AS t")
    plan = E._block_pairs(q, v, v, "TransE", "tail", 12.0, E._entity_blocks(v, 4096))
    assert plan.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and "CartesianProduct" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("room", [0, 1 << 20])
def test_words_are_counted_as_numbers(spark, monkeypatch, room):
    """One shuffle of pairs, without words in it; degrees and occurrences follow from the same counts."""
    monkeypatch.setattr(WG, "SMALL_VOCABULARY", room)
    monkeypatch.setattr(WG, "HELD_PAIRS", 20, raising=False)
    lines = [[f"w{(i * k) % 7}" for k in range(i % 9)] for i in range(40)] + [["w1"] * 6, [], ["once", "w1", "w2"]]
    corpus = spark.createDataFrame(list(enumerate(lines)), "line long, tokens array<string>").repartition(3)
    kept = [[w for w in line if w != "once"] for line in lines]
    both = Counter(e for line in kept for i, u in enumerate(line) for v in line[i + 1 : i + 3] for e in ((u, v), (v, u)))
    graph = WG.word_graph(corpus, 2, 5)
    assert {(r.src, r.dst): r.weight for r in graph.collect()} == both
    assert Counter((r.src, r.dst) for r in WG.word_occurrences(corpus, 2, 5).collect()) == both
    degree = Counter()
    for (u, _), n in both.items():
        degree[u] += n
    assert {r.id: r.weight for r in WG.word_degrees(corpus, 2, 5).collect()} == degree
    assert "hashpartitioning(u#" not in (plan := graph._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(pair#" in plan


def test_walks_read_only_the_edges_they_pass(spark, monkeypatch):
    """Both plans of walks agree, and draws in two steps are those over all edges in a row."""
    rng = np.random.default_rng(3)
    rows = [(f"v{a}", f"v{b}", float(w)) for a, b, w in rng.integers(0, 9, (60, 3))] + [("v0", f"v{i}", 2.0) for i in range(9)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    merged = edges.groupBy("src", "dst").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "weight")
    flat = R.weighted_draws(merged, "weight", ["src", "dst"], 60, 4).select("draw", "src", "dst")
    assert sorted(R.positive_edges(edges, 60, 4).collect()) == sorted(flat.collect())
    made = lambda: [sorted(map(tuple, w.collect())) for w in (R.random_walks(edges, 20, 3, 4), R.biased_walks(edges, 20, 3, 4.0, 2.0, 4))]
    few, seen = made(), []
    monkeypatch.setattr(R, "FEW", 0)
    monkeypatch.setattr(R, "transition_tables", lambda a, f=R.transition_tables: seen.append(1) or f(a))
    assert made() == few and seen == [1]


def test_rows_of_a_relation_do_not_meet_in_a_task(spark):
    k = spark.createDataFrame([(f"o{i}", "placed_by", f"c{i % 5}", 1.0) for i in range(40)], "h string, r string, t string, weight double")
    out = G.encode_triplets(k, *G.kg_names(k))
    assert out.count() == 40 and "hashpartitioning(r#" not in out._jdf.queryExecution().executedPlan().toString()


def test_training_steps_take_a_bounded_number_of_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(C, "QUERIES", dict(C.QUERIES))
    monkeypatch.setattr(C, "ORACLE_SQL", dict(C.ORACLE_SQL))
    monkeypatch.setattr(C, "STEP_ROWS", 7, raising=False)
    spark.range(40).selectExpr("id AS vec_id", "array(1F, 2F) AS embedding", "0 AS label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    C._training("rows_of_a_step", 2, ["n"], lambda np, h, t, r: [np.full(h.shape, float(len(h)))], "")
    got = C.QUERIES["rows_of_a_step"](spark, str(tmp_path)).collect()
    assert len(got) == 80 and max(r.n for r in got) <= 7
