"""Queries that once took less than their whole input, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.numeric import PRIME, draw, draw_numpy
from graphloom.operators import evaluate as E
from graphloom.operators import sampling as R
from graphloom.operators import word_graph as WG
from graphloom.plans import catalogue as C

N = 42


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with 42 vectors of 10 classes, one of them without a label."""
    path = str(tmp_path_factory.mktemp("small"))
    x = np.random.default_rng(3).normal(size=(N, 64))
    rows = [(i, [float(a) for a in x[i]], None if i == 41 else i // 4 % 10) for i in range(N)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_node_classification_learns_every_class(spark, small, monkeypatch):
    real, seen = E.node_classification, {}

    def watch(embeddings, labels, *args):
        seen["labels"], seen["rows"] = {r.label for r in labels.select("label").distinct().collect()}, labels.count()
        return real(embeddings, labels, *args)

    monkeypatch.setattr(E, "node_classification", watch)
    assert C.node_classification(spark, small).count() == 1
    assert seen == {"labels": {str(k) for k in range(10)}, "rows": N - 1}


def test_triples_reach_every_vector(spark, small):
    rows = C.triples(spark, small).select("ord", "h", "r", "t").collect()
    assert {tuple(r) for r in rows} == {(i, i, (i * 7 + 3) % N, (i * 11 + 5) % N) for i in range(N)}
    assert C.QUERIES["score_transe"](spark, small).count() == C.predict_logits(spark, small).count() == N


def test_negatives_are_drawn_from_all_entities(spark, small):
    rows = C.negative_sample_kg(spark, small).collect()
    drawn = {r.h for r in rows if r.h != r.pos} | {r.t for r in rows if r.h == r.pos and r.t != (r.pos * 11 + 5) % N}
    assert len(rows) == 4 * N and min(drawn) >= 0 and N // 2 < max(drawn) < N


def test_link_auc_pairs_every_vector(spark, small):
    rows = {r.id: (np.array(r.vec), r.label) for r in C.vectors(spark, small).collect()}
    scored = [(float(rows[i][0] @ rows[j][0]), rows[i][1] == rows[j][1]) for i in rows for j in [(i * 13 + 1) % N] if rows[i][1] is not None and rows[j][1] is not None]
    good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
    want = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert C.link_prediction_auc(spark, small).first()["auc"] == pytest.approx(want, abs=2e-6)


def test_gather_reads_every_row(spark, small):
    rows = C.gather_rows(spark, small).collect()
    assert sorted(r.id for r in rows) == sorted([*range(N), *range(N)])


# --- draws and stretches --------------------------------------------------------------------------------------------------


def test_draws_of_large_keys_are_their_own(spark):
    keys = [0, 1, 5, PRIME - 1, PRIME, PRIME + 1, 2 * PRIME, 2**31 * 512 + 7, 2**45 + 5, 2**61]
    got = [r.u for r in spark.createDataFrame([(k,) for k in keys], "k long").select(draw(F.col("k"), 2, 3).alias("u")).collect()]
    assert got == draw_numpy(np.array(keys), 2, 3).tolist() and len(set(got)) == len(keys)


def test_no_two_vertices_share_a_first_vector(spark):
    """Ids 0 and 2^22 had equal components at 512 dimensions while (id, component) was folded to 31 bits."""
    at = lambda i: draw(F.col("id") * 512 + i, 0, 1)
    rows = spark.createDataFrame([(0,), (1 << 22,), (1 << 23,), (5_000_000,)], "id long").select(*[at(i).alias(f"c{i}") for i in range(8)]).collect()
    assert len({x for r in rows for x in r}) == 32


@pytest.mark.parametrize("by", [None, ["g"]])
def test_stretches_leave_no_gap(spark, by):
    rows = [(i, "ab"[i % 2], 0.1 + (i % 7) / 3) for i in range(200)]
    got = R.cumulative(spark.createDataFrame(rows, "id long, g string, w double").repartition(5), "w", ["id"], by).orderBy("id").collect()
    for g in ("a", "b") if by else (None,):
        own = [r for r in got if g is None or r.g == g]
        assert own[0].lo == 0 and {r.total for r in own} == {own[-1].hi}
        assert all(a.hi == b.lo for a, b in zip(own, own[1:]))


def test_every_block_is_filled(spark):
    edges = spark.createDataFrame([("a", "b", 1000.0), ("c", "d", 1.0), ("a", "d", 3.0)], "src string, dst string, weight double")
    parts = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "id string, part int")
    got = R.positive_edges_by_block(edges, parts, 50, 5, 3).collect()
    assert {(h, t): sum((r.hp, r.tp) == (h, t) for r in got) for h in (0, 1) for t in (0, 1)} == {(0, 0): 5, (0, 1): 5, (1, 1): 5, (1, 0): 0}


def test_both_plans_of_word_pairs_agree(spark, monkeypatch):
    lines = [(i, [f"w{(i * k) % 11}" for k in range(i % 9)]) for i in range(40)] + [(99, ["w1"] * 6), (100, []), (101, ["w1", "seldom", "w2"])]
    corpus = spark.createDataFrame(lines, "line long, tokens array<string>").repartition(3)
    here = {tuple(r) for r in WG.word_pairs(corpus, 3, 5).select("u", "v", "n").collect()}
    monkeypatch.setattr(WG, "SMALL_VOCABULARY", 0)
    assert {tuple(r) for r in WG.word_pairs(corpus, 3, 5).select("u", "v", "n").collect()} == here and ("w1", "w2", 1) in {(u, v, min(n, 1)) for u, v, n in here}
    assert WG.word_pairs(corpus, 3, 10**6).count() == 0
