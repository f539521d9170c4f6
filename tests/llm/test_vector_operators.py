"""Searches and near-duplicates of vectors against brute force."""

import numpy as np
import pytest

from graphloom.llm import embedding_dedup, topk
from test_text_operators import components

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def odd(dim):
    return [(900, None), (901, [NAN] * dim), (902, [None] * dim), (903, [INF] * dim), (904, [0.0] * dim)]


@pytest.mark.parametrize("block", [7, 8192])
def test_top_k(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.exponential()).astype("f").tolist()) for i in range(80)] + [(200, [0.5] * 6), (201, [0.5] * 6), *odd(6)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(table(spark, rows), lambda i: i % 20 == 0, 10, block=block).collect()}
    x = {i: [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v] for i, v in usable(rows)}
    want = {}
    for q in x:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x[q], v)), i) for i, v in x.items() if i != q)[:10]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_top_k_of_few_large_and_repeated_vectors(spark):
    rows = [(0, [3e5, 3e5]), (1, [3e5, -1.0]), (1, [3e5, -1.0]), (2, [0.0, 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table(spark, rows), lambda i: i == 0, 10).orderBy("rank").collect()]
    s = (1024 * 300000) ** 2 - 1024 * 1024 * 300000
    assert got == [(0, 1, 1, s), (0, 2, 1, s), (0, 3, 2, 0)]
    assert topk.top_k(table(spark, []), lambda i: i % 2 == 0).count() == 0
    assert topk.top_k(table(spark, rows), lambda i: i == 77).count() == 0


def brute_links(rows, cosine):
    good = {k: np.array(v, np.float32).astype(float) for k, (_, v) in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = {k: rows[k][0] for k in range(len(rows))}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] >= cosine * np.linalg.norm(good[a]) * np.linalg.norm(good[b])]
    parts = components(sorted(set(ids.values())), [(ids[a], ids[b]) for a, b in links])
    n = {k: sum(k in e for e in links) for k in ids}
    return sorted((ids[k], n[k], parts[ids[k]], parts[ids[k]] == ids[k]) for k in ids)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    rows += [(200 + i, (centres[i % 6] + 0.09 * rng.normal(size=16)).tolist()) for i in range(120)]
    rows += [(400 + i, rows[5][1]) for i in range(4)] + odd(16)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table(spark, rows)).collect())
    want = brute_links(rows, 0.9)
    found, links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and links > 500
    assert 0.99 * links <= found <= links
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_near_vectors_of_odd_tables(spark):
    assert embedding_dedup.near_vectors(table(spark, [])).count() == 0
    got = embedding_dedup.near_vectors(table(spark, [(1, None), (2, [0.0]), (3, [2.0]), (4, [5.0]), (4, [5.0]), (6, [-1.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (6, 0, 6, True)]
