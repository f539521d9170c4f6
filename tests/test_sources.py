"""Readers, writers and datasets on small files."""

import gzip
import zipfile

import numpy as np
import pytest

from graphloom.operators import graph as G
from graphloom.operators import transforms as T
from graphloom.sources import binary as B
from graphloom.sources import text as S
from graphloom.sources import writers as W
from graphloom.sources.datasets import Dataset, Registry, extract


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_edges(spark, tmp_path):
    f = write(tmp_path / "e.txt", "a b\nb\t c  2.0\na a\na b\n# note\n\nc d # x\n")
    got = S.read_edges(spark, f).orderBy("line")
    assert rows(got, "src", "dst", "weight") == [("a", "b", 1.0), ("b", "c", 2.0), ("a", "a", 1.0), ("a", "b", 1.0), ("c", "d", 1.0)]
    adjacency = G.directed(got)
    assert adjacency.count() == 9  # a self-loop isn't doubled
    names = G.vertex_names(got, "line")
    assert sorted(rows(names, "id", "name")) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_edges_refuse_bad_lines(spark, tmp_path):
    f = write(tmp_path / "e.txt", "a b\nonly\n")
    with pytest.raises(Exception, match="invalid edge"):
        S.read_edges(spark, f).collect()


def test_other_delimiters_and_comments(spark, tmp_path):
    f = write(tmp_path / "e.txt", "a,b;;c,]x\n")
    fmt = S.TextFormat(",]", ";;")
    assert rows(S.read_tokens(spark, f, fmt), "tokens") == [(["a", "b"],)]


def test_triplets_and_queries(spark, tmp_path):
    f = write(tmp_path / "t.txt", "x likes y\ny likes z 0.5\nx knows z\n")
    t = S.read_triplets(spark, f).orderBy("line")
    assert rows(t, "h", "r", "t", "weight") == [("x", "likes", "y", 1.0), ("y", "likes", "z", 0.5), ("x", "knows", "z", 1.0)]
    n = G.kg_normalize(t)
    assert {(r.h, r.r, r.t): round(r.weight, 6) for r in n.collect()}[("y", "likes", "z")] == pytest.approx(0.5 / np.sqrt(0.5 * 0.5))
    q = write(tmp_path / "q.txt", "a r\nb r c\n")
    assert rows(S.read_queries(spark, q, "tail").orderBy("line"), "h", "r", "t") == [("a", "r", None), ("b", "r", "c")]
    assert rows(S.read_queries(spark, q, "head").orderBy("line"), "h", "r", "t") == [(None, "a", "r"), ("b", "r", "c")]


def test_vectors(spark, tmp_path):
    f = write(tmp_path / "v.txt", "1 2 3\n4 5 6\n")
    assert rows(S.read_vectors(spark, f).orderBy("id"), "id", "vec") == [(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])]
    with pytest.raises(Exception, match="3 numbers"):
        S.read_vectors(spark, write(tmp_path / "w.txt", "1 2 3\n4 5\n")).collect()
    np.save(tmp_path / "m.npy", np.arange(6).reshape(3, 2))
    assert rows(S.read_vector_file(spark, str(tmp_path / "m.npy")).orderBy("id"), "id", "vec") == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    with pytest.raises(ValueError, match="unknown vector file"):
        S.read_vector_file(spark, "x.bin")


def test_labels_communities_aliases(spark, tmp_path):
    assert rows(S.read_labels(spark, write(tmp_path / "l", "a 1\na 2\nb 1\n")).orderBy("line"), "node", "label") == [("a", "1"), ("a", "2"), ("b", "1")]
    assert sorted(rows(S.read_communities(spark, write(tmp_path / "c", "a b\nb c\n")), "node", "label")) == [("a", "0"), ("b", "0"), ("b", "1"), ("c", "1")]
    aliases = S.read_aliases(spark, write(tmp_path / "a", "Q1\tone\tuno\nQ2\tone\ttwo\n"))
    assert sorted(rows(T.alias_map(aliases), "alias", "object")) == [("two", "Q2"), ("uno", "Q1")]
    assert rows(S.read_test_edges(spark, write(tmp_path / "y", "a b 1\n")), "src", "dst", "y") == [("a", "b", 1)]
    assert rows(S.read_point_labels(spark, write(tmp_path / "p", "root leaf\nroot twig\n")).orderBy("id"), "id", "path") == [(0, ["root", "leaf"]), (1, ["root", "twig"])]


def test_binary_images(spark, tmp_path):
    (tmp_path / "img").write_bytes(bytes(16) + bytes(range(8)))
    assert rows(B.read_idx_images(spark, str(tmp_path / "img"), 4).orderBy("row"), "row", "vec") == [(0, [0.0, 1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0, 7.0])]
    (tmp_path / "lab").write_bytes(bytes(8) + bytes([3, 1]))
    assert rows(B.read_idx_labels(spark, str(tmp_path / "lab")).orderBy("row"), "label") == [(3,), (1,)]
    (tmp_path / "rows").write_bytes(bytes([7, 1, 2]))
    images = B.read_labelled_rows(spark, str(tmp_path / "rows"), 2)
    assert rows(images, "label", "vec") == [(7, [1.0, 2.0])]
    assert rows(B.image_features(images, lambda x: x * 2), "features") == [([2.0, 4.0],)]
    with pytest.raises(NotImplementedError):
        B.image_features(images)


def test_graph_round_trip(spark, tmp_path):
    edges = S.edges_from_rows(spark, [("a", "b"), ("b", "c", 2.5)])
    names = G.vertex_names(edges)
    W.save_edges(G.encode(edges, names).select("src", "dst", "weight"), str(tmp_path / "out"), names)
    assert sorted(rows(S.read_edges(spark, str(tmp_path / "out")), "src", "dst", "weight")) == [("a", "b", 1.0), ("b", "c", 2.5)]
    t = S.triplets_from_rows(spark, [("a", "r", "b")])
    e, r = G.kg_names(t)
    W.save_triplets(G.encode_triplets(t, e, r), str(tmp_path / "kg"), e, r)
    assert rows(S.read_triplets(spark, str(tmp_path / "kg")), "h", "r", "t") == [("a", "r", "b")]


def test_model_round_trip_by_name(spark, tmp_path):
    names = spark.createDataFrame([("a", 0), ("b", 1)], "name string, id long")
    emb = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, vec array<double>")
    W.save_model(str(tmp_path / "m"), {"names": names, "vertex": emb}, {"dim": 1})
    other = spark.createDataFrame([("b", 5)], "name string, id long")
    assert rows(W.load_matrix(spark, str(tmp_path / "m"), "names", "vertex", other), "id", "vec") == [(5, [2.0])]
    with pytest.raises(Exception, match="no row for"):
        W.load_matrix(spark, str(tmp_path / "m"), "names", "vertex", spark.createDataFrame([("z", 1)], "name string, id long")).collect()
    assert W.load_hyperparameters(spark, str(tmp_path / "m")) == {"dim": 1}
    W.save_word_vectors(emb, names, str(tmp_path / "w"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "w") + "/part*").collect()) == ["a 1.0", "b 2.0"]


def test_datasets(spark, tmp_path):
    with gzip.open(tmp_path / "x.txt.gz", "wb") as f:
        f.write(b"a b\n")
    assert open(extract(str(tmp_path / "x.txt.gz"), str(tmp_path))).read() == "a b\n"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.txt", "c d\n")
    d = Dataset("own", {"train": ("z.zip", "in.txt"), "gone": "no.txt"}, {"size": lambda raw: 7}, str(tmp_path))
    assert open(d.train).read() == "c d\n"
    assert d["size"] == 7
    with pytest.raises(FileNotFoundError):
        d["gone"]
    with pytest.raises(KeyError):
        d["unknown"]
    reg = Registry(spark)
    assert reg.resolve("<math.valid>").count() == 1000
    assert reg.resolve("plain") == "plain"
