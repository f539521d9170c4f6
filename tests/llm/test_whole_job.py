"""Cases in which an operator once did less than its whole job."""

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import _common, bpe, embedding_dedup, licenses, line_dedup, minhash, quality, sharding, topk

# --- 3 lines ------------------------------------------------------------------------------------------------------------


def test_two_short_lines_with_many_words_are_deleted(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 34), ("b", 33)))
    rows = [(0, f"top\n{one}\n{two}\nend"), (1, f"other\n{one}\n\n {two}\nlast"), (2, f"{one}\nbetween"), (3, "a b\nc d"), (4, "a b\nc d")]
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (rows[0][1], 0, 0), 1: ("other\n\nlast", 2, 1), 2: (rows[2][1], 0, 0), 3: ("a b\nc d", 0, 0), 4: ("a b\nc d", 0, 0)}


@pytest.mark.parametrize("w,long_line", [(3, 8), (4, 12), (3, 1), (1, 5)])
def test_line_runs_against_brute_force(spark, w, long_line):
    r = random.Random(w * 100 + long_line)
    pool = [" ".join(f"w{i}" for _ in range(1 + i % 7)) for i in range(12)]
    rows = [(i, "\n".join(r.choice([*pool, "", f"own {i} {k}"]) for k in range(r.randint(0, 9)))) for i in range(60)]
    seen, want = set(), {}
    for i, text in rows:
        lines = text.split("\n") if text else []
        at = [k for k, x in enumerate(lines) if x]
        size = lambda run: sum(len(lines[k].split()) for k in run)
        gone = set()
        for a in range(len(at)):
            for b in range(a + 1, min(a + w, len(at)) + 1):
                run = at[a:b]
                if len(run) == w or size(run) >= long_line > max(size(run[1:]), size(run[:-1])):
                    key = tuple(lines[k] for k in run)
                    gone |= set(run) if key in seen else set()
                    seen.add(key)
        want[i] = (text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    assert any(n for _, n in want.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.text, x.n_removed) for x in line_dedup.line_dedup(docs, w, long_line).collect()} == want


# --- 6 quality ----------------------------------------------------------------------------------------------------------


def plain_bag(text: str) -> dict[int, int]:
    """Buckets of all n-grams of whole words, counted one by one."""
    words, out = text.encode().split(), {0: quality.PRIOR}
    found = list(quality.pair_features(quality._word_hashes(words)))
    for w in words:
        m = b"<" + w + b">"
        grams = [int.from_bytes(m[i : i + n], "little") + (n << 40) for n in (3, 4) for i in range(len(m) - n + 1)]
        found += [*quality._buckets(quality._word_hashes([w]), quality.BUCKETS), *quality._buckets(np.array(grams, np.uint64), quality.BUCKETS)]
    for x in found:
        out[int(x)] = out.get(int(x), 0) + 1
    return out


@pytest.mark.parametrize("at_once", [7, 100, 1 << 19])
def test_long_words_count_to_their_end(monkeypatch, at_once):
    monkeypatch.setattr(quality, "_AT_ONCE", at_once)
    monkeypatch.setattr(quality.portions, "__defaults__", (at_once,))
    monkeypatch.setattr(quality.long_word_features, "__defaults__", (quality.BUCKETS, at_once))
    r = random.Random(5)
    unspaced = "".join(chr(r.randint(0x4E00, 0x4FFF)) for _ in range(200))
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.1)
    texts = [unspaced, "short words then " + unspaced + " " + unspaced, "a bb ccc", "x" * 70, "x" * 64 + "y"]
    for text, got in zip(texts, model.probabilities(texts)):
        ids, n = quality.bag(text)
        want = plain_bag(text)
        assert dict(zip(ids.tolist(), n.tolist())) == want
        z = sum(model.score[i] * k for i, k in want.items()) / sum(want.values()) + model.bias
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


# --- 9 words are told apart by spelling -----------------------------------------------------------------------------------


def thue_morse(order: int, swap: bool = False) -> str:
    """Strings that collide with their complement in any polynomial hash modulo a power of two."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(1 << order))


def test_words_with_equal_hashes_stay_apart(spark):
    from tokenizers import Tokenizer

    rows = [(0, thue_morse(10)), (1, thue_morse(10, True)), (-7, "x" * 300 + " " + "x" * 299 + "y"), (2**62, "é" * 1000)]
    tok = Tokenizer.from_file(bpe.TOKENIZER)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), whole=True).collect()}
    assert got == {i: (tok.encode(t, add_special_tokens=False).ids, t) for i, t in rows}


@pytest.mark.parametrize("hashed", [lambda raw, a, b: np.zeros(len(a), np.uint64), lambda raw, a, b: (b - a).astype(np.uint64)])
def test_any_hash_will_do(hashed):
    words = [b"a", b"bb", b"a", b"cc", b"", b"x" * 400, b"x" * 399 + b"y", b"x" * 400]
    stop = np.cumsum([len(w) for w in words])
    splitter = bpe.Splitter([])
    codes = splitter.code(b"".join(words), stop - [len(w) for w in words], stop, hashed)
    assert [splitter.spelled[c] for c in codes] == words


def test_span_hashes_depend_on_the_bytes_of_the_span_only():
    r = random.Random(8)
    spans = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 255, 256, 257, 1000)] * 2
    raw, stop = b"".join(spans), np.cumsum([len(s) for s in spans])
    h = _common.span_hashes(raw, stop - [len(s) for s in spans], stop)
    assert h[:9].tolist() == h[9:].tolist() and len(set(h.tolist())) == 9
    flipped = bytes([raw[0] ^ 1]) + raw[1:]
    assert (_common.span_hashes(flipped, stop - [len(s) for s in spans], stop) != h).sum() == 1


def test_classes_of_all_code_points_are_the_library_s():
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(bpe.TOKENIZER).pre_tokenizer
    r = random.Random(4)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for part in [points[i : i + 4096] for i in range(0, 0x20000, 4096)] + [r.sample(points, 4096) for _ in range(4)]:
        text = "".join(chr(c) + r.choice("a1! ") for c in part)
        splitter = bpe.Splitter([])
        codes, _ = splitter.split([text])
        words = splitter.words
        at = np.cumsum([0] + [len(words[c]) for c in codes]).tolist()
        assert list(zip(at[:-1], at[1:])) == [span for _, span in pre.pre_tokenize_str(text)]


# --- 5 and 8: any id ------------------------------------------------------------------------------------------------------

IDS = [-5, -3, 0, 7, 2**62, -(2**62)]


def test_near_duplicates_with_any_id(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:50], "changed", *words[51:]])
    for ids in ([-5, -3, 7, 8], [0, -1, 2**62, -(2**62)]):
        rows = list(zip(ids, [" ".join(words), near] * 2)) + [(5000, "nothing like that")]
        got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got == {i: (min(ids), i == min(ids)) for i in ids} | {5000: (5000, True)}


def test_near_vectors_with_any_id(spark):
    rows = [(i, [1.0, 0.01 * k, 0.0]) for k, i in enumerate(IDS)] + [(9, [0.0, 0.0, 1.0]), (-9, [0.0, 0.1, 1e-30]), (10, [0.0, 1e-200, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    least = -(2**62)
    assert got == {i: (5, least, i == least) for i in IDS} | {9: (0, 9, True), -9: (1, -9, True), 10: (1, -9, False)}


def test_near_vectors_with_clashing_columns(spark):
    rows = [(i, [1.0, 0.01 * i], "x", "y", "z") for i in range(5)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string, h1 string, rep string")
    assert {(r.n_links, r.component_id) for r in embedding_dedup.near_vectors(docs).collect()} == {(4, 0)}
    assert topk.top_k(docs.withColumn("norm", F.lit("x")).withColumn("score", F.lit("x")), lambda i: i == 0, 2).count() == 2


def test_words_that_collide_in_polynomial_hashes_link_nothing(spark):
    rows = [(0, thue_morse(10) + " x y"), (1, thue_morse(10, True) + " x y"), (2, thue_morse(12)), (3, thue_morse(12, True))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)


@pytest.mark.parametrize("block", [3, 1024])
def test_no_link_is_lost_in_crowded_buckets(spark, monkeypatch, block):
    """Families that share most words but aren't similar enough, so that buckets hold several components, chained by some members."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
    r = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = common[:]
        for k in range(r.choice([0, 1, 2, 3, 3, 4])):
            own[r.randrange(60)] = f"o{r.randrange(5)}"
        rows.append((i * 3 - 60, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(57)} for i, t in rows}
    part = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    assert 5 < len(set(part.values())) < 60
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == part


# --- 1 one law for groups of all sizes ------------------------------------------------------------------------------------


def test_a_group_larger_than_a_shard_is_cut_whatever_its_rows(spark):
    rows = [(i, "large text " * 200) for i in range(90)] + [(1000 + i, f"small {i}") for i in range(300)]
    sizes = collections.Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 2 * (2200 + 16)


def test_placement_against_plain_code():
    r = random.Random(6)
    items = [[r.randint(0, 90), r.randint(0, 9), 1] for _ in range(200)] + [[5, 5, 5]] * 10
    room = [[400.0 - 3 * b, 60.0 + b, 30.0] for b in range(7)]
    total, left = [sum(x[d] for x in items) for d in range(3)], [[0.0] * 3 for _ in room]
    for d in range(3):
        whole = sum(max(b[d], 0) for b in room)
        for b in range(7):
            left[b][d] = max(room[b][d], 0) / whole * 7
    share = [[x[d] / total[d] * 7 for d in range(3)] for x in items]
    want = [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(share[i]), i)):
        dots = [sum(left[b][d] * share[i][d] for d in range(3)) for b in range(7)]
        want[i] = max(range(7), key=lambda b: (round(dots[b], 9), -b))
        left[want[i]] = [x - y for x, y in zip(left[want[i]], share[i])]
    assert sharding.place(np.array(items, float), np.array(room)).tolist() == want


# --- 2 chains of many repeats ---------------------------------------------------------------------------------------------


def test_repeated_notices_are_chained_in_linear_time():
    scanner = licenses.Scanner()
    notice = "licensed under the apache license version 2 0 "
    began = time.perf_counter()
    scanner.scan("licensed under the apache license " * 1000)
    short = time.perf_counter() - began
    scanner.scan("licensed under the apache license " * 8000)
    assert time.perf_counter() - began < 30 * short + 1
    spans = scanner.scan(("other words in between of them here now " + notice) * 500)[-1]
    assert len([s for s in spans if s[0] == "apache-2.0"]) == 500
    assert {(s[2] - s[1] + 1, s[3]) for s in spans if s[0] == "apache-2.0"} == {(8, 1.0)}


# --- 3 hot fingerprints ---------------------------------------------------------------------------------------------------


def test_hot_lines_and_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 5)
    foot = "all of us\nsay goodbye\nfor now"
    rows = [(i - 30, f"own {i}\nshared line\nown again {i % 7}\n{foot if i % 3 else 'none'}") for i in range(60)]
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    seen, want = set(), {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for a in range(len(lines) - 2):
            key = tuple(lines[a : a + 3])
            gone |= {a, a + 1, a + 2} if key in seen else set()
            seen.add(key)
        runs = sum(a in gone and a - 1 not in gone for a in range(len(lines)))
        want[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone), runs)
    assert got == want and any(n for _, n, _ in want.values())
