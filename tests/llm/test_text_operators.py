"""Operators on texts against brute force, with nulls, empty and long texts, copies, ties, empty tables and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, licenses, line_dedup, minhash, mixing, quality, sharding, suffix_dedup
from graphloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# --- components ---------------------------------------------------------------------------------------------------------


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (4, 4), (7, 8), (8, 9), (9, 10), (10, 11), (2, 1)]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = components({x for e in links for x in e}, links)
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100}


# --- 1 sharding ---------------------------------------------------------------------------------------------------------


def check_shards(out, rows, n):
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    by = collections.defaultdict(list)
    for r in out:
        t = texts[r.doc_id].encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
        assert 0 <= r.shard < n
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("n", [1, 3])
def test_shards(docs, rows, n):
    out = sharding.shard(docs, n).collect()
    check_shards(out, rows, n)
    shard = {r.doc_id: r.shard for r in out}
    assert shard[6] == shard[16]


def test_shards_balance_and_split_hot_groups(spark):
    rows = [(i, "same text of a hot group" if i % 3 == 0 else f"text {i} " + "w " * (i % 50)) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, part_items=300).collect()
    check_shards(out, rows, 8)
    sizes = collections.Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 8 and len(sizes) == 8


def test_shards_of_odd_tables(empty, clashing, rows):
    assert sharding.shard(empty, 4).count() == 0
    assert sharding.shard(clashing, 4).count() == len(rows)


# --- 2 licenses ---------------------------------------------------------------------------------------------------------


def brute_scan(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts = [(i, label) for p, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in starts]
    return len(ws), len(starts), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts}))


def test_license_scan(docs, rows):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[11].base_labels == "cc-by,gpl,reserved"
    assert got[12].labels == "apache-2.0" and got[12].score == 1.0 and got[12].spans[0].first_word == 0
    assert got[3].labels == "" and got[3].score == 0.0


def test_matching_statistics():
    seqs = [[1, 2, 3, 4], [2, 3, 5, 2, 3]]
    a = licenses.SuffixAutomaton(seqs)
    rng = np.random.default_rng(0)
    for _ in range(200):
        ids = rng.integers(1, 7, 12).tolist()
        longest = [max((k for k in range(i + 2) if k == 0 or any(ids[i + 1 - k : i + 1] == s[j : j + k] for s in seqs for j in range(len(s) - k + 1))), default=0) for i in range(len(ids))]
        want = [(i - longest[i] + 1, longest[i]) for i in range(len(ids)) if longest[i] >= 2 and (i + 1 == len(ids) or longest[i + 1] <= longest[i])]
        assert [(s, n) for s, n, _ in a.matches(ids, 0, 2)] == want


def test_template_with_words_in_between_is_chained():
    s = licenses.Scanner()
    text = "permission is hereby granted free of charge to any person (natural or not) obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    assert s.scan(text)[5] == "mit"
    assert s.scan("permission is hereby granted")[5] == ""


def test_license_scan_of_odd_tables(empty, clashing, rows):
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(clashing).count() == len(rows)


# --- 3 lines ------------------------------------------------------------------------------------------------------------


def brute_lines(rows, w, long_line):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        lines = text.split("\n") if text else []
        units = [(k, x.strip()) for k, x in enumerate(lines) if x.strip()]
        gone, add = set(), []
        for a in range(len(units)):
            for n in [1] * (len(units[a][1].split()) >= long_line) + [w] * (a + w <= len(units)):
                key = (n, tuple(x for _, x in units[a : a + n]))
                if key in seen:
                    gone |= {k for k, _ in units[a : a + n]}
                seen.add(key)
        out[i] = (text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("w,long_line", [(3, 40), (2, 5), (4, 1000)])
def test_line_dedup(docs, rows, w, long_line):
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs, w, long_line).collect()}
    assert got == brute_lines(rows, w, long_line)


def test_repeats_inside_a_document(spark):
    rows = [(0, "a\nb\nc\nx\na\nb\nc\n\na\nb\nc\ny"), (1, "a\nb\nz")]
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("a\nb\nc\nx\n\ny", 6, 1), 1: ("a\nb\nz", 0, 0)}


def test_line_dedup_of_odd_tables(empty, clashing, docs, rows):
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.line_dedup(clashing).count() == len(rows)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1 not in ids and {0, 3, 4, 5} <= ids


# --- 6 quality ----------------------------------------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark):
    rng = np.random.default_rng(4)
    good = [" ".join(rng.choice(["the", "river", "runs", "slowly", "past", "old", "stones"], 30)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "FREE!!", "WIN!!"], 30)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, quality.learn(docs, labels, 120)).collect()
    assert len(out) == 303
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id < 150) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    kept = quality.keep_good(docs.withColumn("score", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id < 150").count() > 140


def test_quality_without_labels(docs, spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, none)
    assert {r.score for r in quality.score_quality(docs, model).collect()} == {0.5}
    assert quality.score_quality(empty, model).count() == 0


def test_batches_don_t_change_scores():
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS), 0.1)
    texts = ["one two three", None, "two two two", "x" * 1000, ""]
    assert np.allclose(model.batches(texts, 5), [model.probabilities([t])[0] for t in texts])


# --- 7 suffixes ---------------------------------------------------------------------------------------------------------


def brute_bytes(rows):
    first, out = {}, {}
    for i, text, *_ in sorted(rows):
        b = (text or "").encode()
        gone, own = bytearray(len(b)), set()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            own.add(w)
            if first.get(w, i) < i:
                gone[p : p + 50] = b"\1" * 50
        for w in own:
            first.setdefault(w, i)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_bytes(rows)
    assert got[9][1] > 0 and got[18][1] == 80


def test_suffix_dedup_of_random_overlaps(spark):
    rng = np.random.default_rng(7)
    pool = "".join(rng.choice(list("abé \0"), 900))
    rows = []
    for i in range(60):
        cuts = [(a, a + int(rng.integers(20, 140))) for a in rng.integers(0, 800, 3)]
        rows.append((i, "".join(pool[a:b] for a, b in cuts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_bytes(rows)


def test_suffix_dedup_of_odd_tables(spark, empty, clashing, rows):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(clashing).count() == len(rows)
    t = "some text that is certainly longer than fifty bytes, isn't it? yes"
    twice = spark.createDataFrame([(5, t), (5, t), (None, t), (6, t)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.suffix_dedup(twice).collect())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 6, len(t)), (True, 0, 0)]


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_suffix_dedup_shuffles_little_where_ranges_are_many(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(32, 127, 3000))) for _ in range(300)]
    texts += [t[:1000] + "changed" + t[1007:] for t in texts[:60]] + texts[100:200]
    rows = [(i * 7919, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    table.count()
    before = shuffled_bytes(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(table).collect()}
    assert shuffled_bytes(spark) - before < 5.2 * sum(map(len, texts))
    assert got == brute_bytes(rows)


def test_suffix_dedup_of_copies_and_of_zero_bytes(spark):
    a, b = "a text of which there are copies, and it is longer than fifty bytes" * 2, "another one that stays as it is and has more than fifty bytes as well"
    zeros = "\0" * 70
    table = spark.createDataFrame([(1, a), (2, a), (2, b), (3, "x" + b), (-4, a + "!"), (5, zeros + "p"), (6, "q" + zeros)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(table, texts=True).collect())
    assert got == sorted([(1, len(a), len(a), 1, b""), (2, len(a), len(a), 1, b""), (2, len(b), 0, 0, b.encode()), (3, len(b) + 1, len(b), 1, b"x"), (-4, len(a) + 1, 0, 0, (a + "!").encode()), (5, 71, 0, 0, (zeros + "p").encode()), (6, 71, 70, 1, b"q")])


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(9)
    n = suffix_dedup.KEY
    for k in (1, 2, 3, 5, 8):
        runs = [sorted({bytes(rng.choice([97, 98], n).tolist()) if rng.random() < 0.3 else b"a" * (n - 3) + bytes(rng.choice([97, 98, 99], 3).tolist()) for _ in range(20)}) for _ in range(k)]
        lcp = lambda a, b: next((i for i in range(n) if a[i] != b[i]), n)
        order, steps = suffix_dedup.merge_runs(runs, [[0, *(lcp(a, b) for a, b in zip(r, r[1:]))] for r in runs])
        at, merged = [0] * k, []
        for r in order:
            merged.append(runs[r][at[r]])
            at[r] += 1
        assert merged == sorted(x for r in runs for x in r)
        assert steps[1:] == [lcp(a, b) for a, b in zip(merged, merged[1:])]


# --- 8 MinHash ----------------------------------------------------------------------------------------------------------


def shingle_set(text, k):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())


def brute_near(rows, k, threshold):
    sets = {i: shingle_set(t, k) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    parts = components(ids, links)
    return {i: (len(sets[i]), parts[i], parts[i] == i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k).collect()}
    assert got == brute_near(rows, k, 80)
    assert got[2][1] == 0 and got[15][1] == 14 and got[4][0] == 0


def test_chains_of_near_copies(spark):
    rng = np.random.default_rng(3)
    rows, ws = [], [f"w{x}" for x in rng.integers(0, 5000, 150)]
    for i in range(120):
        ws = list(ws)
        for p in rng.integers(0, 150, int(rng.integers(0, 5))):
            ws[p] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows, 4, 80)


def test_near_duplicates_of_odd_tables(empty, clashing, docs, rows):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(clashing).count() == len(rows)
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


# --- 9 BPE --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.TOKENIZER)


def test_bpe(docs, rows, tokenizer):
    got = {r.doc_id: r for r in bpe.encode_decode(docs, whole=True).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False) == (text or "")
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_splitting_equals_the_pretokenizer(tokenizer):
    rng = np.random.default_rng(1)
    alphabet = list("ab 'sretmdvl \n\t é1٣,.!'   漢😀\x1cć  ")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000)] + ["it's we're 'll'd ''s 'S' ' s", "  's  'tis \n's\n\n x ", "\0a\0"]
    s = bpe.Splitter([])
    codes, n = s.split(texts)
    at = 0
    for t, k in zip(texts, n):
        words = [s.words[c] for c in codes[at : at + k]]
        at += k
        ends = [b for _, (_, b) in tokenizer.pre_tokenizer.pre_tokenize_str(t)]
        assert np.cumsum([len(w) for w in words]).tolist() == ends and "".join(words) == t


def test_bpe_of_odd_tables(spark, empty, clashing, rows):
    assert bpe.encode_decode(empty).count() == 0
    assert bpe.encode_decode(clashing).count() == len(rows)
    got = bpe.encode_decode(spark.createDataFrame([(None, "a b"), (-7, "a b"), (-7, "a b"), (2**60, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, -7, 2), (False, -7, 2), (False, 2**60, 0), (True, 0, 2)]


def test_pack_round_trip():
    from graphloom.llm._common import pack, unpack

    arrays = [np.array([0, 255, 256, 2**40]), b"bytes", np.zeros(0, np.int64), np.array([1], bool)]
    a, b, c, d = unpack(pack(*arrays))
    assert a.tolist() == [0, 255, 256, 2**40] and b == b"bytes" and len(c) == 0 and d.tolist() == [1]


# --- 10 mixing ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, cap=3.0):
    """Water filling by rounds, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()} == {r.doc_id: r.taken for r in got}


def test_mixing_comes_near_its_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 60)), "abcdefg"[min(6, int(rng.exponential(1.5)))]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, bucket_rows=100).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 60 for r in out) and len(out) == 7


def test_pivot_keeps_mass():
    rng = np.random.default_rng(6)
    size = np.sort(rng.integers(1, 100, 500))[::-1].astype(float)
    p = mixing.pivot(np.full(500, 0.3), size, rng.random(500))
    assert (p * size).sum() == pytest.approx(0.3 * size.sum())
    assert ((p > 0) & (p < 1)).sum() <= 1


def test_mixing_of_odd_tables(empty, clashing, docs, rows):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(clashing).count() == len(rows)
    assert mixing.apply_mix(docs).columns == docs.columns
    assert mixing.apply_mix(clashing).columns == clashing.columns


# --- documents without an id --------------------------------------------------------------------------------------------


def test_documents_without_id(spark):
    t = "\n".join(f"line {i} of a text that is long enough to matter" for i in range(8))
    rows = [(2**60 + 1, t, "a"), (None, t, "a"), (None, "alone here with words", None), (7, None, None), (None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    assert sharding.shard(docs, 2).count() == 5
    assert licenses.scan_licenses(docs).count() == 5
    got = {(r.doc_id, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {(2**60 + 1, 0), (None, 0), (7, 0)}
    near = {(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert near == {(2**60 + 1, True, 2**60 + 1, True), (None, True, 2**60 + 1, False), (None, True, None, True), (7, False, 7, True), (None, False, None, True)}
    assert minhash.drop_near_duplicates(docs).count() == 5
    assert {r.doc_id for r in bpe.encode_decode(docs).collect()} == {2**60 + 1, None, 7}
    assert mixing.mix(docs).count() == 5 and mixing.apply_mix(docs).columns == docs.columns
    assert suffix_dedup.suffix_dedup(docs).count() == 5
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.learn(docs, labels)).count() == 5
