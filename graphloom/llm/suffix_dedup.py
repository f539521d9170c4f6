"""Suffix-array deduplication by a common-prefix-aware distributed merge sort (operator 7).

Only suffixes that can matter are sorted. In every window of MATCH bytes the K-byte string with the smallest hash is an anchor, so two
equal windows have equal anchors at the same place in them. A document whose whole text a smaller one holds is removed as such and has
no anchors. Anchors that occur in one document only are dropped after their hashes have met in a shuffle: a chunk sends each hash once,
without places, gets a bit back for it and finds its anchors again. For each other anchor the suffix that starts there and the bytes
before it, read backwards, both as far as the windows reach whose anchor it is, make one key. Each chunk of documents sorts its keys and front-codes them into runs; a partition merges the runs of
all chunks with a loser tree that keeps, for every run, the common prefix with the last key put out and so never compares known
prefixes again. In the merged order equal keys lie together, and so do the keys of one anchor; from them
follows which windows around an anchor also start in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import pack, partitions, read, unpack

MATCH = 50
K = 24
BEFORE = MATCH - K
KEY = MATCH + BEFORE + 2
BATCH_BYTES = 1 << 20
HASH_BITS = 44
COPIES = -1
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours, by doubling."""
    cur, y = 1, x
    while 2 * cur <= w:
        y = op(y[:-cur], y[cur:])
        cur *= 2
    return op(y[: len(x) - w + 1], y[w - cur : w - cur + len(x) - w + 1]) if cur < w else y[: len(x) - w + 1]


def anchors(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of texts that end at `ends` in raw: smallest K-byte strings of all windows of MATCH bytes that lie within a text; smallest hashes by start of window."""
    n = len(raw)
    if n < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x = np.ndarray(n - 7, "<u8", raw, 0, (1,))
    m = n - K + 1
    h = x[:m] * _M1
    h ^= h >> np.uint64(32)
    h += x[8 : m + 8]
    h *= _M2
    h ^= h >> np.uint64(32)
    h += x[16 : m + 16]
    h *= _M3
    h ^= h >> np.uint64(29)
    h *= _M1
    h |= np.uint64(1)  # none is 0, which marks windows across the end of a text
    low = _slide(h, MATCH - K + 1, np.minimum)  # by start of window
    for e in ends[:-1].tolist():
        low[max(0, e - MATCH + 1) : e] = 0
    pad = np.zeros(MATCH - K, np.uint64)
    best = _slide(np.concatenate([pad, low, pad]), MATCH - K + 1, np.maximum)
    at = np.flatnonzero((best == h) & (h > 0))
    return at, h[at], low


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk in a fixed order, so that a row number means the same row each time."""
    return pdf.assign(text=pdf["text"].fillna("")).sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)


class _Chunk:
    """The rows of a chunk in order, and their anchors, the same each time."""

    def __init__(self, docs: pd.DataFrame, copies: list[bytes]):
        docs = _in_order(docs)
        self.ids = docs["doc_id"].to_numpy(np.int64)
        self.raws = [t.encode("utf-8", "surrogatepass") for t in docs["text"]]
        known, named = set(copies), {c[32:] for c in copies}
        self.copy = [(n := str(i).encode()) in named and hashlib.sha256(r).digest() + n in known for i, r in zip(self.ids.tolist(), self.raws)]

    def batches(self) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        """Rows that are no copies, their texts in one, and where each ends."""
        rows, size = [], 0
        for k, r in enumerate(self.raws):
            if not self.copy[k] and len(r) >= MATCH:
                rows.append(k)
                size += len(r)
            if rows and (size >= BATCH_BYTES or k == len(self.raws) - 1):
                yield np.array(rows), b"".join(self.raws[i] for i in rows), np.cumsum([len(self.raws[i]) for i in rows])
                rows, size = [], 0

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash of HASH_BITS bits) of all anchors, by row and position."""
        row, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for rows, raw, ends in self.batches():
            at, h, _ = anchors(raw, ends)
            row.append(rows[np.searchsorted(ends, at, side="right")])
            found.append(_spread(h))
        return np.concatenate(row), np.concatenate(found)

    def keys(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, row, position) of the anchors whose hashes are among those wanted, in order. A key holds the windows of which the anchor is the smallest string."""
        key, row, pos = [np.zeros((0, KEY), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, raw, ends in self.batches():
            at, h, low = anchors(raw, ends)
            g = _spread(h)
            use = wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g
            at, h = at[use], h[use]
            if not len(at):
                continue
            low = np.concatenate([np.zeros(BEFORE, np.uint64), low, np.zeros(BEFORE, np.uint64)])
            near, far = np.full(len(at), BEFORE), np.zeros(len(at), np.int64)
            for a in range(BEFORE + 1):
                own = low[at + BEFORE - a] == h
                far[own] = a
                near[own] = np.minimum(near[own], a)
            right, left = MATCH - near, far
            buf = np.frombuffer(raw + bytes(MATCH), np.uint8)
            made = np.zeros((len(at), KEY), np.uint8)
            for i in range(MATCH):
                made[:, i] = buf[at + i] * (right > i)
            for i in range(BEFORE):
                made[:, MATCH + i] = buf[np.maximum(at - 1 - i, 0)] * (left > i)
            made[:, -2], made[:, -1] = right, left + 1
            own = np.searchsorted(ends, at, side="right")
            key.append(made)
            row.append(rows[own])
            pos.append(at - np.concatenate([[0], ends])[own])
        return np.concatenate(key), np.concatenate(row), np.concatenate(pos)


def _spread(h: np.ndarray) -> np.ndarray:
    """Anchors are minima, so their hashes crowd at the low end: an odd factor spreads them over the ranges."""
    return (h * _M2) >> np.uint64(64 - HASH_BITS)


def _ranges(h: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes cut into equal ranges of hashes."""
    part = ((h * np.uint64(parts)) >> np.uint64(HASH_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return [(int(part[a]), a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)])]


def _find_anchors(parts: int):
    """(part, chunk, blob): the distinct hashes of a chunk's anchors by range, as steps, and a bit for each that occurs in two of its documents."""

    def run(docs: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs):
            chunk = _Chunk(docs, copies["blob"].tolist())
            row, h = chunk.anchors()
            order = np.argsort(h, kind="stable")
            h, doc = h[order], chunk.ids[row[order]]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(h) else np.zeros(0, bool)
            h, name = h[first], int(docs["chunk"].iloc[0])
            for p, a, b in _ranges(h, parts):
                rows.append((p, name, pack(np.diff(h[a:b].astype(np.int64), prepend=(p << HASH_BITS) // parts), np.packbits(several[a:b]).tobytes())))
        return pd.DataFrame(rows, columns=["part", "chunk", "blob"]).astype({"part": "int32", "chunk": "int64"})

    return run


def _keep_repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the hashes that each chunk sent of a range: (part, chunk, blob) with a bit for each that occurs in two documents or more."""
    got = [unpack(b) for b in pdf["blob"]]
    sizes = [len(g[0]) for g in got]
    h = np.concatenate([np.cumsum(g[0]) for g in got])
    several = np.concatenate([np.unpackbits(np.frombuffer(g[1], np.uint8), count=n) for g, n in zip(got, sizes)])
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    times = np.diff(np.concatenate([first, [len(h)]]))
    use = np.empty(len(h), bool)  # a document lies in one chunk, so what two chunks hold is in two documents
    use[order] = np.repeat((times > 1) | (np.maximum.reduceat(several[order], first) > 0), times)
    ends = np.cumsum(sizes)
    rows = [(p, c, pack(np.packbits(use[e - n : e]).tobytes())) for p, c, n, e in zip(pdf["part"].tolist(), pdf["chunk"].tolist(), sizes, ends.tolist()) if use[e - n : e].any()]
    return pd.DataFrame(rows, columns=["part", "chunk", "blob"]).astype({"part": "int32", "chunk": "int64"})


def _sorted_runs(hashed: int, parts: int):
    """Keys of a chunk's repeated anchors, sorted and front-coded: (part, chunk, blob)."""

    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"part": pd.Series([], dtype="int32"), "chunk": pd.Series([], dtype="int64"), "blob": pd.Series([], dtype=object)})
        if not len(docs) or not (found["part"] != COPIES).any():
            return none
        name = int(docs["chunk"].iloc[0])
        copies = found["part"] == COPIES
        chunk = _Chunk(docs, found["blob"][copies].tolist())
        bits = dict(zip(found["part"][~copies].tolist(), found["blob"][~copies]))
        sent = np.unique(chunk.anchors()[1])
        wanted = [sent[a:b][np.unpackbits(np.frombuffer(unpack(bits[p])[0], np.uint8), count=b - a) > 0] for p, a, b in _ranges(sent, hashed) if p in bits]
        key, row, pos = chunk.keys(np.concatenate(wanted))
        nth = row - np.searchsorted(chunk.ids, chunk.ids[row], side="left")
        part = np.frombuffer(key[:, :K].tobytes(), "<u8").reshape(-1, 3)
        part = ((part[:, 0] * _M1 ^ part[:, 1] * _M2 ^ part[:, 2] * _M3) * _M1 >> np.uint64(33)).astype(np.int64) % parts
        strings = key.view(f"S{KEY}").reshape(-1)
        order = np.lexsort((row, strings, part))
        key, doc, nth, pos, part = key[order], chunk.ids[row[order]], nth[order], pos[order], part[order]
        differs = key[1:] != key[:-1]
        new = np.concatenate([[True], differs.any(1) | (part[1:] != part[:-1])])
        common = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), KEY)])
        out = []
        cut = np.searchsorted(part, np.arange(parts + 1))
        for p in np.unique(part).tolist():
            a, b = cut[p], cut[p + 1]
            distinct = a + np.flatnonzero(new[a:b])
            shared = common[distinct].copy()
            shared[0] = 0
            right, left = key[distinct, -2].astype(np.int64), key[distinct, -1].astype(np.int64)
            tail = key[distinct][_sent(shared, right, left)].tobytes()
            times = np.diff(np.concatenate([distinct, [b]]))
            out.append((p, name, pack(shared, right, left, tail, times, doc[a:b] & 0xFFFFFFFF, (doc[a:b] >> 32) & 0xFFFFFFFF, nth[a:b], pos[a:b])))
        return pd.DataFrame(out, columns=["part", "chunk", "blob"]).astype({"part": "int32", "chunk": "int64"})

    return run


def _sent(shared: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which bytes of front-coded keys are sent: those behind the common prefix that aren't filled up with zeros. The two last bytes are `right` and `left` themselves."""
    at = np.arange(KEY)[None]
    return (at >= shared[:, None]) & ((at < right[:, None]) | ((at >= MATCH) & (at < (MATCH + left - 1)[:, None])))


def _decode(shared: np.ndarray, right: np.ndarray, left: np.ndarray, tail: bytes) -> list[bytes]:
    """The keys of a front-coded run."""
    n = len(shared)
    key, at = np.zeros((n, KEY), np.uint8), np.arange(n)
    key[_sent(shared, right, left)] = np.frombuffer(tail, np.uint8)
    for i in range(KEY - 2):
        key[:, i] = key[np.maximum.accumulate(np.where(shared <= i, at, 0)), i]
    key[:, -2], key[:, -1] = right, left
    raw = key.tobytes()
    return [raw[i : i + KEY] for i in range(0, n * KEY, KEY)]


def _common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    if a == b:
        return len(a)
    i = known
    while a[i : i + 8] == b[i : i + 8]:
        i += 8
    while a[i] == b[i]:
        i += 1
    return i


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs with a loser tree; shared[r][i] is the common prefix of key i of run r with the one before it.

    Returns the runs in the order of their keys, and the common prefix of each key with the one before it. A
    player carries its common prefix with the last winner: of two players with different ones the longer wins
    without a look at the keys, and with equal ones the keys are compared from there on only.
    """
    runs_n = len(runs)
    size = 1
    while size < max(runs_n, 1):
        size *= 2
    key: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (size - runs_n)
    lcp, at, tree = [0] * size, [0] * size, [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether player a comes before b; the loser's common prefix becomes that with the winner."""
        x, y = key[a], key[b]
        if y is None:
            return True
        if x is None:
            return False
        p, q = lcp[a], lcp[b]
        if p != q:
            return p > q
        n = _common_prefix(x, y, p)
        if n == KEY:
            first = a < b
        else:
            first = x[n] < y[n]
        lcp[b if first else a] = n
        return first

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            tree[node] = b
            return a
        tree[node] = a
        return b

    winner, order, steps = play(1) if size > 1 else 0, [], []
    lcp[winner] = 0
    while key[winner] is not None:
        w = winner
        order.append(w)
        steps.append(lcp[w])
        i = at[w] = at[w] + 1
        run = runs[w]
        if i < len(run):
            key[w], lcp[w] = run[i], shared[w][i]
        else:
            key[w] = None
        node = (w + size) >> 1
        while node:
            other = tree[node]
            y = key[other]
            if y is not None:
                x = key[w]
                if x is None:
                    tree[node], w = w, other
                else:
                    p, q = lcp[w], lcp[other]
                    if q > p or (q == p and not beats(w, other)):
                        tree[node], w = w, other
            node >>= 1
        winner = w
    return order, steps


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """All runs of one partition of keys: the covered byte ranges, by chunk: (part, chunk, blob) with document, number among its rows, start, length."""
    pdf = pdf.sort_values("chunk")
    got = [unpack(b) for b in pdf["blob"]]
    runs = [_decode(*g[:4]) for g in got]
    order, steps = merge_runs(runs, [g[0].tolist() for g in got])
    order, steps = np.array(order, np.int64), np.array(steps, np.int64)
    key_class = np.cumsum(steps < KEY) - 1
    class_of = key_class[np.argsort(order, kind="stable")]  # of all keys, run by run
    times = np.concatenate([g[4] for g in got])
    entry_class = np.repeat(class_of, times)
    entry_doc = np.concatenate([g[5] | (g[6] << 32) for g in got])
    entry_nth = np.concatenate([g[7] for g in got])
    entry_pos = np.concatenate([g[8] for g in got])
    entry_chunk = np.repeat(pdf["chunk"].to_numpy(np.int64), [len(g[5]) for g in got])
    n = int(key_class[-1]) + 1
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, entry_class, entry_doc)
    first = np.flatnonzero(steps < KEY)
    anchor = np.cumsum(steps[first] < K) - 1
    head = [runs[r][i] for r, i in zip(order[first].tolist(), (rank_in_run(order, first)).tolist())]
    key = np.frombuffer(b"".join(head), np.uint8).reshape(n, KEY)
    right, left = key[:, -2].astype(np.int64), key[:, -1].astype(np.int64) - 1
    # Windows start `a` bytes before the anchor, a from `near` to `far`.
    near, far = np.maximum(MATCH - right, 0), np.minimum(left, BEFORE)
    low, high = np.full(n, 1 << 30), np.full(n, -1)  # for the smallest document of a class: the windows that other classes hold in a smaller one
    many = np.bincount(anchor)[anchor] > 1
    if many.any():
        m = np.flatnonzero(many)
        sub, doc, r, l = key[m], smallest[m], right[m], left[m]
        mix = lambda h, b: ((h ^ (h >> np.uint64(31))) + b.astype(np.uint64) + np.uint64(1)) * _M1
        fwd = [anchor[m].astype(np.uint64) * _M2]
        for i in range(K, MATCH):
            fwd.append(mix(fwd[-1], sub[:, i]))
        back = [np.zeros(len(m), np.uint64)]
        for i in range(BEFORE):
            back.append(mix(back[-1], sub[:, MATCH + i]))
        for a in range(BEFORE + 1):
            ok = np.flatnonzero((l >= a) & (r >= MATCH - a))
            if not len(ok):
                continue
            h = fwd[BEFORE - a][ok] * _M3 + back[a][ok]
            h = (h ^ (h >> np.uint64(32))) * _M2
            by = np.argsort(h, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
            least = np.empty(len(ok), np.int64)
            least[by] = np.repeat(np.minimum.reduceat(doc[ok][by], cut), np.diff(np.concatenate([cut, [len(ok)]])))
            hit = m[ok[least < doc[ok]]]
            low[hit] = np.minimum(low[hit], a)
            high[hit] = a
    late = entry_doc > smallest[entry_class]
    a_low, a_high = np.where(late, near[entry_class], low[entry_class]), np.where(late, far[entry_class], high[entry_class])
    use = a_low <= a_high
    chunk, doc, nth = entry_chunk[use], entry_doc[use], entry_nth[use]
    start, stop = (entry_pos - a_high)[use], (entry_pos - a_low + MATCH)[use]
    by = np.lexsort((start, nth, doc, chunk))
    chunk, doc, nth, start, stop = chunk[by], doc[by], nth[by], start[by], stop[by]
    cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
    p = int(pdf["part"].iloc[0])
    rows = [(p, int(chunk[a]), pack(doc[a:b] & 0xFFFFFFFF, (doc[a:b] >> 32) & 0xFFFFFFFF, nth[a:b], start[a:b], stop[a:b] - start[a:b])) for a, b in zip(cut, np.concatenate([cut[1:], [len(chunk)]]))]
    return pd.DataFrame(rows, columns=["part", "chunk", "blob"]).astype({"part": "int32", "chunk": "int64"})


def rank_in_run(order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For places `at` of a merged order of runs: the number of the key within its run."""
    by = np.argsort(order, kind="stable")
    sizes = np.bincount(order)
    inside = np.empty(len(order), np.int64)
    inside[by] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return inside[at]


def _cut_out(texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if texts else 5]

    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame([], columns=names)
        copies, rows = found["part"] == COPIES, []
        chunk = _Chunk(docs, found["blob"][copies].tolist())
        got = [unpack(b) for b in found["blob"][~copies]]
        low, up, nth, start, wide = (np.concatenate([g[i] for g in got] or [np.zeros(0, np.int64)]) for i in range(5))
        row = np.searchsorted(chunk.ids, low | (up << 32), side="left") + nth
        order = np.argsort(row, kind="stable")
        row, start, wide = row[order], start[order], wide[order]
        cut = np.searchsorted(row, np.arange(len(chunk.ids) + 1))
        for k, (i, raw) in enumerate(zip(chunk.ids.tolist(), chunk.raws)):
            n, removed, spans, kept = len(raw), 0, 0, raw
            a, b = cut[k], cut[k + 1]
            if chunk.copy[k]:
                removed, spans, kept = n, 1, b""
            elif a < b:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, start[a:b] + wide[a:b], -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed = int(gone.sum())
                spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((i, n, removed, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if texts else ()))
        return pd.DataFrame(rows, columns=names)

    return run


def suffix_dedup(docs: DataFrame, texts: bool = False, chunk_factor: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with texts: kept, the bytes left) of every row of docs (doc_id, text).

    Removed is each byte covered by a string of MATCH bytes that also starts in a document with a smaller doc_id, judged on the input. Null text counts as empty; rows without doc_id neither lose bytes nor take any from others;
    rows with the same doc_id don't count as each other's smaller document. Texts under MATCH bytes stay. Documents are hashed into chunks of bounded size, and a chunk's texts are shuffled once. What else is shuffled are hashes of anchors without their places, and keys of repeated ones, in a blob for each chunk and range.
    """
    splits = partitions(docs)
    hashed, parts = int(min(max(splits, 8), 1 << 19)), int(min(max(2 * splits, 8), 1 << 20))
    chunks = int(max(8, splits * chunk_factor))
    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(chunks)).cast("long").alias("chunk"))
    texts_of, passed = plain.groupBy("chunk"), "part int, chunk long, blob binary"
    long = plain.where(F.octet_length("text") >= MATCH).select("chunk", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    copies = long.withColumn("least", F.min("doc_id").over(Window.partitionBy("digest"))).where("doc_id > least")
    copies = copies.select(F.lit(COPIES).alias("part"), "chunk", F.concat("digest", F.col("doc_id").cast("string").cast("binary")).alias("blob"))
    found = texts_of.cogroup(copies.groupBy("chunk")).applyInPandas(_find_anchors(hashed), passed)
    repeated = found.groupBy("part").applyInPandas(_keep_repeated, passed)
    runs = texts_of.cogroup(repeated.unionByName(copies).groupBy("chunk")).applyInPandas(_sorted_runs(hashed, parts), passed)
    ranges = runs.groupBy("part").applyInPandas(_merge, passed)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    out = texts_of.cogroup(ranges.unionByName(copies).groupBy("chunk")).applyInPandas(_cut_out(texts), schema)
    raw, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    rest = [F.lit(None).cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256")]
    return out.unionByName(docs.where("doc_id IS NULL").select(*rest, *([raw.cast("binary").alias("kept")] if texts else [])))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
