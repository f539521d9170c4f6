"""MinHash near-duplicates: banding, signature and full-set verification, components (operator 8).

Documents with the same shingle set form a class, and only its smallest document goes on. Class representatives whose
signature agrees in a whole band fall into one bucket. A bucket never emits all its pairs: each member is first compared with the bucket's smallest one. Only where
the links found so far leave members of a bucket in different components are their signatures compared across these components as well, in blocks of bounded size that put
out the pairs which may be similar enough alone, so that no link that could join two components is lost. Pairs are confirmed on full sets, whose shingles are hashed with
another seed than those of the signatures: a false link would need collisions in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, flagged, give_back, materialize, mixed, read, span_hashes, unflagged
from .components import connected_components

BANDS, ROWS = 20, 4
NEAR_SIGNATURE = 0.6
MEMBERS_A_SALT = 256
BUCKET_BLOCK = 1024
SIGN_SEED, SET_SEED = 0, 77
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_A = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
BATCH_BYTES = 1 << 21
FILTER_BITS = 1 << 25
_tables: dict = {}


def _word_table(texts: list[str | None], seed: int = SIGN_SEED) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words a text) of texts, A-Z lower-cased, vectorised over their bytes."""
    raws = [t.encode("utf-8", "surrogatepass").translate(_LOWER) if t else b"" for t in texts]
    raw = b" ".join([b"", *raws, b""])
    word = ~_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum([len(r) + 1 for r in raws])
    return span_hashes(raw, start, stop, seed), np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def _shingles(h: np.ndarray, sizes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its shingles by place."""
    at = 0
    for n in sizes.tolist():
        ws = h[at : at + n]
        at += n
        if not n:
            yield np.zeros(0, np.uint64)
        elif n < k:
            out = np.full(1, n, np.uint64)
            for x in ws:
                out = (out ^ x) * _A
                out ^= out >> np.uint64(32)
            yield out
        else:
            out = ws[: n - k + 1].copy()
            for i in range(1, k):
                out ^= out >> np.uint64(32)
                out *= _A
                out += ws[i : n - k + 1 + i]
            out ^= out >> np.uint64(29)
            out *= _A
            out ^= out >> np.uint64(32)
            yield out


def _pieces(texts) -> Iterator[list]:
    """Texts in pieces of about half of BATCH_BYTES characters."""
    piece, size = [], 0
    for t in texts:
        piece.append(t)
        size += len(t or "")
        if size >= BATCH_BYTES // 2:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def shingle_sets(texts, k: int = 4, seed: int = SIGN_SEED) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; with fewer words, one of the whole sequence; without words, none."""
    for piece in _pieces(texts):
        for h in _shingles(*_word_table(piece, seed), k):
            yield np.unique(h)


def named_sets(texts, k: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(shingle set, 128-bit name of the set): the name comes from hashes under both seeds."""
    for piece in _pieces(texts):
        for h, other in zip(_shingles(*_word_table(piece, SIGN_SEED), k), _shingles(*_word_table(piece, SET_SEED), k)):
            h, first = np.unique(h, return_index=True)
            total = mixed(other[first]).sum(dtype=np.uint64)
            yield h, hashlib.blake2b(h.tobytes() + total.tobytes(), digest_size=16).digest()


def shingles(text: str | None, k: int = 4) -> np.ndarray:
    return next(shingle_sets([text], k))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(h: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Minima of n universal (multiply-shift) hash functions over a set."""
    if n not in _tables:
        _tables[n] = *_functions(n), np.empty((n, 1024), np.uint64)
    a, b, room = _tables[n]
    out = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(h), 1024):
        part = h[i : i + 1024]
        x = np.multiply(a[:, None], part[None], out=room[:, : len(part)])
        x += b[:, None]
        np.minimum(out, x.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sign(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, null, (h, name) in zip(pdf["doc_id"], pdf["__null"], named_sets(pdf["text"], k)):
                if not len(h):
                    rows.append((doc, 0, None, None, None, null))
                    continue
                s = signature(h)
                bands = [xxhash.xxh3_64_intdigest(s[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, len(s), ROWS)]
                rows.append((doc, len(h), name, s.tobytes(), bands, null))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "sig", "bands", "__null"])
        give_back()

    return run


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size in which the bit of every id of (doc_id) is set: other ids mostly miss it. At most FILTER_BITS / 64 words reach the driver."""
    pos = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(pos, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, 11), {FILTER_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _sets(k: int, bits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pos = pdf["pos"].to_numpy(np.int64)
            pdf = pdf[(bits.value[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "hashes": [h.tobytes() for h in shingle_sets(pdf["text"], k, SET_SEED)]})
        give_back()

    return run


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose signatures agree often enough."""
    for pdf in batches:
        if len(pdf):
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(len(pdf), -1) for c in ("sig_u", "sig_v"))
            yield pdf.loc[((a == b).mean(1) >= NEAR_SIGNATURE), ["u", "v"]]


def _confirm(threshold: int):
    """Rows sorted by (u, salt, other): the set of u, then those of its partners; yields the pairs that are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, at = None, None
        for pdf in batches:
            out = []
            for u, salt, v, other, hashes in zip(pdf["u"], pdf["salt"], pdf["v"], pdf["other"], pdf["hashes"]):
                h = np.frombuffer(hashes, np.uint64)
                if not other:
                    base, at = h, (u, salt)
                    continue
                if at != (u, salt):
                    raise ValueError("the set of a pair's first document is missing")
                place = np.minimum(np.searchsorted(base, h), len(base) - 1)
                common = int((base[place] == h).sum())
                if 100 * common >= threshold * (len(base) + len(h) - common):
                    out.append((u, v))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _compare_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (band, h, i, j): the members of two blocks of a bucket (of one, where i = j). Pairs of different components whose signatures agree often enough."""

    def pairs(rows: list[tuple]) -> pd.DataFrame:
        (i, j), rep, part = rows[0][0][2:], *(np.array([r[n] for r in rows], np.int64) for n in (1, 2))
        block = np.array([r[3] for r in rows], np.int64)
        sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), -1)
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        us, vs = [], []
        for a in one.tolist():
            with_ = two[(part[two] != part[a]) & ((rep[two] > rep[a]) if i == j else True)]
            with_ = with_[(sig[with_] == sig[a]).mean(1) >= NEAR_SIGNATURE]
            us.append(np.minimum(rep[with_], rep[a]))
            vs.append(np.maximum(rep[with_], rep[a]))
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}) if us else pd.DataFrame({"u": [], "v": []}, dtype="int64")

    at, rows = None, []
    for pdf in batches:
        for *key, rep, part, block, sig in pdf[["band", "h", "i", "j", "rep", "part", "block", "sig"]].itertuples(index=False, name=None):
            if key != at:
                if rows:
                    yield pairs(rows)
                at, rows = key, []
            rows.append((key, rep, part, block, sig))
    if rows:
        yield pairs(rows)


def _across(open_: DataFrame, sigs: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) of different parts within the buckets of open_ (band, h, rep, part). A bucket is cut into blocks, and each pair of blocks is a group of its own."""
    blocks = open_.groupBy("band", "h").agg(F.ceil(F.count("*") / F.lit(float(BUCKET_BLOCK))).alias("blocks"))
    rows = open_.join(blocks, ["band", "h"]).join(sigs.withColumnRenamed("doc_id", "rep"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", "h", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "rep", "part", "block", "sig")
    return rows.repartition("band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j").mapInPandas(_compare_blocks, "u long, v long").distinct()


def _verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (u, v) of documents whose shingle sets are similar enough, as a written table."""
    near = pairs.join(sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("sig_u")), "u").join(sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("sig_v")), "v")
    near = materialize(near.mapInPandas(_agree, "u long, v long"), "minhash-near")
    salts = near.groupBy("u").agg(F.ceil(F.count("*") / F.lit(float(MEMBERS_A_SALT))).alias("salts"))
    wanted = near.select(F.col("u").alias("doc_id")).union(near.select("v")).distinct()
    # Sets are made where the texts are and only those that a pair may ask for are shuffled; the bit array has a fixed size.
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))
    pos = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FILTER_BITS)).alias("pos")
    sets = docs.select("doc_id", "text", pos).mapInPandas(_sets(k, bits), "doc_id long, hashes binary").dropDuplicates(["doc_id"])
    use = near.join(salts, "u").select("u", "v", F.pmod(F.xxhash64("v"), "salts").alias("salt"))
    use = use.select("u", "v", "salt", F.lit(True).alias("other"), F.col("v").alias("doc_id"))
    own = salts.select("u", F.col("u").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("other"), F.col("u").alias("doc_id"))
    rows = use.unionByName(own).join(sets, "doc_id")
    rows = rows.select("u", "salt", "v", "other", "hashes").repartition("u", "salt").sortWithinPartitions("u", "salt", "other")
    out = materialize(rows.mapInPandas(_confirm(threshold), "u long, v long"), "minhash-links")
    discard(near)
    return out


def near_duplicates(docs: DataFrame, k: int = 4, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Words are separated by white space, A-Z are lower-cased. Two documents are linked when 100 * common >= threshold * united shingles;
    component_id is the smallest doc_id reachable over links. Documents without words (null, empty) link with nothing. Copies share a class. Rows with
    the same doc_id are taken for the same document. Rows without doc_id link with nothing but their copies and stay unless they are one of them. With 20 bands of 4 minima a link at 0.8 is missed
    with probability 3e-5, at 0.9 with 1e-9.
    """
    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = flagged(docs).mapInPandas(_sign(k), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>, __null boolean")
    signed = materialize(unflagged(signed), "minhash-signed")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialize(classes, "minhash-classes")
    sigs = classes.select(F.col("rep").alias("doc_id"), "sig")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(banded.join(buckets, ["band", "h"]), "minhash-members")
    stars = members.where("rep <> leader").select(F.col("leader").alias("u"), F.col("rep").alias("v")).distinct()
    links = _verified(stars, sigs, plain, k, threshold)
    parts = materialize(connected_components(links), "minhash-parts")

    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).select("band", "h", "rep", "leader", "part")
    open_ = placed.join(placed.groupBy("band", "h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band", "h"), ["band", "h"])
    across = materialize(_across(open_.select("band", "h", "rep", "part"), sigs).join(stars, ["u", "v"], "left_anti"), "minhash-across")
    if not across.isEmpty():
        more = _verified(across, sigs, plain, k, threshold)
        if not more.isEmpty():
            parts = connected_components(links.unionByName(more))
    of_class = classes.select("set_key", "rep").join(parts, classes["rep"] == parts["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """Rows of docs that are the first of their group, all columns as they were."""
    gone = near_duplicates(docs, k, threshold).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 4, 80)
