"""Quality classifier on supervised subword embeddings (operator 6).

Words, pairs of neighbouring words and character n-grams are hashed to rows of an embedding table; a document is the average of the rows of
all its features, and a softmax layer gives the class. Table and layer are learned with plain numpy stochastic
gradient descent. Learning takes a bounded sample: at most MAX_TRAIN labelled documents, half of each class, those with the
smallest hash of their id. Scoring covers all documents and needs only one number a feature, because the layer is
linear in the average.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import flagged, give_back, pack, read, unflagged, unpack

BUCKETS = 1 << 18
DIM = 16
MAX_TRAIN = 4000
EPOCHS = 3
PRIOR = 64
RATE = 0.5
THRESHOLD = 0.7
HELD_OUT = 2
_CACHE_WORDS = 200_000
#: Bytes of words that are cut into n-grams at once; longer words are counted in pieces.
_AT_ONCE = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: F.Column = None):
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 4 == HELD_OUT


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _buckets(x: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets from 2 on; 0 is the feature every text has, 1 that of a word said twice in a row."""
    x = x * _MIX
    x ^= x >> np.uint64(29)
    return (((x * _MIX) >> np.uint64(32)) % np.uint64(buckets - 2) + np.uint64(2)).astype(np.int32)


def word_features(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their byte 3- and 4-grams with the ends marked: (all in a row by word, how many a word has)."""
    marked = [b"<" + w + b">" for w in words]
    at = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner, found = [np.arange(len(words))], [_buckets(_word_hashes(words), buckets)]
    for n in (3, 4):
        if len(b) >= n:
            inside = at[: len(b) - n + 1] == at[n - 1 :]
            gram = sum((b[i : len(b) - n + 1 + i] << np.uint64(8 * i) for i in range(n)), np.uint64(n) << np.uint64(40))
            owner.append(at[: len(b) - n + 1][inside])
            found.append(_buckets(gram[inside], buckets))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(words))


def long_word_features(word: bytes, buckets: int = BUCKETS, step: int = _AT_ONCE) -> np.ndarray:
    """How often each bucket occurs among the features of one word, as word_features() finds them, in memory that doesn't grow with the word."""
    out = np.bincount(_buckets(_word_hashes([word]), buckets), minlength=buckets)
    marked = b"<" + word + b">"
    for n in (3, 4):
        for at in range(0, len(marked) - n + 1, step):
            b = np.frombuffer(marked[at : at + step + n - 1], np.uint8).astype(np.uint64)
            gram = sum((b[i : len(b) - n + 1 + i] << np.uint64(8 * i) for i in range(n)), np.uint64(n) << np.uint64(40))
            out += np.bincount(_buckets(gram, buckets), minlength=buckets)
    return out


def portions(words: list[bytes], size: int = _AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of words of at most `size` bytes together; a longer word is a range of its own."""
    start = held = 0
    for i, w in enumerate(words):
        if i > start and held + len(w) > size:
            yield start, i
            start, held = i, 0
        held += len(w)
    if words:
        yield start, len(words)


def pair_features(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of neighbouring words; a word that follows itself has a bucket of its own, whatever the word."""
    out = _buckets(hashes[:-1] * _MIX + hashes[1:], buckets)
    out[hashes[:-1] == hashes[1:]] = 1
    return out


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def bag(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a text and their counts; the feature every text has counts PRIOR times, so short texts lean on it."""
    ws = split(text)
    if not ws:
        return np.zeros(1, np.int32), np.full(1, PRIOR, np.int32)
    times = Counter(ws)
    words, often = list(times), np.fromiter(times.values(), np.int64, len(times))
    total = np.bincount(pair_features(_word_hashes(ws), buckets), minlength=buckets)
    for i, j in portions(words):
        if len(words[i]) > _AT_ONCE:
            total += often[i] * long_word_features(words[i], buckets)
        else:
            flat, per = word_features(words[i:j], buckets)
            total += np.bincount(flat, weights=np.repeat(often[i:j], per), minlength=buckets).astype(np.int64)
    total[0] = PRIOR
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.int32)


class Bags:
    """Bags of the learning rows, each packed until it is used."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        steps, n = unpack(self.packed[i])
        return np.cumsum(steps), n


def fit(bags: Bags | list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn table and softmax layer; returns (one score a bucket, bias), all that scoring needs."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, n = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            weight = (n / n.sum(dtype=np.int64)).astype(np.float32)
            rows = table[ids]
            mean = weight @ rows
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[labels[i]] -= 1
            back = g @ layer
            layer -= lr * np.outer(g, mean)
            bias -= lr * 0.1 * g
            # Features that fill a document get its whole step, rare ones a share: scaled by the largest weight.
            table[ids] = rows - np.outer(np.float32(lr) / weight.max() * weight, back)
    return (table @ (layer[1] - layer[0])).astype(float), float(bias[1] - bias[0])


def calibrate(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and shift of the logits (Platt) on the learning rows, class 1 weighing its share of all labels."""
    a, b = 1.0, 0.0
    y = labels.astype(float)
    w = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        r, s = w * (p - y), w * p * (1 - p)
        grad = np.array([(r * logits).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(s * logits * logits).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-6]])
        d = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - float(d[0]), b - float(d[1])
        if abs(d).max() < 1e-6:
            break
    return a, b


class Model:
    """One score a bucket, bias and calibration; scores texts in batches and remembers the sums of words it has met."""

    def __init__(self, score: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.score, self.bias, self.scale, self.shift = score, bias, scale, shift
        self._forget()

    def _forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._sums, self._counts, self._hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def __getstate__(self):
        return self.score.astype(np.float32), self.bias, self.scale, self.shift

    def __setstate__(self, state):
        self.__init__(state[0].astype(float), *state[1:])

    def _learn_words(self, fresh: list[bytes]) -> None:
        n = len(self._index)
        self._index.update(zip(fresh, range(n, n + len(fresh))))
        sums, counts = [self._sums], [self._counts]
        for i, j in portions(fresh):
            if len(fresh[i]) > _AT_ONCE:
                times = long_word_features(fresh[i], len(self.score))
                sums.append([times @ self.score])
                counts.append([times.sum()])
            else:
                flat, per = word_features(fresh[i:j], len(self.score))
                sums.append(np.add.reduceat(self.score[flat], np.concatenate([[0], np.cumsum(per)[:-1]])))
                counts.append(per)
        self._sums, self._counts = np.concatenate(sums), np.concatenate(counts)
        self._hashes = np.concatenate([self._hashes, _word_hashes(fresh)])

    def probabilities(self, texts) -> np.ndarray:
        """Score of every text, 0 to 1."""
        split_texts = [split(t) for t in texts]
        sizes = np.array([len(ws) for ws in split_texts], np.int64)
        total, n = np.full(len(sizes), PRIOR * self.score[0]), np.full(len(sizes), float(PRIOR))
        words = list(chain.from_iterable(split_texts))
        if words:
            fresh = [w for w in set(words) if w not in self._index]
            if len(fresh) + len(self._index) > _CACHE_WORDS:
                self._forget()
                fresh = list(set(words))
            if fresh:
                self._learn_words(fresh)
            at = np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pairs = self.score[pair_features(self._hashes[at], len(self.score))] * (owner[:-1] == owner[1:])
            total += np.bincount(owner, self._sums[at], len(sizes)) + np.bincount(owner[:-1], pairs, len(sizes))
            n += np.bincount(owner, self._counts[at], len(sizes)) + np.maximum(sizes - 1, 0)
        return 1 / (1 + np.exp(-np.clip(self.scale * (total / n + self.bias) + self.shift, -500, 500)))

    def batches(self, texts, chars: int = 1 << 21) -> np.ndarray:
        """probabilities() in pieces of about `chars` characters, which bounds the memory of a batch of long texts."""
        out, piece, size = [np.zeros(0)], [], 0
        for t in texts:
            piece.append(t)
            size += len(t or "")
            if size >= chars:
                out.append(self.probabilities(piece))
                piece, size = [], 0
        return np.concatenate([*out, self.probabilities(piece)] if piece else out)


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most max_train labelled documents outside the held-out fold.

    Rows without id or quality don't count; an id with several labels takes the smallest, one with several texts a fixed one of them. Without any usable label the model scores every text 0.5.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("__y"))
    share = known.agg(F.avg("__y")).first()[0]
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["__y"], "bag": [pack(np.diff(ids, prepend=0), n) for ids, n in map(bag, pdf["text"])]})

    got = rows.mapInPandas(bags, "doc_id long, y int, bag binary").toPandas().sort_values(["doc_id", "bag"]).drop_duplicates("doc_id")
    if not len(got):
        return Model(np.zeros(BUCKETS), 0.0)
    made, y = Bags(got["bag"].to_list()), got["y"].to_numpy()
    del got
    give_back()
    model = Model(*fit(made, y))
    logits = np.array([(n.astype(float) @ model.score[ids]) / n.sum(dtype=np.int64) + model.bias for ids, n in (made[i] for i in range(len(made)))])
    if 0 < y.sum() < len(y):
        model.scale, model.shift = calibrate(logits, y, share)
    return model


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; null and empty texts get the score of a text without features."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            s = m.batches(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32), "__null": pdf["__null"]})
        m._forget()
        give_back()

    rows = flagged(docs, F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return unflagged(rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, __null boolean"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose text the classifier accepts, all columns as they were (rows travel as Arrow, so nothing is converted)."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.batches(batch.column("text").to_pylist()) >= threshold))
        sent.value._forget()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, learn(docs, read(spark, sf_dir, "labels")))
