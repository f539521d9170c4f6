"""Word co-occurrence graphs from token corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle
from .graph import numbered

#: Bytes of frequent words (with 24 a word for hashes and places) up to which every worker holds them all.
SMALL_VOCABULARY = 192 << 20
LOW = (1 << 31) - 1


def word_frequency(corpus: DataFrame, min_count: int = 5) -> DataFrame:
    """(word, freq) of words that occur at least min_count times. corpus: (line, tokens)."""
    return corpus.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_count)


#: Distinct pairs that a worker adds up before it hands them on.
HELD_PAIRS = 1 << 20


def word_pairs(corpus: DataFrame, window: int = 5, min_count: int = 5) -> DataFrame:
    """(u, v, n): how often v follows u within the window, after rare words are gone.

    Rare words go first, then positions close up. Pairs are counted and shuffled as numbers.
    """
    words = Vocabulary(corpus, min_count)
    return words.named(words.pairs(corpus, window, False).groupBy("pair").agg(F.sum("n").alias("n")))


def _first() -> Column:
    return F.shiftright("pair", 31)


def _second() -> Column:
    return F.col("pair").bitwiseAND(F.lit(LOW))


class Vocabulary:
    """Frequent words, numbered in the order of a hash: frequent has (word, h, id).

    While their bytes are few, every worker holds the sorted hashes, makes pairs within the lines where they are and adds them up; a token is known by its hash, so this takes that no two words of
    the corpus, one of them frequent, share one, which is looked at. Else words are joined, and pairs come from lead() at each distance in one sort, not from a band join.
    """

    def __init__(self, corpus: DataFrame, min_count: int):
        words = settle(word_frequency(corpus, 1).withColumn("h", F.xxhash64("word")))
        frequent = words.where(F.col("freq") >= min_count).select("word", "h")
        self.frequent = settle(numbered(frequent, [F.col("h"), F.col("word")]).withColumnRenamed("__at", "id"))
        size = self.frequent.agg(F.sum(F.octet_length("word") + 24)).first()[0] or 0
        shared = words.groupBy("h").agg(F.count("*").alias("n"), F.max("freq").alias("most")).where((F.col("n") > 1) & (F.col("most") >= min_count))
        self.sent = None
        if size <= SMALL_VOCABULARY and not shared.limit(1).count():
            held = self.frequent.select("id", "h", "word").toArrow().sort_by("id")  # at most SMALL_VOCABULARY bytes
            self.sent = corpus.sparkSession.sparkContext.broadcast((held["h"].to_numpy(), held["word"].combine_chunks().cast(pa.large_string())))

    def pairs(self, corpus: DataFrame, window: int, either_way: bool) -> DataFrame:
        """(pair, n): both ids in one number, counted within a worker or not yet at all; either_way: the smaller id first."""
        return _joined_pairs(corpus, self.frequent, window, either_way) if self.sent is None else _pairs_in_place(corpus, self.sent, window, either_way)

    def named(self, pairs: DataFrame) -> DataFrame:
        """(u, v, n) from (pair, n)."""
        if self.sent is None:
            of = lambda c: self.frequent.select(F.col("id").alias(f"__{c}"), F.col("word").alias(c))
            return pairs.withColumn("__u", _first()).withColumn("__v", _second()).join(of("u"), "__u").join(of("v"), "__v").select("u", "v", "n")
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pair, words = batch.column("pair").to_numpy(zero_copy_only=False), sent.value[1]
                u, v = (words.take(pa.array(x)).cast(pa.string()) for x in (pair >> 31, pair & LOW))
                yield pa.RecordBatch.from_arrays([u, v, batch.column("n")], ["u", "v", "n"])

        return pairs.select("pair", "n").mapInArrow(run, "u string, v string, n long")


def _pairs_in_place(corpus: DataFrame, sent, window: int, either_way: bool) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[0]
        held, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([held, *waiting]), np.concatenate([counts, np.ones(sum(map(len, waiting)), np.int64)])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                column = batch.column("h").slice(s, 1000)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                at = np.searchsorted(known, flat)
                kept = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == flat) if len(known) else np.zeros(0, np.int64)
                ids, of = at[kept], of[kept]
                for k in range(1, window + 1):
                    if len(ids) > k:
                        same = of[:-k] == of[k:]
                        u, v = ids[:-k][same], ids[k:][same]
                        waiting.append((np.minimum(u, v) << 31 | np.maximum(u, v)) if either_way else u << 31 | v)
                if sum(map(len, waiting)) >= HELD_PAIRS:
                    held, counts = added()
                    waiting = []
                    if len(held) >= HELD_PAIRS:
                        yield rows()
                        held, counts = held[:0], counts[:0]
        held, counts = added()
        yield rows()

    return corpus.select(F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")).mapInArrow(count, "pair long, n long")


def _joined_pairs(corpus: DataFrame, frequent: DataFrame, window: int, either_way: bool) -> DataFrame:
    placed = corpus.select("line", F.posexplode("tokens").alias("pos", "word"))
    kept = placed.join(frequent, "word").select("line", "pos", "id")
    along = Window.partitionBy("line").orderBy("pos")
    ahead = kept.select(F.col("id").alias("u"), *[F.lead("id", k).over(along).alias(f"v{k}") for k in range(1, window + 1)])
    pairs = ahead.select("u", F.explode(F.array(*[f"v{k}" for k in range(1, window + 1)])).alias("v")).where("v IS NOT NULL")
    first, second = (F.least("u", "v"), F.greatest("u", "v")) if either_way else (F.col("u"), F.col("v"))
    return pairs.select(F.shiftleft(first, 31).bitwiseOR(second).alias("pair"), F.lit(1).cast("long").alias("n"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Entries of both directions of pairs that are counted either way; a word next to itself counts twice."""
    there, back = F.struct("u", "v", "n"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "n")
    twice = F.struct("u", "v", (F.col("n") * 2).alias("n"))
    return pairs.select(F.inline(F.when(F.col("u") == F.col("v"), F.array(twice)).otherwise(F.array(there, back))))


def word_graph(corpus: DataFrame, window: int = 5, min_count: int = 5) -> DataFrame:
    """(src, dst, weight): symmetric co-occurrence; a word next to itself counts twice. One shuffle of pairs, as numbers, counted either way."""
    words = Vocabulary(corpus, min_count)
    counted = words.pairs(corpus, window, True).groupBy("pair").agg(F.sum("n").alias("n"))
    return _both_ways(words.named(counted)).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("n").cast("double").alias("weight"))


def word_degrees(corpus: DataFrame, window: int = 5, min_count: int = 5) -> DataFrame:
    """(id, weight): weighted degrees of word_graph(). Each pair adds to both its words; pairs themselves are never gathered."""
    words = Vocabulary(corpus, min_count)
    ends = words.pairs(corpus, window, True).select(F.explode(F.array(_first(), _second())).alias("id"), "n")
    sums = ends.groupBy("id").agg(F.sum("n").cast("double").alias("weight"))
    return sums.join(words.frequent, "id").select(F.col("word").alias("id"), "weight")


def word_occurrences(corpus: DataFrame, window: int = 5, min_count: int = 5) -> DataFrame:
    """(src, dst, weight): an entry for each occurrence and direction, not merged. Counts of a worker are written out where they are: no pair is shuffled while workers hold the words."""
    words = Vocabulary(corpus, min_count)
    both = _both_ways(words.named(words.pairs(corpus, window, True)))
    return both.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.explode(F.array_repeat(F.lit(1.0), F.col("n").cast("int"))).alias("weight"))
