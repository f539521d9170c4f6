"""Line deduplication by winnowing over line hashes (operator 3).

The lines of a document are hashed, and of every window of lines the line with the smallest hash is chosen as a fingerprint,
so two documents that share a window share a fingerprint in it. Fingerprints that occur once are dropped. The places of the others are joined: a place
with the lines before and behind it that its windows reach meets the first place of that fingerprint with the same lines around it. So matches are extended line by line
both ways, over the window itself and from there over the windows of the next fingerprints, to maximal runs, which are deleted at every place but the first. Fewer lines
that hold many words are a window, too. Lines are told apart by 128 bits of a cryptographic hash, which stands for their spelling.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, give_back, materialize, mixed, read

WINDOW = 3
LONG_LINE = 40
#: A key with more than one in HOT of all rows is hot: at most HOT of them, which are joined by broadcast.
HOT = 1000


def line_units(text: str | None) -> tuple[list[str], list[int], list[str]]:
    """Lines of a text; of those that aren't blank the positions, and what they hold without outer white space."""
    lines = text.split("\n") if text else []
    bare = [line.strip() for line in lines]
    at = [i for i, line in enumerate(bare) if line]
    return lines, at, [bare[i] for i in at]


def _digests(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, digest as two numbers, words) of all lines of texts that aren't blank; places count these lines only."""
    found = [line_units(t)[2] for t in texts]
    per = np.array([len(f) for f in found], np.int64)
    digest = np.frombuffer(b"".join([blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for f in found for x in f]), "<u8").reshape(-1, 2)
    words = np.fromiter((len(x.split()) for f in found for x in f), np.int64, len(digest))
    first = np.cumsum(per) - per
    return np.repeat(np.arange(len(per)), per), np.arange(len(digest)) - np.repeat(first, per), digest, words


def windows(texts, w: int, long_line: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, fingerprint, its place, window hash as two numbers) of all windows of texts, the fingerprint being the smallest line hash.

    Windows are w lines on end, and the shortest runs of fewer lines that hold long_line words: those that fall below it without their first or last line.
    """
    owner, place, digest, words = _digests(texts)
    least, upto, out = max(1, long_line), np.concatenate([[0], np.cumsum(words)]), []
    for n in range(1, w + 1):
        if len(owner) < n:
            break
        at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        if n < w:
            total = upto[at + n] - upto[at]
            at = at[(total >= least) & (total - words[at] < least) & (total - words[at + n - 1] < least)]
        low, where = digest[at, 0], at.copy()
        for i in range(1, n):
            smaller = digest[at + i, 0] < low
            low, where = np.where(smaller, digest[at + i, 0], low), np.where(smaller, at + i, where)
        one, two = np.full(len(at), n, np.uint64), np.full(len(at), n, np.uint64)
        for i in range(n):
            one, two = mixed(one) + digest[at + i, 0], mixed(two) + digest[at + i, 1]
        out.append((owner[at], place[at], np.full(len(at), n), low.view(np.int64), place[where], mixed(one).view(np.int64), mixed(two).view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(7))


def _fingerprints(w: int, long_line: int):
    """Per chosen fingerprint of a batch: fp, how many places it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, _, _, fp, place, _, _ = windows(pdf["text"], w, long_line)
            chosen = np.unique(np.rec.fromarrays([fp, text, place])) if len(fp) else np.rec.fromarrays([fp, text, place])
            fp, n = np.unique(chosen["f0"], return_counts=True)
            yield pd.DataFrame({"fp": fp, "n": n.astype(np.int64)})
        give_back()

    return run


def _places(w: int, long_line: int):
    """Per window: its fingerprint, the document, where the window starts and ends, and the hash of its lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, start, n, fp, _, one, two = windows(pdf["text"], w, long_line)
            yield pd.DataFrame({"fp": fp, "__row": pdf["__row"].to_numpy(np.int64)[text], "start": start, "len": n, "w1": one, "w2": two})
        give_back()

    return run


def _split_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, how: str) -> DataFrame:
    """rows joined to keys (on, n, ...), where n counts a key's rows: hot keys, at most HOT of them, by broadcast, so that none gathers in a task."""
    hot = F.col("n") > max(total // HOT, 1)
    loud = F.broadcast(keys.where(hot))
    return rows.join(loud, on, how).unionByName(rows.join(loud, on, "left_anti").join(keys.where(~hot), on, how))


def delete_runs(text: str | None, starts, lens) -> tuple[str | None, int, int]:
    """(text without the lines of the given windows, lines deleted, maximal runs deleted)."""
    if not len(starts):
        return text, 0, 0
    lines, at, _ = line_units(text)
    gone = np.zeros(len(at) + 1, np.int64)
    for s, n in zip(starts, lens):
        gone[s : s + n] = 1
    drop = set(np.array(at)[gone[:-1] > 0].tolist())
    runs = int((np.diff(np.concatenate([[0], gone])) > 0).sum())
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop), runs


def later_windows(docs: DataFrame, w: int = WINDOW, long_line: int = LONG_LINE, order_col: str = "doc_id") -> DataFrame:
    """(doc, starts, lens): the windows of every document that have an earlier place, by (doc_id, line)."""
    plain = docs.where(F.col(order_col).isNotNull()).select(F.col(order_col).cast("long").alias("__row"), "text")
    counted = plain.select("text").mapInPandas(_fingerprints(w, long_line), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = materialize(counted, "lines-fingerprints")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    every = plain.mapInPandas(_places(w, long_line), "fp long, __row long, start long, len long, w1 long, w2 long")
    # Windows without a repeated fingerprint can't repeat: they go before anything is sorted.
    some = materialize(_split_join(every, repeated, ["fp"], total, "left_semi"), "lines-places")
    discard(repeated)
    window = ["fp", "len", "w1", "w2"]
    first = some.groupBy(*window).agg(F.min(F.struct("__row", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "lines-first")
    later = _split_join(some, first, window, first.agg(F.sum("n")).first()[0] or 0, "inner").where(F.struct("__row", "start") > F.col("first"))
    return later.groupBy("__row").agg(F.collect_list(F.struct("start", "len")).alias("w"))


def line_dedup(docs: DataFrame, w: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """docs with the text without later repeated runs, and n_lines, n_removed, n_runs (long).

    Lines are split at line feeds and compared without outer white space; blank lines are neither compared nor deleted. A run of at least w lines, or
    the shortest run of fewer lines with at least long_line words, is kept at its first place (smallest doc_id, then line) and deleted at later ones, also within one
    document, so no repeated run of that many lines or words stays whole. Null and empty texts stay as they are, and so do rows without doc_id, which aren't compared. Rows with the same doc_id are treated as copies of one document: what is deleted
    in one is deleted in all. Extra columns stay, whatever their names.
    """
    later = later_windows(docs, w, long_line).select(F.col("__row").alias("__doc"), F.col("w.start").alias("__starts"), F.col("w.len").alias("__lens"))
    joined = docs.join(later, docs["doc_id"].cast("long") == later["__doc"], "left").drop("__doc")
    added = {"n_lines": "long", "n_removed": "long", "n_runs": "long"}
    base = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, lens = (batch.column(c).to_pylist() for c in ("text", "__starts", "__lens"))
            made = [delete_runs(t, s or (), n or ()) for t, s, n in zip(texts, starts, lens)]
            new = {"text": pa.array([m[0] for m in made], pa.string()), "n_lines": [t.count("\n") + 1 if t else 0 for t in texts], "n_removed": [m[1] for m in made], "n_runs": [m[2] for m in made]}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in base} | {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in new.items()})
        give_back()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in base] + [f"{k} {v}" for k, v in added.items()])
    return joined.select(*base, "__starts", "__lens").mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs after line_dedup, same columns; documents that lose all their text go, n_chars follows the text."""
    out = line_dedup(docs).where("n_removed = 0 OR trim(BOTH ' \t\r\n' FROM text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text <> ''
), s AS (
  SELECT doc_id, i, line, regexp_replace(line, '^[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+|[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+$', '', 'g') AS bare FROM l
), u AS (
  SELECT doc_id, i, bare, len(regexp_extract_all(bare, '\\S+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM s WHERE bare <> ''
), w AS (
  SELECT doc_id, p AS start, 3 AS n, bare || chr(10) || lead(bare) OVER d || chr(10) || lead(bare, 2) OVER d AS win FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL SELECT doc_id, p, 1, bare FROM u WHERE words >= 40
  UNION ALL SELECT * FROM (SELECT doc_id, p, 2, CASE WHEN words < 40 AND lead(words) OVER d < 40 AND words + lead(words) OVER d >= 40 THEN bare || chr(10) || lead(bare) OVER d END FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY p))
), k AS (
  SELECT doc_id, start, n, row_number() OVER (PARTITION BY win, n ORDER BY doc_id, start) AS place FROM w WHERE win IS NOT NULL
), g AS (
  SELECT DISTINCT u.doc_id, u.i, u.p FROM u JOIN k ON k.doc_id = u.doc_id AND u.p >= k.start AND u.p < k.start + k.n WHERE place > 1
), r AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (new) AS n_runs FROM (SELECT doc_id, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, TRUE) AS new FROM g) GROUP BY doc_id
), t AS (
  SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.i) AS kept FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.i = s.i WHERE g.i IS NULL GROUP BY s.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
