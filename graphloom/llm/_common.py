"""Shared helpers: scratch tables in the cluster's shared folder, blobs and small utilities."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where that is unset a temporary folder serves in local mode only, as in tests; on a cluster it would lose tables with the machine that holds them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _fallback["dir"], ignore_errors=True)
    return _fallback["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table that materialize() wrote for df; nothing may read it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def partitions(df: DataFrame) -> int:
    """Number of input splits of df, a cheap measure of its size (no job runs)."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def n_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def flagged(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, __null, text, ...): ids as long with nulls as 0 and a flag, as pandas would turn a column with nulls into floats and round large ids."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("__null"), "text", *more)


def unflagged(rows: DataFrame) -> DataFrame:
    """rows with the nulls that flagged() took out of doc_id."""
    return rows.withColumn("doc_id", F.when(~F.col("__null"), F.col("doc_id"))).drop("__null")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays into one compressed blob; integers by byte planes, so that small ones cost little."""
    parts = []
    for a in arrays:
        raw, width, n = (a, 0, len(a)) if isinstance(a, bytes) else (a.astype("<i8"), 8, len(a))
        if width:
            width = max(1, (int(a.max()).bit_length() + 7) // 8) if n else 1
            raw = np.ascontiguousarray(raw.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes()
        parts.append(np.array([width, n], "<i8").tobytes() + raw)
    return zstandard.compress(b"".join(parts), 3)


def unpack(blob: bytes) -> list:
    raw, out, at = zstandard.decompress(blob), [], 0
    while at < len(raw):
        width, n = np.frombuffer(raw, "<i8", 2, at).tolist()
        at += 16
        if width:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            out.append(wide.view("<i8").reshape(-1))
            at += n * width
        else:
            out.append(raw[at : at + n])
            at += n
    return out


_LONG_ROUNDS = 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(raw: bytes) -> np.ndarray:
    """The eight bytes from every place of raw on, zeros behind its end."""
    return np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), 0, (1,))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (works in place)."""
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def span_hashes(raw: bytes, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of raw[start[i]:stop[i]], eight bytes a round for all spans at once; the rest of very long ones by xxh3."""
    eights, size = _eights(raw), stop - start
    h = (size + seed).astype(np.uint64) * _M2
    at, on = np.arange(len(size)), start
    for r in range(_LONG_ROUNDS):
        if not len(at):
            return h
        left = size[at] - 8 * r
        h[at] = mixed(h[at] ^ (eights[on] & _LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        at, on = at[more], on[more] + 8
    for i, a in zip(at.tolist(), on.tolist()):
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(raw[a : int(stop[i])], seed))
    return mixed(h)


def same_spans(raw: bytes, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> bool:
    """Whether every span i holds the same bytes as span other[i]."""
    size = stop - start
    differs = other != np.arange(len(size))
    one, two = np.flatnonzero(differs), other[differs]
    if (size[one] != size[two]).any():
        return False
    eights = _eights(raw)
    for r in range(_LONG_ROUNDS):
        if not len(one):
            return True
        keep = _LOW_BYTES[np.minimum(size[one] - 8 * r, 8)]
        if ((eights[start[one] + 8 * r] ^ eights[start[two] + 8 * r]) & keep).any():
            return False
        more = size[one] - 8 * r > 8
        one, two = one[more], two[more]
    return all(raw[start[i] : stop[i]] == raw[start[j] : stop[j]] for i, j in zip(one.tolist(), two.tolist()))


def give_back() -> None:
    """Free memory goes back to the system at the end of a task: Python workers live on, and the next stage shall not pay for this one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
