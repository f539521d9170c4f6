"""Seeded draws and small numerics, as columns and as numpy with equal values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
CLIP = 700.0


def draw(key: Column, step: int | Column = 0, seed: int | Column = 0) -> Column:
    """A uniform number in [0, 1) that depends on key, step and seed only (step and seed below 2^31, key from 0 to 2^62).

    Keys from PRIME on count by quotient and remainder, so they don't repeat the draws of small ones. Squaring makes it non-linear, so draws of neighbouring steps are independent. Integer arithmetic below 2^63 gives the same
    value in any engine.
    """
    whole = key.cast("long")
    k = whole % PRIME
    high = F.call_function("div", whole, F.lit(PRIME)) % PRIME
    s, z = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (step, seed))
    x1 = (k * 48271 + high * 16807 + s * 40692 + z * 69621 + 1) % PRIME
    x2 = (x1 * x1 + s + z) % PRIME
    x3 = (x2 * 48271 + k + high * 39373) % PRIME
    return ((x3 * x3 + x1) % PRIME).cast("double") / F.lit(float(PRIME))


def draw_sql(key: str, step: int = 0, seed: int = 0) -> str:
    """draw() in SQL, for keys below PRIME."""
    x1 = f"((CAST({key} AS BIGINT) * 48271 + {step * 40692 + seed * 69621 + 1}) % {PRIME})"
    x2 = f"(({x1} * {x1} + {step + seed}) % {PRIME})"
    x3 = f"(({x2} * 48271 + CAST({key} AS BIGINT)) % {PRIME})"
    return f"(CAST(({x3} * {x3} + {x1}) % {PRIME} AS DOUBLE) / {PRIME}.0::DOUBLE)"


def draw_numpy(key: np.ndarray, step=0, seed=0) -> np.ndarray:
    high, k = np.divmod(np.asarray(key, np.int64), PRIME)
    high = high % PRIME
    x1 = (k * 48271 + high * 16807 + np.asarray(step, np.int64) * 40692 + np.asarray(seed, np.int64) * 69621 + 1) % PRIME
    x2 = (x1 * x1 + step + seed) % PRIME
    x3 = (x2 * 48271 + k + high * 39373) % PRIME
    return ((x3 * x3 + x1) % PRIME) / float(PRIME)


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x > 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def safe_exp(x: Column, clip: float = CLIP) -> Column:
    return F.exp(F.least(F.greatest(x, F.lit(-clip)), F.lit(clip)))


def bit_floor(x: Column) -> Column:
    """The largest power of two that is not above x (x >= 1)."""
    return F.pow(F.lit(2.0), F.floor(F.log2(x.cast("double")))).cast("long")


def bit_ceil(x: Column) -> Column:
    """The smallest power of two that is not below x (x >= 1)."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(x.cast("double")))).cast("long")


def sigmoid_numpy(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x > 0, 1 / (1 + e), e / (1 + e))


def auto_augmentation_step(num_edge: int, num_vertex: int, expected_degree: float = 1600.0) -> int:
    """floor(ln expected_degree / ln average degree); the graph must have more edges than vertices."""
    if num_edge <= num_vertex or num_vertex <= 0:
        raise ValueError("augmentation step can't be deduced: the graph has no more edges than vertices; please set it")
    step = int(math.log(expected_degree) / math.log(num_edge / num_vertex))
    if step < 1:
        raise ValueError("augmentation step can't be deduced: the graph is too dense; please set it")
    return step
