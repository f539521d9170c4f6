"""Score functions of the embedding models, as columns and as numpy, with their gradients.

Complex components lie interleaved (2k real, 2k + 1 imaginary), quaternions in groups of four. Column forms serve SQL-sized work
and cross-checks; numpy forms serve the block kernels. Gradients are those of the score with respect to head, tail and relation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import EPSILON, add, dot, every, l1, multiply, squared_l2, subtract, sum_of, swapped_pairs, total

# --- columns ---------------------------------------------------------------------------------------------------------


def line(h: Column, t: Column) -> Column:
    return dot(h, t)


def transe(h: Column, r: Column, t: Column, margin: float = 12.0) -> Column:
    return F.lit(float(margin)) - l1(subtract(add(h, r), t))


def distmult(h: Column, r: Column, t: Column) -> Column:
    return dot(multiply(h, r), t)


def complex_(h: Column, r: Column, t: Column) -> Column:
    (hr, hi), (rr, ri), (tr, ti) = ((every(x, 2, 0), every(x, 2, 1)) for x in (h, r, t))
    real, imaginary = subtract(multiply(hr, rr), multiply(hi, ri)), add(multiply(hr, ri), multiply(hi, rr))
    return dot(real, tr) + dot(imaginary, ti)


def simple(h: Column, r: Column, t: Column) -> Column:
    return dot(multiply(h, r), swapped_pairs(t))


def rotate(h: Column, r: Column, t: Column, margin: float = 12.0) -> Column:
    """The relation's phases are its first dim / 2 components."""
    (hr, hi), (tr, ti) = ((every(x, 2, 0), every(x, 2, 1)) for x in (h, t))
    phase = F.slice(r, F.lit(1), F.size(hr))
    c, s = F.transform(phase, F.cos), F.transform(phase, F.sin)
    real = subtract(subtract(multiply(hr, c), multiply(hi, s)), tr)
    imaginary = subtract(add(multiply(hr, s), multiply(hi, c)), ti)
    return F.lit(float(margin)) - total(F.zip_with(real, imaginary, lambda x, y: F.sqrt(x * x + y * y)))


def quate(h: Column, r: Column, t: Column) -> Column:
    a, b, c, d = (every(h, 4, i) for i in range(4))
    p, q, u, v = (every(r, 4, i) for i in range(4))
    norm = F.transform(F.zip_with(add(multiply(p, p), multiply(q, q)), add(multiply(u, u), multiply(v, v)), lambda x, y: x + y), lambda x: F.sqrt(x) + F.lit(EPSILON))
    products = [
        subtract(subtract(multiply(a, p), multiply(b, q)), add(multiply(c, u), multiply(d, v))),
        add(add(multiply(a, q), multiply(b, p)), subtract(multiply(c, v), multiply(d, u))),
        add(subtract(multiply(a, u), multiply(b, v)), add(multiply(c, p), multiply(d, q))),
        add(add(multiply(a, v), multiply(b, u)), subtract(multiply(d, p), multiply(c, q))),
    ]
    return sum_of([total(F.zip_with(multiply(x, every(t, 4, i)), norm, lambda y, n: y / n)) for i, x in enumerate(products)])


def largevis(h: Column, t: Column) -> Column:
    """Squared distance; the probability of an edge is 1 / (1 + it)."""
    return squared_l2(subtract(h, t))


COLUMN_SCORES: dict[str, Callable[..., Column]] = {
    "LINE": line, "DeepWalk": line, "node2vec": line, "TransE": transe, "DistMult": distmult,
    "ComplEx": complex_, "SimplE": simple, "RotatE": rotate, "QuatE": quate, "LargeVis": largevis,
}

# --- numpy -----------------------------------------------------------------------------------------------------------
# Rows are samples; arrays broadcast, so one (h, r) row can meet a whole block of candidates.


@dataclass(frozen=True)
class Model:
    """score(h, t, r, margin) and gradient(h, t, r, margin) -> (dh, dt, dr); divisor: what the dimension must divide by."""

    name: str
    score: Callable
    gradient: Callable
    divisor: int = 1
    relational: bool = True
    uses_margin: bool = False

    def check(self, dim: int) -> None:
        if dim % self.divisor:
            raise ValueError(f"{self.name} needs a dimension divisible by {self.divisor}, not {dim}")


def _dot(h, t, r=None, margin=0.0):
    return (h * t).sum(-1)


def _dot_grad(h, t, r=None, margin=0.0):
    return t, h, None


def _transe(h, t, r, margin=12.0):
    return margin - np.abs(h + r - t).sum(-1)


def _transe_grad(h, t, r, margin=12.0):
    s = np.where(h + r - t > 0, 1.0, -1.0)
    return -s, s, -s


def _distmult(h, t, r, margin=0.0):
    return (h * r * t).sum(-1)


def _distmult_grad(h, t, r, margin=0.0):
    return r * t, h * r, h * t


def _halves(x):
    return x[..., 0::2], x[..., 1::2]


def _woven(a, b):
    return np.stack([a, b], -1).reshape(*a.shape[:-1], -1)


def _complex(h, t, r, margin=0.0):
    (hr, hi), (tr, ti), (rr, ri) = _halves(h), _halves(t), _halves(r)
    return ((hr * rr - hi * ri) * tr + (hr * ri + hi * rr) * ti).sum(-1)


def _complex_grad(h, t, r, margin=0.0):
    (hr, hi), (tr, ti), (rr, ri) = _halves(h), _halves(t), _halves(r)
    return (_woven(rr * tr + ri * ti, rr * ti - ri * tr), _woven(hr * rr - hi * ri, hr * ri + hi * rr), _woven(hr * tr + hi * ti, hr * ti - hi * tr))


def _flip(x):
    a, b = _halves(x)
    return _woven(b, a)


def _simple(h, t, r, margin=0.0):
    return (h * r * _flip(t)).sum(-1)


def _simple_grad(h, t, r, margin=0.0):
    return r * _flip(t), _flip(h * r), h * _flip(t)


def _rotate_parts(h, t, r):
    (hr, hi), (tr, ti) = _halves(h), _halves(t)
    phase = r[..., : hr.shape[-1]]
    c, s = np.cos(phase), np.sin(phase)
    return hr, hi, c, s, hr * c - hi * s - tr, hr * s + hi * c - ti


def _rotate(h, t, r, margin=12.0):
    *_, x, y = _rotate_parts(h, t, r)
    return margin - np.sqrt(x * x + y * y).sum(-1)


def _rotate_grad(h, t, r, margin=12.0):
    hr, hi, c, s, x, y = _rotate_parts(h, t, r)
    n = np.sqrt(x * x + y * y) + EPSILON
    x, y = x / n, y / n
    dr = np.zeros(np.broadcast_shapes(h.shape, t.shape, r.shape))
    dr[..., : x.shape[-1]] = -(x * (-hr * s - hi * c) + y * (hr * c - hi * s))
    return _woven(-(x * c + y * s), -(y * c - x * s)), _woven(x, y), dr


def _quarters(x):
    return tuple(x[..., i::4] for i in range(4))


def _hamilton(h, r):
    (a, b, c, d), (p, q, u, v) = h, r
    return a * p - b * q - c * u - d * v, a * q + b * p + c * v - d * u, a * u - b * v + c * p + d * q, a * v + b * u - c * q + d * p


def _quate(h, t, r, margin=0.0):
    rq = _quarters(r)
    n = np.sqrt(sum(x * x for x in rq)) + EPSILON
    return sum((x * y / n) for x, y in zip(_hamilton(_quarters(h), rq), _quarters(t))).sum(-1)


def _quate_grad(h, t, r, margin=0.0):
    """The relation's norm is held fixed."""
    hq, tq, (p, q, u, v) = _quarters(h), _quarters(t), _quarters(r)
    n = np.sqrt(p * p + q * q + u * u + v * v) + EPSILON
    (a, b, c, d), (w, x, y, z) = hq, tq
    weave = lambda parts: np.stack([g / n for g in parts], -1).reshape(*np.broadcast_shapes(h.shape, t.shape, r.shape))
    dh = (p * w + q * x + u * y + v * z, -q * w + p * x - v * y + u * z, -u * w + v * x + p * y - q * z, -v * w - u * x + q * y + p * z)
    dr = (a * w + b * x + c * y + d * z, -b * w + a * x + d * y - c * z, -c * w - d * x + a * y + b * z, -d * w + c * x - b * y + a * z)
    return weave(dh), weave(_hamilton(hq, (p, q, u, v))), weave(dr)


def _largevis(h, t, r=None, margin=0.0):
    return ((h - t) ** 2).sum(-1)


def _largevis_grad(h, t, r=None, margin=0.0):
    """Direction of the step, half the gradient: the routines carry the factor."""
    return h - t, t - h, None


MODELS: dict[str, Model] = {
    m.name: m
    for m in (
        Model("LINE", _dot, _dot_grad, relational=False),
        Model("DeepWalk", _dot, _dot_grad, relational=False),
        Model("node2vec", _dot, _dot_grad, relational=False),
        Model("TransE", _transe, _transe_grad, uses_margin=True),
        Model("DistMult", _distmult, _distmult_grad),
        Model("ComplEx", _complex, _complex_grad, 2),
        Model("SimplE", _simple, _simple_grad, 2),
        Model("RotatE", _rotate, _rotate_grad, 2, uses_margin=True),
        Model("QuatE", _quate, _quate_grad, 4),
        Model("LargeVis", _largevis, _largevis_grad, relational=False),
    )
}


def register_model(model: Model, column: Callable[..., Column] | None = None) -> None:
    """Add a model of one's own to the registries."""
    MODELS[model.name] = model
    if column is not None:
        COLUMN_SCORES[model.name] = column


def score_columns(model: str, h: Column, t: Column, r: Column | None = None, margin: float = 12.0) -> Column:
    """The score column of a model, from head, tail and (for knowledge graphs) relation vectors."""
    m, f = MODELS[model], COLUMN_SCORES[model]
    if not m.relational:
        return f(h, t)
    return f(h, r, t, margin) if m.uses_margin else f(h, r, t)
