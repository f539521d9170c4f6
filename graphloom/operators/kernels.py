"""Training routines as numpy block kernels: losses, gradients, optimizer steps over a block of samples.

A kernel takes the rows of the embeddings a block touches and returns their deltas; samples of a minibatch are worked on together and their
steps for one row are summed, which makes results independent of the order of threads.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.numeric import sigmoid_numpy
from ..functions.optim import Optimizer
from ..functions.scores import MODELS

EPSILON = 1e-15
SMOOTH = 0.1
CLIP = 80.0


@dataclass(frozen=True)
class Settings:
    """What a training routine needs beside the samples."""

    model: str = "LINE"
    margin: float = 12.0
    l3_regularization: float = 0.0
    negative_weight: float = 5.0
    adversarial_temperature: float = 2.0
    relation_lr_multiplier: float = 1.0


def self_adversarial(logits: np.ndarray, temperature: float) -> np.ndarray:
    """Weights of negatives (rows: samples): a softmax of their logits over the temperature, or equal ones at temperature 0."""
    if temperature <= EPSILON:
        return np.full(logits.shape, 1.0 / logits.shape[1])
    e = np.exp(np.clip((logits - logits[:, :1]) / temperature, -CLIP, CLIP))
    return e / e.sum(1, keepdims=True)


def _apply(matrix: np.ndarray, moments: list[np.ndarray], rows: np.ndarray, grads: np.ndarray, weights: np.ndarray, opt: Optimizer, lr: float, factor: float = 1.0) -> None:
    """One optimizer step for every row touched, on the weighted sum of its gradients."""
    touched, at = np.unique(rows, return_inverse=True)
    g = np.zeros((len(touched), matrix.shape[1]))
    np.add.at(g, at, grads * weights[:, None])
    if opt.weight_decay:
        g += opt.weight_decay * matrix[touched] * np.bincount(at, weights, len(touched))[:, None]
    own = [m[touched] for m in moments]
    matrix[touched] -= factor * Optimizer(opt.type, opt.lr, 0.0, opt.schedule, opt.options).step(matrix[touched], g, own, lr)
    for m, o in zip(moments, own):
        m[touched] = o


def node_step(vertex, context, moments, src, dst, negatives, opt: Optimizer, lr: float, s: Settings) -> float:
    """Edges (src, dst) against negatives (samples x n) of context vertices; returns the mean loss."""
    f = MODELS[s.model]
    n = negatives.shape[1]
    rows = np.concatenate([np.repeat(src, n), src])
    cols = np.concatenate([negatives.reshape(-1), dst])
    label = np.concatenate([np.zeros(len(src) * n), np.ones(len(src))])
    weight = np.concatenate([np.full(len(src) * n, s.negative_weight), np.ones(len(src))])
    h, t = vertex[rows], context[cols]
    p = sigmoid_numpy(f.score(h, t))
    dh, dt, _ = f.gradient(h, t)
    g = (p - label)[:, None]
    loss = -weight * np.log(np.where(label == 1, p, 1 - p) + EPSILON)
    dh, dt = g * dh, g * dt
    _apply(vertex, moments[0], rows, dh, weight, opt, lr)
    _apply(context, moments[1], cols, dt, weight, opt, lr)
    return float(loss.sum() / (len(src) * (1 + n * s.negative_weight)))


def kg_step(entity, relation, moments, h, r, t, nh, nt, opt: Optimizer, lr: float, s: Settings) -> float:
    """Triplets (h, r, t) against corrupted heads and tails nh, nt (samples x n)."""
    f = MODELS[s.model]
    n = nh.shape[1]
    neg = f.score(entity[nh], entity[nt], relation[r][:, None], s.margin)
    w = self_adversarial(neg, s.adversarial_temperature)
    heads, tails = np.concatenate([nh.reshape(-1), h]), np.concatenate([nt.reshape(-1), t])
    rels = np.concatenate([np.repeat(r, n), r])
    label = np.concatenate([np.zeros(len(h) * n), np.ones(len(h))])
    weight = np.concatenate([w.reshape(-1), np.ones(len(h))])
    he, te, re = entity[heads], entity[tails], relation[rels]
    p = sigmoid_numpy(f.score(he, te, re, s.margin))
    dh, dt, dr = f.gradient(he, te, re, s.margin)
    g = (p - label)[:, None]
    dh, dt, dr = g * dh, g * dt, g * dr
    if s.l3_regularization:
        k = 3 * s.l3_regularization
        dh, dt, dr = dh + k * np.abs(he) * he, dt + k * np.abs(te) * te, dr + k * np.abs(re) * re
    loss = -weight * np.log(np.where(label == 1, p, 1 - p) + EPSILON)
    _apply(entity, moments[0], np.concatenate([heads, tails]), np.concatenate([dh, dt]), np.concatenate([weight, weight]), opt, lr)
    _apply(relation, moments[1], rels, dr, weight, opt, lr, s.relation_lr_multiplier)
    return float(loss.sum() / (2 * len(h)))


def vis_step(coords, moments, src, dst, negatives, opt: Optimizer, lr: float, s: Settings) -> float:
    """Edges of a layout: attraction 2 p, repulsion 2 p / (x + SMOOTH), with p = 1 / (1 + x) and x the squared distance. Both ends move."""
    n = negatives.shape[1]
    rows, cols = np.concatenate([np.repeat(src, n), src]), np.concatenate([negatives.reshape(-1), dst])
    label = np.concatenate([np.zeros(len(src) * n), np.ones(len(src))])
    weight = np.concatenate([np.full(len(src) * n, s.negative_weight), np.ones(len(src))])
    h, t = coords[rows], coords[cols]
    x = ((h - t) ** 2).sum(1)
    p = 1 / (1 + x)
    g = np.where(label == 1, 2 * p, -2 * p / (x + SMOOTH))[:, None] * (h - t)
    loss = -weight * np.log(np.where(label == 1, p, 1 - p) + EPSILON)
    _apply(coords, moments[0], np.concatenate([rows, cols]), np.concatenate([g, -g]), np.concatenate([weight, weight]), opt, lr)
    return float(loss.sum() / (len(src) * (1 + n * s.negative_weight)))
