"""First-order optimizers as stateless numpy steps, and learning-rate schedules.

A step takes parameter, gradient, moments and sample weight and returns what to subtract; moments are updated in place.
The regularised gradient is weight * (gradient + weight_decay * parameter).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

Schedule = Callable[[int, int], float]


def linear(batch: int, total: int) -> float:
    return max(1 - batch / max(total, 1), 1e-4)


def constant(batch: int, total: int) -> float:
    return 1.0


SCHEDULES: dict[str, Schedule] = {"linear": linear, "constant": constant}


@dataclass(frozen=True)
class Optimizer:
    """type: SGD, Momentum, AdaGrad, RMSprop or Adam. `Optimizer.auto(lr)` takes a solver's default, with another rate if given."""

    type: str = "SGD"
    lr: float = 1e-4
    weight_decay: float = 0.0
    schedule: str | Schedule = "linear"
    options: dict = field(default_factory=dict)

    MOMENTS = {"SGD": 0, "Momentum": 1, "AdaGrad": 1, "RMSprop": 1, "Adam": 2}
    DEFAULTS = {"SGD": {}, "Momentum": {"momentum": 0.999}, "AdaGrad": {"epsilon": 1e-10}, "RMSprop": {"alpha": 0.999, "epsilon": 1e-8}, "Adam": {"beta1": 0.999, "beta2": 0.99999, "epsilon": 1e-8}}

    def __post_init__(self):
        if self.type not in self.MOMENTS:
            raise ValueError(f"unknown optimizer `{self.type}`")
        wrong = set(self.options) - set(self.DEFAULTS[self.type])
        if wrong:
            raise ValueError(f"{self.type} has no option {', '.join(sorted(wrong))}")
        if isinstance(self.schedule, str) and self.schedule not in SCHEDULES:
            raise ValueError(f"unknown schedule `{self.schedule}`")

    @classmethod
    def make(cls, spec: "Optimizer | dict | float | str | None", default: "Optimizer") -> "Optimizer":
        """From an optimizer, a mapping with its arguments, a learning rate, or None / "auto" for the default."""
        if spec is None or spec == "auto":
            return default
        if isinstance(spec, Optimizer):
            return spec
        if isinstance(spec, (int, float)):
            return replace(default, lr=float(spec))
        spec = dict(spec)
        kind = spec.pop("type", default.type)
        if kind == "Default":
            return replace(default, lr=float(spec.get("lr", default.lr)))
        plain = {k: spec.pop(k) for k in ("lr", "weight_decay", "schedule") if k in spec}
        return cls(kind, options=spec, **plain)

    @property
    def n_moments(self) -> int:
        return self.MOMENTS[self.type]

    def rate(self, batch: int, total: int) -> float:
        f = SCHEDULES[self.schedule] if isinstance(self.schedule, str) else self.schedule
        return self.lr * f(batch, total)

    def step(self, param: np.ndarray, grad: np.ndarray, moments: list[np.ndarray], lr: float | None = None, weight=1.0) -> np.ndarray:
        lr = self.lr if lr is None else lr
        o = self.DEFAULTS[self.type] | self.options
        g = weight * (grad + self.weight_decay * param)
        if self.type == "SGD":
            return lr * g
        m = moments[0]
        if self.type == "Momentum":
            m *= o["momentum"]
            m += (1 - o["momentum"]) * g
            return lr * m
        if self.type == "AdaGrad":
            m += g * g
            return lr * g / (np.sqrt(m) + o["epsilon"])
        if self.type == "RMSprop":
            m *= o["alpha"]
            m += (1 - o["alpha"]) * g * g
            return lr * g / np.sqrt(m + o["epsilon"])
        v = moments[1]
        m *= o["beta1"]
        m += (1 - o["beta1"]) * g
        v *= o["beta2"]
        v += (1 - o["beta2"]) * g * g
        return lr * m / (np.sqrt(v) + o["epsilon"])
