"""First-order optimisation; objective and gradient are callables, which may run one aggregate each."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..errors import ConvergenceFailed, DimensionMismatch, EmptyInput, InvalidInput, NumericalInstability
from ..kernels import TOLERANCE
from .stats import gram

Objective = Callable[[np.ndarray], float]
Gradient = Callable[[np.ndarray], np.ndarray]


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not (math.isfinite(v) and v > 0):
            raise InvalidInput(name)


def _fraction(**values: float) -> None:
    for name, v in values.items():
        if not 0 <= v < 1:
            raise InvalidInput(name)


@dataclass(frozen=True)
class LineSearchConfig:
    initial_step: float = 1.0
    contraction: float = 0.5
    sufficient_decrease: float = 1e-4
    max_iterations: int = 100

    def __post_init__(self):
        _positive(initial_step=self.initial_step, max_iterations=self.max_iterations)
        _fraction(contraction=self.contraction, sufficient_decrease=self.sufficient_decrease)


@dataclass(frozen=True)
class DescentConfig:
    learning_rate: float = 1e-2
    tolerance: float = 1e-8
    max_iterations: int = 10_000

    def __post_init__(self):
        _positive(learning_rate=self.learning_rate, tolerance=self.tolerance, max_iterations=self.max_iterations)


@dataclass(frozen=True)
class AdamConfig(DescentConfig):
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8

    def __post_init__(self):
        super().__post_init__()
        _positive(epsilon=self.epsilon)
        _fraction(beta1=self.beta1, beta2=self.beta2)


def _point(x) -> np.ndarray:
    x = np.asarray(x, float)
    if not x.size:
        raise EmptyInput
    if not np.isfinite(x).all():
        raise NumericalInstability
    return x


def _slope(gradient: Gradient, x: np.ndarray) -> np.ndarray:
    g = np.asarray(gradient(x), float)
    if g.shape != x.shape or not np.isfinite(g).all():
        raise NumericalInstability("gradient")
    return g


def backtracking_line_search(point, direction, objective: Objective, gradient: Gradient, config: LineSearchConfig = LineSearchConfig()) -> float:
    """The first step of the ladder that decreases enough (Armijo)."""
    x, d = _point(point), _point(direction)
    if x.shape != d.shape:
        raise DimensionMismatch
    base, slope, step = objective(x), float(_slope(gradient, x) @ d), config.initial_step
    if not math.isfinite(base):
        raise NumericalInstability
    for _ in range(config.max_iterations):
        trial = objective(x + step * d)
        if not math.isfinite(trial):
            raise NumericalInstability("objective")
        if trial <= base + config.sufficient_decrease * step * slope:
            return step
        step *= config.contraction
    raise ConvergenceFailed


def gradient_descent(initial, objective: Objective, gradient: Gradient, config: DescentConfig = DescentConfig()) -> np.ndarray:
    """Full gradient, fixed step; the norm is tested before each step and not after the last."""
    x, limit = _point(initial), max(config.tolerance, TOLERANCE)
    for _ in range(config.max_iterations):
        g = _slope(gradient, x)
        if np.linalg.norm(g) <= limit:
            return x
        x = _point(x - config.learning_rate * g)
    raise ConvergenceFailed


def adam(initial, objective: Objective, gradient: Gradient, config: AdamConfig = AdamConfig()) -> np.ndarray:
    x, limit = _point(initial), max(config.tolerance, TOLERANCE)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, config.max_iterations + 1):
        g = _slope(gradient, x)
        if np.linalg.norm(g) <= limit:
            return x
        m = config.beta1 * m + (1 - config.beta1) * g
        v = config.beta2 * v + (1 - config.beta2) * g * g
        x = _point(x - config.learning_rate * (m / (1 - config.beta1**t)) / (np.sqrt(v / (1 - config.beta2**t)) + config.epsilon))
    raise ConvergenceFailed


def squared_error(rows: DataFrame) -> tuple[Objective, Gradient]:
    """Mean squared error of rows (v: regressors and, last, the target): the data are read once, for their Gram matrix."""
    g, _, n = gram(rows)
    a, b, c = g[:-1, :-1] / n, g[:-1, -1] / n, g[-1, -1] / n
    return lambda x: float(x @ a @ x - 2 * b @ x + c), lambda x: 2 * (a @ x - b)
