"""Numerical derivatives of column functions: all perturbed points are rows, evaluated in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput


@dataclass(frozen=True)
class DifferenceConfig:
    step_size: float = 1e-6
    tolerance: float = 1e-8
    max_iterations: int = 100

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        if not (math.isfinite(self.step_size) and self.step_size > 0):
            raise InvalidInput("invalid step size")
        if not (math.isfinite(self.tolerance) and self.tolerance > 0 and self.max_iterations > 0):
            raise InvalidInput("invalid dimensions")


def _moved(x: Column, shift: Callable[[Column], Column]) -> Column:
    return F.transform(x, lambda v, i: v + shift(i))


def _along(points: DataFrame, column: str) -> DataFrame:
    return points.withColumn("j", F.explode(F.sequence(F.lit(0), F.size(column) - 1)))


def numerical_jacobian(points: DataFrame, f: Callable[[Column], Column], column: str = "x", config: DifferenceConfig = DifferenceConfig(), central: bool = False) -> DataFrame:
    """``points`` times (j, derivative array): d f / d x_j by forward or central differences; f maps array to array."""
    h = config.step_size
    x = F.col(column)
    plus = f(_moved(x, lambda i: F.when(i == F.col("j"), h).otherwise(0.0)))
    low = f(_moved(x, lambda i: F.when(i == F.col("j"), -h).otherwise(0.0))) if central else f(x)
    wide = 2 * h if central else h
    return _along(points, column).withColumn("derivative", F.zip_with(plus, low, lambda a, b: (a - b) / wide))


def numerical_jacobian_central(points: DataFrame, f, column: str = "x", config: DifferenceConfig = DifferenceConfig()) -> DataFrame:
    return numerical_jacobian(points, f, column, config, True)


def numerical_gradient(points: DataFrame, f: Callable[[Column], Column], column: str = "x", config: DifferenceConfig = DifferenceConfig()) -> DataFrame:
    """``points`` times (j, derivative) of a scalar function."""
    h, x = config.step_size, F.col(column)
    plus = f(_moved(x, lambda i: F.when(i == F.col("j"), h).otherwise(0.0)))
    return _along(points, column).withColumn("derivative", (plus - f(x)) / h)


def numerical_hessian(points: DataFrame, f: Callable[[Column], Column], column: str = "x", config: DifferenceConfig = DifferenceConfig()) -> DataFrame:
    """``points`` times (j, k, derivative): four points for each of the n * n entries."""
    h, x = config.step_size, F.col(column)
    both = _along(points, column).withColumn("k", F.explode(F.sequence(F.lit(0), F.size(column) - 1)))

    def at(a: float, b: float) -> Column:
        return f(_moved(x, lambda i: F.when(i == F.col("j"), a * h).otherwise(0.0) + F.when(i == F.col("k"), b * h).otherwise(0.0)))

    return both.withColumn("derivative", (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * h * h))
