"""Column statistics, regression and principal components in one or two passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kernels
from ..errors import ConvergenceFailed, DimensionMismatch, EmptyInput, InvalidInput, NumericalInstability
from ..kernels import EPSILON


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row; 0 for a table without rows."""
    return df.agg(*(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns))


def center_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column minus its mean: one aggregate, then a projection with its numbers."""
    means = column_means(df, columns).head()
    return df.withColumns({c: F.col(c).cast("double") - F.lit(float(means[c])) for c in columns})


def _covariances(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(F.count("*").alias("n"), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).head()
    if not row["n"] or not p:
        raise EmptyInput
    if row["n"] < 2:
        raise InvalidInput("at least two observations are required")
    out = np.zeros((p, p))
    for i, j in pairs:
        out[i, j] = out[j, i] = float(row[f"c{i}_{j}"])
    if not np.isfinite(out).all():
        raise NumericalInstability
    return out, row["n"]


def _long(df: DataFrame, names: list[str], values: np.ndarray, value: str) -> DataFrame:
    rows = [(a, b, float(values[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, f"row string, col string, {value} double")


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row, col, covariance), by n - 1, from one aggregate."""
    return _long(df, columns, _covariances(df, columns)[0], "covariance")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row, col, correlation); 0 wherever a column is constant, on the diagonal too."""
    c, _ = _covariances(df, columns)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    return _long(df, columns, c / np.maximum(np.outer(sd, sd), EPSILON), "correlation")


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists, from its flat values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count:
        raise EmptyInput("null vector")
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise DimensionMismatch("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), sizes[0])


def _summed(rows: DataFrame, column: str, part) -> dict[tuple[int, int], float]:
    """Sums over all rows of the matrix ``part(v)`` of each batch v: one matrix a partition, summed in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v = matrix_of(batch.column(0))
            if len(v):
                m = part(v)
                if total is not None and m.shape != total.shape:
                    raise DimensionMismatch("vectors of different lengths")
                total = m if total is None else total + m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1)), pa.array(j.reshape(-1)), pa.array(total.reshape(-1))], ["i", "j", "s"])

    cells = rows.select(column).mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not cells:
        raise EmptyInput
    if not all(np.isfinite(r["s"]) for r in cells):
        raise NumericalInstability
    return {(r["i"], r["j"]): r["s"] for r in cells}


def _matrix(cells: dict[tuple[int, int], float]) -> np.ndarray:
    out = np.zeros((max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1))
    for (i, j), v in cells.items():
        out[i, j] = v
    return out


def gram(rows: DataFrame, column: str = "v") -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of v v', sum of v and number of rows: p * p numbers from each partition, summed in the cluster."""

    def part(v):
        v = np.concatenate((v, np.ones((len(v), 1))), 1)
        return v.T @ v

    out = _matrix(_summed(rows, column, part))
    p = len(out) - 1
    return out[:p, :p], out[:p, p], int(round(out[p, p]))


def scatter(rows: DataFrame, column: str = "v") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sum of (v - mean)(v - mean)' and number of rows, in two passes: the mean, then the centred products."""
    sums = _matrix(_summed(rows, column, lambda v: np.concatenate((v.sum(0), [len(v)]))[None]))[0]
    n, mean = int(round(sums[-1])), sums[:-1] / sums[-1]

    def part(v):
        v = np.concatenate((v - mean, np.ones((len(v), 1))), 1)
        return v.T @ v

    out = _matrix(_summed(rows, column, part))
    p = len(mean)
    # what rounding left in the mean
    rest = out[:p, p] / n
    return mean + rest, out[:p, :p] - n * np.outer(rest, rest), n


@dataclass(frozen=True)
class Regression:
    coefficients: np.ndarray
    r_squared: float
    rows: DataFrame  # the input with fitted and residual


def linear_regression(df: DataFrame, x: list[str], y: str, intercept: bool = True) -> Regression:
    """Least squares by normal equations; an intercept is coefficient 0. R^2 is 1 where y is constant."""
    names = ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in x]
    target = F.col(y).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(F.count("*").alias("n"), *(F.sum(names[i] * names[j]).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(v * target).alias(f"b{i}") for i, v in enumerate(names)), F.sum(target).alias("s")).head()
    if not row["n"] or not names:
        raise EmptyInput
    a, b = np.zeros((len(names), len(names))), np.array([row[f"b{i}"] for i in range(len(names))], float)
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    beta = kernels.lu_solve(a, b)
    fitted = sum((F.lit(float(c)) * v for c, v in zip(beta, names, strict=True)), F.lit(0.0))
    rows = df.withColumn("fitted", fitted).withColumn("residual", target - F.col("fitted"))
    mean = row["s"] / row["n"]
    left = rows.agg(F.sum(F.col("residual") ** 2).alias("r"), F.sum((target - F.lit(mean)) ** 2).alias("t")).head()
    return Regression(beta, 1.0 if left["t"] <= EPSILON else 1.0 - left["r"] / left["t"], rows)


def grouped_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One regressor a group: slope, intercept and r_squared from one aggregate."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.groupBy(*keys).agg(F.covar_pop(a, b).alias("sxy"), F.var_pop(a).alias("sxx"), F.var_pop(b).alias("syy"), F.avg(a).alias("mx"), F.avg(b).alias("my"))
    slope = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
    fit = F.when(F.col("syy") <= EPSILON, 1.0).otherwise(F.col("sxy") * F.col("sxy") / F.nullif(F.col("sxx") * F.col("syy"), F.lit(0.0)))
    return sums.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), fit.alias("r_squared"))


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    components: np.ndarray  # k x p
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray  # over the components kept

    def transform(self, v: Column) -> Column:
        """Scores of a vector column."""
        centered = F.zip_with(v, _literal(self.mean), lambda x, m: x - m)
        return F.array(*(F.aggregate(F.zip_with(centered, _literal(c), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for c in self.components))

    def inverse_transform(self, scores: Column) -> Column:
        return F.array(*(F.lit(float(m)) + F.aggregate(F.zip_with(scores, _literal(self.components[:, j]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for j, m in enumerate(self.mean)))


def _literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def pca(rows: DataFrame, n_components: int | None = None, column: str = "v") -> Components:
    """Principal components of a row matrix, from two passes and a p x p eigenproblem on the driver."""
    if n_components is not None and n_components <= 0:
        raise InvalidInput("n_components must be positive")
    mean, products, n = scatter(rows, column)
    try:
        values, vectors = kernels.eigen_symmetric((products + products.T) / 2)
    except NumericalInstability as e:
        raise ConvergenceFailed(str(e)) from e
    k = min(n, len(mean)) if n_components is None else min(n_components, n, len(mean))
    variance = np.maximum(values[:k], 0) / max(n - 1, 1)
    return Components(mean, vectors[:, :k].T, variance, variance / variance.sum() if variance.sum() > 0 else variance)
