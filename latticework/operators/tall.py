"""Decompositions of tall row matrices (row_id, v) by tall-skinny QR."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels
from ..errors import DimensionMismatch, EmptyInput, InvalidInput, SingularMatrix
from .stats import matrix_of


@dataclass(frozen=True)
class TallSvd:
    singular_values: np.ndarray
    vt: np.ndarray
    u: DataFrame  # (row_id, u)


def _project(rows: DataFrame, basis: np.ndarray, name: str) -> DataFrame:
    """(row_id, name) with v times ``basis`` (p x k, on the driver already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = matrix_of(batch.column(1)).reshape(batch.num_rows, len(basis)) @ basis
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * basis.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], ["row_id", name])

    return rows.select("row_id", "v").mapInArrow(run, f"row_id long, {name} array<double>")


def svd(rows: DataFrame, k: int | None = None) -> TallSvd:
    """Thin SVD: that of R of the tall QR, so small singular values are as exact as large ones.

    Singular values that rounding alone can explain are 0, and their columns of U are 0.
    """
    if k is not None and k <= 0:
        raise InvalidInput("k must be positive")
    r = tsqr(rows)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    s = np.where(s <= s.max(initial=0) * max(r.shape[1], 64) * kernels.EPSILON, 0.0, s)
    keep = len(s) if k is None else min(k, len(s))
    s, v = s[:keep], vt[:keep].T
    big = np.abs(v).argmax(0)
    v = v * np.where(v[big, np.arange(keep)] < 0, -1.0, 1.0)
    scaled = np.where(s > kernels.TOLERANCE, 1 / np.where(s > 0, s, 1), 0)
    return TallSvd(s, v.T, _project(rows, v * scaled, "u"))


#: R factors that one task merges
MERGED = 32


def tsqr(rows: DataFrame) -> np.ndarray:
    """R of a tall QR with a diagonal >= 0: one R a partition, merged by a tree of shuffles of p * p numbers each, then on the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            v = matrix_of(batch.column(0))
            if len(v):
                if r is not None and r.shape[1] != v.shape[1]:
                    raise DimensionMismatch("vectors of different lengths")
                r = np.linalg.qr(v if r is None else np.concatenate((r, v)), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["v"])

    source = rows.select("v")
    parts, n = source.mapInArrow(merge, "v array<double>"), source.rdd.getNumPartitions()
    while n > MERGED:  # any rows of the factors may meet: only their number a task counts
        n = -(-n // MERGED)
        parts = parts.repartition(n).mapInArrow(merge, "v array<double>")
    merged = parts.collect()
    if not merged:
        raise EmptyInput
    r = np.linalg.qr(np.array([x["v"] for x in merged], float), mode="r")
    if not np.isfinite(r).all():
        raise InvalidInput("not finite")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if len(r) == r.shape[1] else r


def qr(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(row_id, q) and R."""
    r = tsqr(rows)
    if (np.abs(np.diag(r)) <= kernels.TOLERANCE).any() or r.shape[0] < r.shape[1]:
        raise SingularMatrix("dependent columns")
    return _project(rows, np.linalg.inv(r), "q"), r


def least_squares(rows: DataFrame) -> np.ndarray:
    """Coefficients for rows (row_id, v, y): TSQR of [v | y], then one back substitution."""
    r = tsqr(rows.select("row_id", F.concat("v", F.array(F.col("y").cast("double"))).alias("v")))
    p = r.shape[1] - 1
    if r.shape[0] < p:
        raise InvalidInput("fewer rows than columns")
    if (np.abs(np.diag(r)[:p]) <= kernels.TOLERANCE).any():
        raise SingularMatrix("dependent columns")
    return kernels.solve_upper(r[:p, :p], r[:p, p])
