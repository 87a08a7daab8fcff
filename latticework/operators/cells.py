"""Kernels over a column of small matrices: one struct (nrows, ncols, values) a row, row-major.

Each result goes into a struct of plain arrays and numbers; a matrix that an operator refuses gets the
error's code in the column ``error`` and a null result, so one bad matrix does not end a job. Matrices of
one size in an Arrow batch are stacked and worked on together where a stacked kernel exists.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kernels as k
from .. import stacks
from ..errors import DimensionMismatch, EmptyInput, NumericError

MATRIX = "struct<nrows:int,ncols:int,values:array<double>>"
COMPLEX = "array<struct<re:double,im:double>>"
COMPLEX_MATRIX = f"struct<nrows:int,ncols:int,values:{COMPLEX}>"


def cell(rows: list[list[Column]]) -> Column:
    """A matrix column from columns."""
    flat = [x.cast("double") for r in rows for x in r]
    return F.struct(F.lit(len(rows)).alias("nrows"), F.lit(len(rows[0])).alias("ncols"), F.array(*flat).alias("values"))


def _complex(a):
    return a.astype(complex)


#: name -> (kernel, fields of the result, kernel for stacks or None); kernels take the options of ``apply``
OPERATORS: dict[str, tuple[Callable, str, Callable | None]] = {
    "lu_decompose": (k.lu, f"l {MATRIX}, u {MATRIX}", stacks.lu),
    "lu_solve": (lambda a, b: (k.lu_solve(a, b),), "x array<double>", stacks.lu_solve),
    "inverse": (lambda a: (k.inverse(a),), f"inverse {MATRIX}", stacks.inverse),
    "determinant": (lambda a: (k.determinant(a),), "determinant double", stacks.determinant),
    "log_determinant": (k.log_determinant, "sign int, ln_abs_det double", stacks.log_determinant),
    "cholesky_decompose": (lambda a: (k.cholesky(a),), f"l {MATRIX}", stacks.cholesky),
    "cholesky_solve": (lambda a, b: (k.cholesky_solve(a, b),), "x array<double>", stacks.cholesky_solve),
    "cholesky_inverse": (lambda a: (k.cholesky_inverse(a),), f"inverse {MATRIX}", stacks.cholesky_inverse),
    "solve_lower": (lambda a, b: (k.solve_lower(a, b),), "x array<double>", stacks.solve_lower),
    "solve_upper": (lambda a, b: (k.solve_upper(a, b),), "x array<double>", stacks.solve_upper),
    "solve_lower_complex": (lambda a, b: (k.solve_lower(_complex(a), b),), f"x {COMPLEX}", None),
    "solve_upper_complex": (lambda a, b: (k.solve_upper(_complex(a), b),), f"x {COMPLEX}", None),
    "qr_decompose": (k.qr, f"q {MATRIX}, r {MATRIX}, rank int", stacks.qr),
    "qr_decompose_complex": (lambda a, **o: k.qr(_complex(a), **o), f"q {COMPLEX_MATRIX}, r {COMPLEX_MATRIX}, rank int", None),
    "qr_reduced": (k.qr_reduced, f"q {MATRIX}, r {MATRIX}, rank int", stacks.qr_reduced),
    "qr_pivoted": (k.qr_pivoted, f"q {MATRIX}, r {MATRIX}, p {MATRIX}, rank int", None),
    "qr_reconstruct": (lambda q, r: (k.product(q, r),), f"product {MATRIX}", None),
    "qr_reconstruct_complex": (lambda q, r: (k.product(_complex(q), _complex(r)),), f"product {COMPLEX_MATRIX}", None),
    "qr_condition_number": (lambda r: (k.qr_condition(r),), "condition double", None),
    "least_squares": (lambda a, b, **o: (k.least_squares(a, b, **o),), "x array<double>", stacks.least_squares),
    "gram_schmidt": (lambda a: (k.gram_schmidt(a),), f"q {MATRIX}", stacks.gram_schmidt),
    "eigen_symmetric": (k.eigen_symmetric, f"values array<double>, vectors {MATRIX}", stacks.eigen_symmetric),
    "eigen_generalized": (k.eigen_generalized, f"values array<double>, vectors {MATRIX}", None),
    "eigen_generalized_spd": (k.eigen_generalized_spd, f"values array<double>, vectors {MATRIX}", None),
    "svd_decompose": (k.svd, f"u {MATRIX}, s array<double>, vt {MATRIX}", stacks.svd),
    "svd_decompose_complex": (lambda a: k.svd(_complex(a)), f"u {COMPLEX_MATRIX}, s array<double>, vt {COMPLEX_MATRIX}", None),
    "svd_with_tolerance": (k.svd_with_tolerance, f"u {MATRIX}, s array<double>, vt {MATRIX}", None),
    "svd_truncated": (k.svd_truncated, f"u {MATRIX}, s array<double>, vt {MATRIX}", None),
    "svd_reconstruct": (lambda u, s, vt: (k.svd_rebuild(u, s, vt),), f"product {MATRIX}", None),
    "svd_reconstruct_complex": (lambda u, s, vt: (k.svd_rebuild(_complex(u), s, _complex(vt)),), f"product {COMPLEX_MATRIX}", None),
    "svd_condition_number": (lambda a: (k.svd_condition(k.svd(a)[1]),), "condition double", stacks.svd_condition),
    "svd_rank": (lambda a, **o: (k.svd_rank(k.svd(a)[1], **o),), "rank int", None),
    "pseudo_inverse": (lambda a, **o: (k.pseudo_inverse(a, **o),), f"inverse {MATRIX}", stacks.pseudo_inverse),
    "null_space": (lambda a, **o: (k.null_space(a, **o),), f"basis {MATRIX}", None),
    "schur": (k.schur, f"q {MATRIX}, t {MATRIX}", stacks.schur),
    "polar": (k.polar, f"u {MATRIX}, p {MATRIX}", stacks.polar),
    "polar_complex": (lambda a: k.polar(_complex(a)), f"u {COMPLEX_MATRIX}, p {COMPLEX_MATRIX}", None),
    "sylvester": (lambda a, b, c: (k.sylvester(a, b, c),), f"x {MATRIX}", stacks.sylvester),
    "lyapunov": (lambda a, q: (k.lyapunov(a, q),), f"x {MATRIX}", None),
    "matrix_exp": (lambda a, **o: (k.exp_series(a, **o),), f"f {MATRIX}", None),
    "matrix_exp_eigen": (lambda a: (k.exp_eigen(a),), f"f {MATRIX}", stacks.exp_eigen),
    "matrix_log_taylor": (lambda a, **o: (k.log_series(a, **o),), f"f {MATRIX}", None),
    "matrix_log_eigen": (lambda a: (k.log_eigen(a),), f"f {MATRIX}", stacks.log_eigen),
    "matrix_log_svd": (lambda a: (k.log_svd(a),), f"f {MATRIX}", None),
    "matrix_power": (lambda a, p: (k.power(a, p),), f"f {MATRIX}", None),
    "matrix_sign": (lambda a: (k.sign(a),), f"f {MATRIX}", stacks.sign),
}


def _flat(values: pa.Array) -> np.ndarray:
    """Numbers, or structs (re, im), as one array; null is NaN."""
    if pa.types.is_struct(values.type):
        re, im = values.flatten()
        return _flat(re) + 1j * _flat(im)
    return values.to_numpy(zero_copy_only=False).astype(float)


class _Vectors:
    """A column of lists."""

    def __init__(self, column: pa.ListArray):
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)
        self.ends, self.flat = column.offsets.to_numpy(), _flat(column.values)

    def shape(self, i: int) -> tuple | None:
        return (int(self.ends[i + 1] - self.ends[i]),) if self.valid[i] else None

    def value(self, i: int) -> np.ndarray:
        if not self.valid[i]:
            raise EmptyInput
        return self.flat[self.ends[i] : self.ends[i + 1]]


class _Matrices:
    """A column of structs (nrows, ncols, values)."""

    def __init__(self, column: pa.StructArray):
        rows, cols, values = column.flatten()
        self.rows, self.cols = (x.fill_null(-1).to_numpy(zero_copy_only=False) for x in (rows, cols))
        self.lists = _Vectors(values)

    def shape(self, i: int) -> tuple | None:
        size = self.lists.shape(i)
        n, m = int(self.rows[i]), int(self.cols[i])
        return (n, m) if size is not None and n > 0 and m > 0 and n * m == size[0] else None

    def value(self, i: int) -> np.ndarray:
        flat = self.lists.value(i)
        if self.rows[i] * self.cols[i] != len(flat) or self.rows[i] < 0:
            raise DimensionMismatch("values do not fill the matrix")
        return flat.reshape(int(self.rows[i]), int(self.cols[i]))


class _Numbers:
    def __init__(self, column: pa.Array):
        self.items = column.to_pylist()

    def shape(self, i: int) -> None:
        return None

    def value(self, i: int):
        if self.items[i] is None:
            raise EmptyInput
        return self.items[i]


def _loader(column: pa.Array):
    if pa.types.is_struct(column.type):
        return _Matrices(column)
    return _Vectors(column) if pa.types.is_list(column.type) else _Numbers(column)


def _numbers(flat: np.ndarray, is_complex: bool) -> pa.Array:
    if not is_complex:
        return pa.array(flat.astype(float))
    return pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], ["re", "im"])


def _column(values: list, kind: T.DataType) -> pa.Array:
    """One field of all results; null where there is none."""
    if isinstance(kind, T.StructType):
        rows = [None if v is None else v.shape for v in values]
        lists = _column([None if v is None else v.reshape(-1) for v in values], kind["values"].dataType)
        sizes = (pa.array([None if r is None else r[i] for r in rows], pa.int32()) for i in (0, 1))
        return pa.StructArray.from_arrays([*sizes, lists], ["nrows", "ncols", "values"], mask=pa.array([v is None for v in values]))
    if isinstance(kind, T.ArrayType):
        parts = [np.zeros(0) if v is None else np.asarray(v) for v in values]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        flat = np.concatenate([*parts, np.zeros(0)])
        return pa.ListArray.from_arrays(pa.array(ends), _numbers(flat, isinstance(kind.elementType, T.StructType)), mask=pa.array([v is None for v in values]))
    return pa.array([None if v is None else v.item() if isinstance(v, np.generic) else v for v in values], pa.int32() if isinstance(kind, T.IntegerType) else pa.float64())


def _solved(args: list, n: int, kernel: Callable, stacked: Callable | None, options: dict) -> tuple[list, list]:
    """Results (tuples or None) and error codes of ``n`` rows."""
    results, errors = [None] * n, [None] * n
    rest = range(n)
    if stacked is not None:
        groups = defaultdict(list)
        for i in range(n):
            shapes = tuple(a.shape(i) for a in args)
            if None not in shapes and (stacked in _ANY or shapes[0][0] == shapes[0][1]) and all(s[0] == shapes[0][0] and (len(s) == 1 or stacked in _ANY or s == shapes[0]) for s in shapes):
                groups[shapes].append(i)
        for rows in groups.values():
            stack = [np.stack([a.value(i) for i in rows]) for a in args]
            real = not any(np.iscomplexobj(x) for x in stack)
            finite = np.logical_and.reduce([np.isfinite(x).reshape(len(rows), -1).all(1) for x in stack])
            if not real or not finite.any():
                continue
            with np.errstate(all="ignore"):
                found, ok = stacked(*(x[finite] for x in stack), **options)
            for place, i in enumerate(np.array(rows)[finite].tolist()):
                if ok[place]:
                    results[i] = tuple(f[place] for f in found)
        rest = [i for i in rest if results[i] is None]
    for i in rest:
        try:
            results[i] = tuple(np.asarray(v) if isinstance(v, np.ndarray) else v for v in kernel(*(a.value(i) for a in args), **options))
        except NumericError as e:
            errors[i] = e.code
    return results, errors


#: stacked kernels for matrices that need not be square
_ANY = {stacks.qr, stacks.qr_reduced, stacks.gram_schmidt, stacks.least_squares, stacks.svd, stacks.svd_condition, stacks.pseudo_inverse}


def apply(df: DataFrame, name: str, *columns: str, into: str = "result", **options) -> DataFrame:
    """``df`` with the struct column ``into`` (null on failure) and ``error`` (null on success).

    ``columns``: the operator's arguments, matrices as ``MATRIX`` or ``COMPLEX_MATRIX`` structs, vectors as
    arrays, parameters as numbers; fields of structs by their path (``result.q``). ``options``: tolerance,
    terms and the like, as the kernel has them. A narrow map: no shuffle, Arrow batches.
    """
    kernel, fields, stacked = OPERATORS[name]
    kind = T.StructType.fromDDL(fields)
    base = df.drop(into, "error")
    schema = T.StructType([*base.schema.fields, T.StructField(into, kind), T.StructField("error", T.StringType())])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = [_loader(batch.column(len(names) + i)) for i in range(len(columns))]
            results, errors = _solved(args, batch.num_rows, kernel, stacked, options)
            parts = [_column([None if r is None else r[i] for r in results], f.dataType) for i, f in enumerate(kind.fields)]
            made = pa.StructArray.from_arrays(parts, kind.names, mask=pa.array([r is None for r in results]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], made, pa.array(errors, pa.string())], [*names, into, "error"])

    return df.select(*(F.col(f"`{c}`") for c in names), *(F.col(c).alias(f"_argument{i}") for i, c in enumerate(columns))).mapInArrow(run, schema)
