"""Kernels for one small dense matrix, in numpy alone; real or complex where that makes sense."""

from __future__ import annotations

import numpy as np

from .errors import (
    ConvergenceFailed,
    DimensionMismatch,
    EmptyInput,
    InvalidInput,
    NotPositiveDefinite,
    NotSquare,
    NotSymmetric,
    NumericalInstability,
    NumericError,
    SingularMatrix,
)

TOLERANCE = 1e-12
EPSILON = float(np.finfo(float).eps)


def matrix(a, *, square: bool = False, finite: type[NumericError] | None = NumericalInstability) -> np.ndarray:
    a = np.asarray(a)
    if not a.size:
        raise EmptyInput
    if square and a.shape[0] != a.shape[1]:
        raise NotSquare(f"{a.shape}")
    if finite and not np.isfinite(a).all():
        raise finite("not finite")
    return a.astype(complex if np.iscomplexobj(a) else float)


def vector(b, n: int, kind: type[NumericError] = DimensionMismatch) -> np.ndarray:
    b = np.asarray(b)
    if b.shape != (n,):
        raise kind(f"{b.shape} for {n} rows")
    return b.astype(complex if np.iscomplexobj(b) else float)


# LU -------------------------------------------------------------------------------------------


def lu_packed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """L below and U on the diagonal and above; row order; sign of the order. The first largest pivot wins."""
    w = a.astype(float, copy=True)
    n, sign = len(w), 1
    order = np.arange(n)
    for j in range(n):
        p = j + int(np.abs(w[j:, j]).argmax())
        if abs(w[p, j]) <= TOLERANCE:
            raise SingularMatrix(f"pivot {j}")
        if p != j:
            w[[j, p]], order[[j, p]], sign = w[[p, j]], order[[p, j]], -sign
        w[j + 1 :, j] /= w[j, j]
        w[j + 1 :, j + 1 :] -= np.outer(w[j + 1 :, j], w[j, j + 1 :])
    return w, order, sign


def lu(a) -> tuple[np.ndarray, np.ndarray]:
    w, _, _ = lu_packed(matrix(a, square=True))
    return np.tril(w, -1) + np.eye(len(w)), np.triu(w)


def _lu_apply(w: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b[order].astype(float)
    for i in range(len(w)):
        x[i] -= w[i, :i] @ x[:i]
    for i in range(len(w) - 1, -1, -1):
        x[i] = (x[i] - w[i, i + 1 :] @ x[i + 1 :]) / w[i, i]
    return x


def lu_solve(a, b) -> np.ndarray:
    a = matrix(a, square=True)
    b = vector(b, len(a))
    w, order, _ = lu_packed(a)
    return _lu_apply(w, order, b)


def inverse(a) -> np.ndarray:
    a = matrix(a, square=True)
    w, order, _ = lu_packed(a)
    return _lu_apply(w, order, np.eye(len(a)))


def determinant(a) -> float:
    """Of a singular matrix an error, not 0."""
    w, _, sign = lu_packed(matrix(a, square=True))
    out = sign * float(np.prod(np.diag(w)))
    if not np.isfinite(out):
        raise NumericalInstability("determinant overflows")
    return out


def log_determinant(a) -> tuple[int, float]:
    d = determinant(a)
    if abs(d) <= TOLERANCE:
        raise SingularMatrix("determinant vanishes")
    return (1 if d > 0 else -1), float(np.log(abs(d)))


# Cholesky and triangular systems --------------------------------------------------------------


def cholesky(a) -> np.ndarray:
    """Lower factor; only the lower triangle is read."""
    a = matrix(a, square=True)
    n = len(a)
    out = np.zeros((n, n))
    for j in range(n):
        pivot = a[j, j] - out[j, :j] @ out[j, :j]
        if pivot <= TOLERANCE:
            raise NotPositiveDefinite(f"pivot {j}")
        out[j, j] = np.sqrt(pivot)
        out[j + 1 :, j] = (a[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j]) / out[j, j]
    return out


def cholesky_solve(a, b) -> np.ndarray:
    a = np.asarray(a, float)
    b = vector(b, a.shape[0] if a.ndim else 0, InvalidInput)
    low = cholesky(a)
    return solve_upper(low.T, solve_lower(low, b))


def cholesky_inverse(a) -> np.ndarray:
    low = cholesky(a)
    half = np.stack([solve_lower(low, e) for e in np.eye(len(low))], 1)
    return half.T @ half


def _triangular(a, b, order) -> np.ndarray:
    a = matrix(a, square=True, finite=None)
    if not np.asarray(b).size:
        raise EmptyInput
    b = vector(b, len(a))
    kind = complex if np.iscomplexobj(a) or np.iscomplexobj(b) else float
    limit = EPSILON if kind is complex else 0.0
    x = np.zeros(len(a), kind)
    for i in order(len(a)):
        if abs(a[i, i]) <= limit:
            raise SingularMatrix(f"pivot {i}")
        done = slice(None, i) if order is range else slice(i + 1, None)
        x[i] = (b[i] - a[i, done] @ x[done]) / a[i, i]
    return x


def solve_lower(a, b) -> np.ndarray:
    """Real pivots must not be 0 exactly, complex ones not within machine precision."""
    return _triangular(a, b, range)


def _backward(n: int) -> range:
    return range(n - 1, -1, -1)


def solve_upper(a, b) -> np.ndarray:
    return _triangular(a, b, _backward)


# QR -------------------------------------------------------------------------------------------


def qr(a, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Modified Gram-Schmidt: Q (m x n), R (n x n) with a diagonal >= 0, rank; dependent columns of Q are 0."""
    a = matrix(a)
    m, n = a.shape
    q, r, rank = np.zeros((m, n), a.dtype), np.zeros((n, n), a.dtype), 0
    limit = max(tolerance, TOLERANCE)
    for j in range(n):
        v = a[:, j].copy()
        for i in range(j):
            r[i, j] = np.vdot(q[:, i], v)
            v -= r[i, j] * q[:, i]
        size = float(np.linalg.norm(v))
        r[j, j] = size
        if size > limit:
            q[:, j] = v / size
            rank += 1
    return q, r, rank


def qr_reduced(a, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    q, r, rank = qr(a, tolerance)
    keep = min(q.shape)
    return q[:, :keep], r[:keep], min(rank, keep)


def qr_pivoted(a, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same factors and an identity permutation."""
    q, r, rank = qr(a, tolerance)
    return q, r, np.eye(r.shape[0]), rank


def least_squares(a, b, tolerance: float = TOLERANCE) -> np.ndarray:
    a = matrix(a)
    m, n = a.shape
    b = vector(b, m, InvalidInput)
    if m < n:
        raise InvalidInput("fewer rows than columns")
    q, r, rank = qr_reduced(a, tolerance)
    if rank < n:
        raise SingularMatrix("dependent columns")
    return solve_upper(r, q.T @ b)


def product(a, b) -> np.ndarray:
    """Of two factors."""
    a, b = matrix(a, finite=None), matrix(b, finite=None)
    if a.shape[1] != b.shape[0]:
        raise DimensionMismatch
    return a @ b


def qr_condition(r: np.ndarray) -> float:
    d = np.abs(np.diag(r))
    if not d.size:
        return 0.0
    large = d[d > TOLERANCE]
    return float(d.max() / large.min()) if large.size else float("inf")


def gram_schmidt(a) -> np.ndarray:
    return qr(a)[0]


# Spectra --------------------------------------------------------------------------------------


def is_symmetric(a: np.ndarray, tolerance: float = TOLERANCE) -> bool:
    return bool((np.abs(a - a.T) <= tolerance).all())


def eigen_symmetric(a, finite: type[NumericError] = NumericalInstability) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, eigenvectors in columns; each vector's largest component is positive."""
    a = matrix(a, square=True, finite=finite)
    if not is_symmetric(a):
        raise NotSymmetric
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[::-1], vectors[:, ::-1]
    big = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[big, np.arange(len(a))] < 0, -1.0, 1.0)


def eigen_generalized(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the symmetric part of inverse(b) a for positive definite b: exact only where that product is symmetric."""
    a, b = matrix(a, square=True), matrix(b, square=True)
    if a.shape != b.shape:
        raise DimensionMismatch
    if not (is_symmetric(a) and is_symmetric(b)):
        raise NotSymmetric
    c = cholesky_inverse(b) @ a
    return eigen_symmetric((c + c.T) / 2)


def eigen_generalized_spd(a, b) -> tuple[np.ndarray, np.ndarray]:
    """The true generalized problem for positive definite b."""
    low = cholesky(b)
    half = np.linalg.solve(low, np.linalg.solve(low, matrix(a, square=True)).T).T
    values, vectors = eigen_symmetric((half + half.T) / 2)
    return values, np.linalg.solve(low.T, vectors)


def svd(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin factors u, s (falling), vt; columns of u for s <= 1e-12 are 0."""
    a = matrix(a, finite=InvalidInput)
    try:
        u, s, vt = np.linalg.svd(a, full_matrices=False)
    except np.linalg.LinAlgError as e:
        raise ConvergenceFailed(str(e)) from e
    return np.where(s > TOLERANCE, u, 0), s, vt


def svd_with_tolerance(a, tolerance: float):
    u, s, vt = svd(a)
    return u, np.where(s < tolerance, 0.0, s), vt


def svd_truncated(a, k: int):
    if k <= 0:
        raise InvalidInput("k must be positive")
    u, s, vt = svd(a)
    return u[:, :k], s[:k], vt[:k]


def svd_rebuild(u, s, vt) -> np.ndarray:
    u, s, vt = np.asarray(u), np.asarray(s), np.asarray(vt)
    if u.shape[1] != len(s) or vt.shape[0] != len(s):
        raise InvalidInput("factors do not fit")
    return (u * s) @ vt


def svd_condition(s) -> float:
    s = np.asarray(s, float)
    if not s.size:
        return 0.0
    large = s[s > TOLERANCE]
    return float(s.max() / large.min()) if large.size else float("inf")


def svd_rank(s, tolerance: float | None = None) -> int:
    s = np.asarray(s, float)
    if not s.size:
        return 0
    return int((s > (s.max() * len(s) * EPSILON if tolerance is None else tolerance)).sum())


def pseudo_inverse(a, tolerance: float | None = None) -> np.ndarray:
    u, s, vt = svd(a)
    limit = s.max() * max(np.shape(a)) * TOLERANCE if tolerance is None else tolerance
    keep = s > limit
    return (vt[keep].conj().T / s[keep]) @ u[:, keep].conj().T


def null_space(a, tolerance: float | None = None) -> np.ndarray:
    a = matrix(a, finite=InvalidInput)
    n = a.shape[1]
    _, s, vt = np.linalg.svd(a, full_matrices=True)
    full = np.concatenate((s, np.zeros(n - len(s))))
    limit = full.max() * n * TOLERANCE if tolerance is None else tolerance
    return vt[full <= limit].T


def schur(a, steps: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Q and triangular T by plain QR iteration; complex pairs do not converge."""
    t = matrix(a, square=True)
    total = np.eye(len(t))
    for _ in range(steps + 1):
        if np.linalg.norm(np.tril(t, -1)) < TOLERANCE:
            return total, t
        q, r, _ = qr(t)
        t, total = r @ q, total @ q
    raise ConvergenceFailed("QR iteration")


def polar(a) -> tuple[np.ndarray, np.ndarray]:
    a = matrix(a, square=True)
    u, s, vt = svd(a)
    return u @ vt, (vt.conj().T * s) @ vt


# Matrix equations and functions ---------------------------------------------------------------


def sylvester(a, b, c) -> np.ndarray:
    """X of A X + X B = C; every failure of the linear system counts as a singular one."""
    a, b = (matrix(x, square=True, finite=None) for x in (a, b))
    c = matrix(c, finite=None)
    if c.shape != (len(a), len(b)):
        raise DimensionMismatch
    system = np.kron(a, np.eye(len(b))) + np.kron(np.eye(len(a)), b.T)
    try:
        return lu_solve(system, c.reshape(-1)).reshape(c.shape)
    except (SingularMatrix, NumericalInstability) as e:
        raise SingularMatrix(str(e)) from e


def lyapunov(a, q) -> np.ndarray:
    a, q = matrix(a, square=True, finite=None), matrix(q, square=True, finite=None)
    if a.shape != q.shape:
        raise DimensionMismatch
    return sylvester(a, a.T, -q)


def exp_series(a, terms: int = 128, tolerance: float = TOLERANCE) -> np.ndarray:
    """Taylor series; returned even where the terms have not become small."""
    a = matrix(a, square=True, finite=InvalidInput)
    out = term = np.eye(len(a))
    for k in range(1, max(1, terms) + 1):
        term = term @ a / k
        out = out + term
        if np.abs(term).max() <= max(tolerance, TOLERANCE):
            break
    return out


def log_series(a, terms: int = 128, tolerance: float = TOLERANCE) -> np.ndarray:
    """Series around the identity: right for matrices near it only."""
    a = matrix(a, square=True, finite=InvalidInput)
    base = a - np.eye(len(a))
    power, out = np.eye(len(a)), np.zeros_like(a)
    for k in range(1, max(1, terms) + 1):
        power = power @ base
        term = power / k
        out = out + term if k % 2 else out - term
        if np.abs(term).max() <= max(tolerance, TOLERANCE):
            break
    return out


def _of_spectrum(a, f) -> np.ndarray:
    values, vectors = eigen_symmetric(a, InvalidInput)
    return (vectors * f(values)) @ vectors.T


def exp_eigen(a) -> np.ndarray:
    a = matrix(a, square=True, finite=InvalidInput)
    return _of_spectrum(a, np.exp) if is_symmetric(a) else exp_series(a)


def _positive(values: np.ndarray) -> np.ndarray:
    if (values <= TOLERANCE).any():
        raise NotPositiveDefinite
    return np.log(values)


def log_eigen(a) -> np.ndarray:
    return _of_spectrum(a, _positive)


def log_svd(a) -> np.ndarray:
    """The logarithm for symmetric positive definite matrices; symmetry is not checked."""
    u, s, vt = svd(matrix(a, square=True, finite=InvalidInput))
    return (u * _positive(s)) @ vt


def power(a, p: float) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return _of_spectrum(a, lambda v: np.power(v, p))


def sign(a) -> np.ndarray:
    return _of_spectrum(a, lambda v: np.where(np.abs(v) <= TOLERANCE, 0.0, np.sign(v)))
