"""Kernels over stacks of equal-sized real matrices (m x rows x columns), each step over the whole stack.

Every function returns its results and a mask of the matrices it has solved; the others (singular, not
symmetric, ...) are left to the kernels for one matrix, which tell what is wrong with them. Results are
those of these kernels: the same pivots, signs and tolerances.
"""

from __future__ import annotations

import numpy as np

from .kernels import TOLERANCE


def _rows(a: np.ndarray, at) -> np.ndarray:
    return a[np.arange(len(a)), at]


def lu_packed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed factors, row orders, signs of the orders, mask."""
    w, (m, n, _) = a.copy(), a.shape
    order, sign, ok = np.tile(np.arange(n), (m, 1)), np.ones(m), np.ones(m, bool)
    each = np.arange(m)
    for j in range(n):
        p = j + np.abs(w[:, j:, j]).argmax(1)
        ok &= np.abs(w[each, p, j]) > TOLERANCE
        swap = p != j
        sign[swap] *= -1
        w[each, p], w[:, j] = w[:, j].copy(), w[each, p].copy()
        order[each, p], order[:, j] = order[:, j].copy(), order[each, p].copy()
        w[:, j + 1 :, j] /= np.where(ok, w[:, j, j], 1)[:, None]
        w[:, j + 1 :, j + 1 :] -= w[:, j + 1 :, j, None] * w[:, j, None, j + 1 :]
    return w, order, sign, ok


def _lu_apply(w: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``b``: m x n x k."""
    x, n = np.take_along_axis(b, order[:, :, None], 1).astype(float), w.shape[1]
    for i in range(n):
        x[:, i] -= np.einsum("mj,mjk->mk", w[:, i, :i], x[:, :i])
    for i in range(n - 1, -1, -1):
        x[:, i] = (x[:, i] - np.einsum("mj,mjk->mk", w[:, i, i + 1 :], x[:, i + 1 :])) / w[:, i, i, None]
    return x


def lu(a):
    w, _, _, ok = lu_packed(a)
    return (np.tril(w, -1) + np.eye(a.shape[1]), np.triu(w)), ok


def lu_solve(a, b):
    w, order, _, ok = lu_packed(a)
    return (_lu_apply(w, order, b[:, :, None])[:, :, 0],), ok


def inverse(a):
    w, order, _, ok = lu_packed(a)
    return (_lu_apply(w, order, np.broadcast_to(np.eye(a.shape[1]), a.shape)),), ok


def determinant(a):
    w, _, sign, ok = lu_packed(a)
    out = sign * np.diagonal(w, axis1=1, axis2=2).prod(1)
    return (out,), ok & np.isfinite(out)


def log_determinant(a):
    (d,), ok = determinant(a)
    ok = ok & (np.abs(d) > TOLERANCE)
    return (np.where(d > 0, 1, -1), np.log(np.abs(np.where(ok, d, 1)))), ok


def cholesky(a):
    m, n, _ = a.shape
    out, ok = np.zeros_like(a), np.ones(m, bool)
    for j in range(n):
        pivot = a[:, j, j] - np.einsum("mk,mk->m", out[:, j, :j], out[:, j, :j])
        ok &= pivot > TOLERANCE
        out[:, j, j] = np.sqrt(np.where(ok, pivot, 1))
        out[:, j + 1 :, j] = (a[:, j + 1 :, j] - np.einsum("mik,mk->mi", out[:, j + 1 :, :j], out[:, j, :j])) / out[:, j, j, None]
    return (out,), ok


def _forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.zeros(b.shape)
    for i in range(low.shape[1]):
        x[:, i] = (b[:, i] - np.einsum("mj,mjk->mk", low[:, i, :i], x[:, :i])) / low[:, i, i, None]
    return x


def _backward(up: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.zeros(b.shape)
    for i in range(up.shape[1] - 1, -1, -1):
        x[:, i] = (b[:, i] - np.einsum("mj,mjk->mk", up[:, i, i + 1 :], x[:, i + 1 :])) / up[:, i, i, None]
    return x


def cholesky_solve(a, b):
    (low,), ok = cholesky(a)
    return (_backward(low.transpose(0, 2, 1), _forward(low, b[:, :, None]))[:, :, 0],), ok


def cholesky_inverse(a):
    (low,), ok = cholesky(a)
    half = _forward(low, np.broadcast_to(np.eye(a.shape[1]), a.shape))
    return (half.transpose(0, 2, 1) @ half,), ok


def _diagonal_ok(a: np.ndarray) -> np.ndarray:
    return (np.diagonal(a, axis1=1, axis2=2) != 0).all(1)


def solve_lower(a, b):
    ok = _diagonal_ok(a)
    safe = np.where(ok[:, None, None], a, np.eye(a.shape[1]))
    return (_forward(safe, b[:, :, None])[:, :, 0],), ok


def solve_upper(a, b):
    ok = _diagonal_ok(a)
    safe = np.where(ok[:, None, None], a, np.eye(a.shape[1]))
    return (_backward(safe, b[:, :, None])[:, :, 0],), ok


def qr(a, tolerance: float = TOLERANCE):
    """Modified Gram-Schmidt as for one matrix."""
    m, rows, n = a.shape
    q, r, rank = np.zeros(a.shape), np.zeros((m, n, n)), np.zeros(m, np.int64)
    limit = max(tolerance, TOLERANCE)
    for j in range(n):
        v = a[:, :, j].copy()
        for i in range(j):
            r[:, i, j] = np.einsum("mk,mk->m", q[:, :, i], v)
            v -= r[:, i, j, None] * q[:, :, i]
        size = np.linalg.norm(v, axis=1)
        r[:, j, j] = size
        some = size > limit
        q[:, :, j] = np.where(some[:, None], v / np.where(some, size, 1)[:, None], 0)
        rank += some
    return (q, r, rank), np.ones(m, bool)


def qr_reduced(a, tolerance: float = TOLERANCE):
    (q, r, rank), ok = qr(a, tolerance)
    keep = min(a.shape[1:])
    return (q[:, :, :keep], r[:, :keep], np.minimum(rank, keep)), ok


def gram_schmidt(a):
    (q, _, _), ok = qr(a)
    return (q,), ok


def least_squares(a, b, tolerance: float = TOLERANCE):
    m, rows, n = a.shape
    if rows < n:
        return (np.zeros((m, n)),), np.zeros(m, bool)
    (q, r, rank), _ = qr_reduced(a, tolerance)
    ok = rank == n
    safe = np.where(ok[:, None, None], r, np.eye(n))
    return (_backward(safe, np.einsum("mij,mi->mj", q, b)[:, :, None])[:, :, 0],), ok


def eigen_symmetric(a):
    ok = (np.abs(a - a.transpose(0, 2, 1)) <= TOLERANCE).all((1, 2))
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[:, ::-1], vectors[:, :, ::-1]
    big = np.abs(vectors).argmax(1)
    lead = np.take_along_axis(vectors, big[:, None, :], 1)
    return (values, vectors * np.where(lead < 0, -1.0, 1.0)), ok


def _of_spectrum(a, f, sound=None):
    (values, vectors), ok = eigen_symmetric(a)
    if sound is not None:
        ok = ok & sound(values)
    with np.errstate(all="ignore"):
        out = (vectors * f(values)[:, None, :]) @ vectors.transpose(0, 2, 1)
    return (out,), ok


def exp_eigen(a):
    return _of_spectrum(a, np.exp)


def log_eigen(a):
    return _of_spectrum(a, lambda v: np.log(np.maximum(v, TOLERANCE)), lambda v: (v > TOLERANCE).all(1))


def sign(a):
    return _of_spectrum(a, lambda v: np.where(np.abs(v) <= TOLERANCE, 0.0, np.sign(v)))


def svd(a):
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    return (np.where(s[:, None, :] > TOLERANCE, u, 0), s, vt), np.ones(len(a), bool)


def svd_condition(a):
    (_, s, _), ok = svd(a)
    large = np.where(s > TOLERANCE, s, np.inf).min(1)
    return (np.where(np.isfinite(large), s.max(1) / np.where(np.isfinite(large), large, 1), np.inf),), ok


def pseudo_inverse(a, tolerance: float | None = None):
    (u, s, vt), ok = svd(a)
    limit = s.max(1) * max(a.shape[1:]) * TOLERANCE if tolerance is None else np.full(len(a), tolerance)
    keep = s > limit[:, None]
    factor = np.where(keep, 1 / np.where(keep, s, 1), 0)
    return ((vt.transpose(0, 2, 1) * factor[:, None, :]) @ u.transpose(0, 2, 1),), ok


def polar(a):
    (u, s, vt), ok = svd(a)
    return (u @ vt, (vt.transpose(0, 2, 1) * s[:, None, :]) @ vt), ok


def schur(a, steps: int = 128):
    """QR iteration by LAPACK's factors with their signs turned; those of singular or not converging matrices are left."""
    m, n, _ = a.shape
    t, total = a.copy(), np.tile(np.eye(n), (m, 1, 1))
    ok, live = np.zeros(m, bool), np.arange(m)
    for _ in range(steps + 1):
        done = np.linalg.norm(np.tril(t[live], -1), axis=(1, 2)) < TOLERANCE
        ok[live[done]] = True
        live = live[~done]
        if not len(live):
            break
        q, r = np.linalg.qr(t[live])
        diagonal = np.diagonal(r, axis1=1, axis2=2)
        full = (np.abs(diagonal) > TOLERANCE).all(1)
        live, q, r = live[full], q[full], r[full]
        turn = np.where(diagonal[full] < 0, -1.0, 1.0)
        q, r = q * turn[:, None, :], r * turn[:, :, None]
        t[live], total[live] = r @ q, total[live] @ q
    return (total, t), ok


def sylvester(a, b, c):
    """The Kronecker systems by LAPACK, for matrices whose spectra's sums are clearly not 0; the others are left."""
    m, n = a.shape[0], a.shape[1]
    sums = np.linalg.eigvals(a)[:, :, None] + np.linalg.eigvals(b)[:, None, :]
    scale = np.abs(a).sum((1, 2)) + np.abs(b).sum((1, 2))
    ok = (np.abs(sums).min((1, 2)) > 1e-6 * scale) & (b.shape[1:] == (n, n)) & (c.shape[1:] == (n, n))
    out, eye = np.zeros(c.shape), np.eye(n)
    step = max(1, (1 << 22) // n**4)
    rows = np.flatnonzero(ok)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        # (i, j) by (k, l): a[i, k] where j = l, and b[l, j] where i = k
        system = np.einsum("mik,jl->mijkl", a[part], eye) + np.einsum("mlj,ik->mijkl", b[part], eye)
        out[part] = np.linalg.solve(system.reshape(len(part), n * n, n * n), c[part].reshape(len(part), n * n, 1)).reshape(len(part), n, n)
    return (out,), ok
