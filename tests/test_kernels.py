import numpy as np
import pytest

from latticework import errors, kernels

RNG = np.random.default_rng(5)


def random(n, m=None):
    return RNG.normal(size=(n, m or n))


def spd(n):
    b = random(n)
    return b @ b.T + np.eye(n)


def test_lu_solves_and_inverts():
    a, b = random(6) + 6 * np.eye(6), RNG.normal(size=6)
    low, up = kernels.lu(a)
    assert np.allclose(np.sort((low @ up).ravel()), np.sort(a.ravel()))
    assert np.allclose(a @ kernels.lu_solve(a, b), b)
    assert np.allclose(a @ kernels.inverse(a), np.eye(6))
    assert np.isclose(kernels.determinant(a), np.linalg.det(a))
    sign, log = kernels.log_determinant(a)
    assert np.isclose(sign * np.exp(log), np.linalg.det(a))


def test_refusals():
    with pytest.raises(errors.SingularMatrix):
        kernels.determinant([[1, 2], [2, 4]])
    with pytest.raises(errors.NotSquare):
        kernels.lu([[1.0, 2, 3]])
    with pytest.raises(errors.EmptyInput):
        kernels.qr(np.zeros((0, 2)))
    with pytest.raises(errors.NumericalInstability):
        kernels.cholesky([[np.nan]])
    with pytest.raises(errors.NotPositiveDefinite):
        kernels.cholesky([[1, 2], [2, 1]])
    with pytest.raises(errors.NotSymmetric):
        kernels.eigen_symmetric([[1, 2], [3, 4]])
    with pytest.raises(errors.InvalidInput):
        kernels.svd([[np.inf]])
    with pytest.raises(errors.ConvergenceFailed):
        kernels.schur([[0, 1], [-1, 0]])
    with pytest.raises(errors.SingularMatrix):
        kernels.sylvester([[1]], [[-1]], [[1]])
    with pytest.raises(errors.SingularMatrix):
        kernels.solve_lower([[0.0]], [1.0])


def test_cholesky_reads_the_lower_triangle():
    a, b = spd(5), RNG.normal(size=5)
    assert np.allclose(kernels.cholesky(np.tril(a)) @ kernels.cholesky(a).T, a)
    assert np.allclose(a @ kernels.cholesky_solve(a, b), b)
    assert np.allclose(a @ kernels.cholesky_inverse(a), np.eye(5))


@pytest.mark.parametrize("shape", [(6, 3), (4, 4)])
def test_qr_real_and_complex(shape):
    for a in (random(*shape), random(*shape) + 1j * random(*shape)):
        q, r, rank = kernels.qr(a)
        assert rank == shape[1] and np.allclose(q @ r, a) and (np.diag(r).real >= 0).all()
        assert np.allclose(q.conj().T @ q, np.eye(shape[1]))


def test_qr_of_dependent_columns():
    q, _, rank = kernels.qr([[1, 2], [2, 4], [3, 6.0]])
    assert rank == 1 and not q[:, 1].any()
    with pytest.raises(errors.SingularMatrix):
        kernels.least_squares([[1, 2], [2, 4], [3, 6.0]], [1, 2, 3])
    a, b = random(9, 3), RNG.normal(size=9)
    assert np.allclose(kernels.least_squares(a, b), np.linalg.lstsq(a, b, rcond=None)[0])


def test_spectra():
    a = spd(20)
    values, vectors = kernels.eigen_symmetric(a)
    assert (np.diff(values) <= 0).all() and np.allclose((vectors * values) @ vectors.T, a)
    b = spd(20)
    values, vectors = kernels.eigen_generalized_spd(a, b)
    assert np.allclose(a @ vectors, b @ vectors * values)
    m = random(7, 4)
    assert np.allclose(kernels.svd_rebuild(*kernels.svd(m)), m)
    assert np.allclose(kernels.pseudo_inverse(m), np.linalg.pinv(m))
    low = random(6, 2) @ random(2, 5)
    assert np.allclose(low @ kernels.null_space(low), 0, atol=1e-9) and kernels.null_space(low).shape == (5, 3)
    q, t = kernels.schur([[4, 1], [2, 3.0]])
    assert np.allclose(q @ t @ q.T, [[4, 1], [2, 3]]) and abs(t[1, 0]) < 1e-9
    u, p = kernels.polar(random(5))
    assert np.allclose(u @ u.T, np.eye(5)) and (np.linalg.eigvalsh(p) > 0).all()


def test_equations_and_functions():
    a, b, c = random(3) + 4 * np.eye(3), random(2) + 4 * np.eye(2), random(3, 2)
    x = kernels.sylvester(a, b, c)
    assert np.allclose(a @ x + x @ b, c)
    x = kernels.lyapunov(a, np.eye(3))
    assert np.allclose(a @ x + x @ a.T, -np.eye(3))
    s = spd(4) / 4
    assert np.allclose(kernels.exp_series(s), kernels.exp_eigen(s))
    assert np.allclose(kernels.log_eigen(kernels.exp_eigen(s)), s) and np.allclose(kernels.log_svd(s), kernels.log_eigen(s))
    near = np.eye(3) + random(3) / 50
    near = (near + near.T) / 2
    assert np.allclose(kernels.log_series(near), kernels.log_eigen(near))
    root = kernels.power(s, 0.5)
    assert np.allclose(root @ root, s)
    assert np.allclose(kernels.sign(np.diag([2.0, -3.0, 0.0])), np.diag([1, -1, 0]))
    assert np.isnan(kernels.power(np.diag([1.0, -1.0]), 0.5)).any()
