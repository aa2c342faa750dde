import numpy as np
import pytest

from fleetcast.operators import solvers
from fleetcast.operators.regress import L1_RATIOS, alpha_values


def moment(x, y):
    v = np.column_stack([np.ones(len(y)), x, y])
    return v.T @ v


@pytest.fixture
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    x[:, 3] = x[:, 0] + 0.05 * rng.normal(size=60)
    y = 10 + 2 * x[:, 0] - x[:, 1] + 0.3 * x[:, 2] + rng.normal(size=60)
    return (x - x.mean(0)) / x.std(0), y


def descent(x, y, alpha, ratio, passes=20000):
    """Plain coordinate descent on the rows, the textbook reference."""
    n, xm, ym = len(y), x.mean(0), y.mean()
    xc, yc = x - xm, y - ym
    b = np.zeros(x.shape[1])
    for _ in range(passes):
        old = b.copy()
        for j in range(len(b)):
            z = xc[:, j] @ (yc - xc @ b + xc[:, j] * b[j]) / n
            b[j] = np.sign(z) * max(abs(z) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
        if np.abs(b - old).max() < 1e-12:
            break
    return b, ym - b @ xm


def test_unpack_round_trip(data):
    m = moment(*data)
    assert np.allclose(solvers.unpack(m[np.triu_indices(len(m))]), m)


def test_least_squares_equals_row_solution(data):
    x, y = data
    b, b0 = solvers.least_squares(moment(x, y))
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)
    assert np.allclose([b0, *b], want)


def test_collinear_drivers_give_minimum_norm(data):
    x, y = data
    x = np.column_stack([x[:, 0], x[:, 0]])
    b, _ = solvers.least_squares(moment(x, y))
    assert b[0] == pytest.approx(b[1])


def test_ridge_tends_to_least_squares(data):
    m = moment(*data)
    b, b0 = solvers.ridge_path(m, np.array([1e-9]))
    assert np.allclose(b[0], solvers.least_squares(m)[0], atol=1e-6)


@pytest.mark.parametrize("ratio", L1_RATIOS)
def test_elastic_path_equals_descent(data, ratio):
    x, y = data
    alphas = np.array([5.0, 1.0, 0.3, 0.1, 0.03, 0.01, 0.005])
    b, b0 = solvers.elastic_path(moment(x, y), alphas, ratio)
    for i, alpha in enumerate(alphas):
        want, want0 = descent(x, y, alpha, ratio)
        assert np.allclose(b[i], want, atol=1e-6)
        assert b0[i] == pytest.approx(want0, abs=1e-6)


def test_lasso_optimality_on_full_grid(data):
    x, y = data
    alphas = alpha_values(5000)
    b, b0 = solvers.elastic_path(moment(x, y), alphas, 1.0)
    res = y[None, :] - b @ x.T - b0[:, None]
    grad = res @ x / len(y)
    active = b != 0
    assert (np.abs(grad) <= alphas[:, None] * (1 + 1e-6) + 1e-8).all()
    assert np.allclose(grad[active], (alphas[:, None] * np.sign(b))[active], atol=1e-6)


def test_cross_validation_by_subtraction_equals_refits(data):
    x, y = data
    folds = np.array_split(np.arange(len(y)), 5)
    grams = [moment(x[f], y[f]) for f in folds]
    alphas = np.geomspace(100, 0.01, 30)
    scores = np.zeros(len(alphas))
    for f in folds:
        keep = np.setdiff1d(np.arange(len(y)), f)
        xm, ym = x[keep].mean(0), y[keep].mean()
        xc, yc = x[keep] - xm, y[keep] - ym
        for i, a in enumerate(alphas):
            b = np.linalg.solve(xc.T @ xc + a * np.eye(4), xc.T @ yc)
            err = y[f] - ym - (x[f] - xm) @ b
            scores[i] += 1 - err @ err / ((y[f] - y[f].mean()) ** 2).sum()
    b, b0, alpha, score = solvers.ridge_cv(grams, alphas, 5, False)
    assert alpha == alphas[np.argmax(scores)]
    assert score == pytest.approx(scores.max() / 5)


def test_elastic_cv_equals_refits(data):
    x, y = data
    folds = np.array_split(np.arange(len(y)), 5)
    grams = [moment(x[f], y[f]) for f in folds]
    alphas, ratios = np.geomspace(3, 0.01, 8), (0.5, 1.0)
    best = (np.inf,)
    for r in ratios:
        for a in alphas:
            mse = 0
            for f in folds:
                keep = np.setdiff1d(np.arange(len(y)), f)
                b, b0 = descent(x[keep], y[keep], a, r)
                mse += ((y[f] - b0 - x[f] @ b) ** 2).mean()
            if mse < best[0] - 1e-12:
                best = (mse, a, r)
    _, _, alpha, ratio, mse = solvers.elastic_cv(grams, alphas, ratios, 5, False)
    assert (alpha, ratio) == (best[1], best[2])
    assert mse == pytest.approx(best[0] / 5)


def test_walk_forward_pairs():
    m = [np.full((2, 2), float(v)) for v in (1, 2, 4, 8)]
    pairs = solvers.train_test(m, 3, True)
    assert [(t[0, 0], s[0, 0]) for t, s in pairs] == [(8, 4), (12, 2), (14, 1)]


def test_student_t_tail():
    # Table values of the two-sided 5 % points.
    for dof, point in ((1, 12.706), (5, 2.571), (30, 2.042), (50, 2.009)):
        assert solvers.t_two_sided(np.array([point]), dof)[0] == pytest.approx(0.05, abs=2e-4)
