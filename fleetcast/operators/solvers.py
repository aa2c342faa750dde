"""Small dense solves from moment matrices (k drivers, no data rows).

Called on batches of series inside Spark tasks; sizes depend on the number of drivers and
penalties only.
"""

from __future__ import annotations

import math

import numpy as np


def unpack(flat: np.ndarray) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    flat = np.asarray(flat, dtype=float)
    p = int((math.isqrt(8 * len(flat) + 1) - 1) // 2)
    m = np.zeros((p, p))
    upper = np.triu_indices(p)
    m[upper] = flat
    m.T[upper] = flat
    return m


def centered(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """``(n, A, c, x_mean, y_mean)`` with ``A``, ``c`` the centered cross products."""
    n = m[0, 0]
    xm, ym = m[0, 1:-1] / n, m[0, -1] / n
    return n, m[1:-1, 1:-1] - n * np.outer(xm, xm), m[1:-1, -1] - n * xm * ym, xm, ym


def squared_error(m: np.ndarray, b: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """Sum of squared errors of many models ``(b0, b)`` on the rows behind ``m``."""
    r = np.column_stack([-b0, -b, np.ones(len(b0))])
    return ((r @ m) * r).sum(axis=1)


def least_squares(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Minimum-norm solution, so collinear drivers are allowed."""
    _, a, c, xm, ym = centered(m)
    b = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ c
    return b, ym - xm @ b


def train_test(folds: list[np.ndarray], k: int, walk_forward: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training and test moments per fold, by subtraction or by suffix sums."""
    total = sum(folds)
    if not walk_forward:
        return [(total - f, f) for f in folds]
    # Fold 1 is the most recent block; training rows are all older blocks.
    older = [sum(folds[j + 1:]) for j in range(min(k, len(folds) - 1))]
    return [(o, folds[j]) for j, o in enumerate(older)][::-1]


def ridge_path(m: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients for all penalties from one eigendecomposition."""
    _, a, c, xm, ym = centered(m)
    w, v = np.linalg.eigh(a)
    b = ((v.T @ c) / (np.maximum(w, 0.0) + alphas[:, None])) @ v.T
    return b, ym - b @ xm


def ridge_cv(folds, alphas, k, walk_forward) -> tuple[np.ndarray, float, float, float]:
    """Penalty with the best mean R2; ties go to the first (largest) penalty."""
    scores = np.zeros(len(alphas))
    pairs = train_test(folds, k, walk_forward)
    for train, test in pairs:
        b, b0 = ridge_path(train, alphas)
        spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
        scores += 1.0 - squared_error(test, b, b0) / spread
    best = int(np.argmax(scores))
    b, b0 = ridge_path(sum(folds), alphas[best:best + 1])
    return b[0], float(b0[0]), float(alphas[best]), float(scores[best] / len(pairs))


def _active_set(q_mat, q_vec, l1, l2, signs) -> np.ndarray:
    """Signs of the solution at one penalty, by adding and dropping single drivers."""
    k = len(q_vec)
    for _ in range(8 * k + 16):
        act = np.flatnonzero(signs)
        b = np.zeros(k)
        if len(act):
            lhs = q_mat[act][:, act]
            # A trace-sized jitter keeps collinear drivers solvable.
            lhs[np.diag_indices(len(act))] += l2 + 1e-13 * lhs.trace()
            b[act] = np.linalg.solve(lhs, q_vec[act] - l1 * signs[act])
            wrong = b[act] * signs[act]
            if wrong.min() <= 0:
                signs[act[int(np.argmin(wrong))]] = 0
                continue
        grad = q_vec - q_mat @ b - l2 * b
        grad[act] = 0.0
        j = int(np.argmax(np.abs(grad)))
        if abs(grad[j]) <= l1 * (1 + 1e-10):
            return signs
        signs[j] = np.sign(grad[j])
    return _descent_signs(q_mat, q_vec, l1, l2)


def _descent_signs(q_mat, q_vec, l1, l2) -> np.ndarray:
    """Cyclic coordinate descent, for the rare case that the search above cycles."""
    b = np.zeros(len(q_vec))
    for _ in range(10000):
        moved = 0.0
        for j in range(len(b)):
            z = q_vec[j] - q_mat[j] @ b + q_mat[j, j] * b[j]
            new = math.copysign(max(abs(z) - l1, 0.0), z) / (q_mat[j, j] + l2) if q_mat[j, j] + l2 > 0 else 0.0
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved <= 1e-12 * max(1.0, np.abs(b).max()):
            break
    return np.sign(b)


def elastic_path(m: np.ndarray, alphas: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Elastic-net coefficients for falling penalties, exact up to rounding.

    While the set of non-zero drivers and their signs stay the same, the solution is a
    closed form in the penalty; the path is a handful of such stretches.
    """
    n, a, c, xm, ym = centered(m)
    q_mat, q_vec = a / n, c / n
    l1, l2 = alphas * ratio, alphas * (1 - ratio)
    b = np.zeros((len(alphas), len(c)))
    signs = np.zeros(len(c))
    # Above the largest correlation every coefficient is zero.
    i = int(np.searchsorted(-l1, -np.abs(q_vec).max(), side="right")) if len(c) else len(alphas)
    while i < len(alphas):
        signs = _active_set(q_mat, q_vec, l1[i], l2[i], signs.copy())
        act, rest = np.flatnonzero(signs), np.flatnonzero(signs == 0)
        if len(act) == 0:
            i += 1
            continue
        w, v = np.linalg.eigh(q_mat[act][:, act])
        inactive = q_mat[act][:, rest]
        sign, target, start, size, whole = signs[act], q_vec[act], i, 32, True
        # Growing blocks: a short stretch does not pay for the whole rest of the grid.
        while whole and i < len(alphas):
            a1, a2 = l1[i:i + size, None], l2[i:i + size, None]
            weight = w + a2
            weight = np.where(weight > 1e-13 * w[-1], weight, np.inf)
            coef = (((target - a1 * sign) @ v) / weight) @ v.T
            holds = (coef * sign > 0).all(axis=1)
            if len(rest):
                holds &= (np.abs(q_vec[rest] - coef @ inactive) <= a1 * (1 + 1e-9)).all(axis=1)
            if i == start:
                holds[0] = True
            whole = bool(holds.all())
            length = len(holds) if whole else int(np.argmin(holds))
            b[i:i + length, act] = coef[:length]
            i, size = i + length, size * 4
    return b, ym - b @ xm


def elastic_cv(folds, alphas, ratios, k, walk_forward) -> tuple[np.ndarray, float, float, float, float]:
    """Penalty and mix with the least mean squared error; the first of equals wins."""
    best = (np.inf, 0, 0)
    pairs = train_test(folds, k, walk_forward)
    for r, ratio in enumerate(ratios):
        error = np.zeros(len(alphas))
        for train, test in pairs:
            b, b0 = elastic_path(train, alphas, ratio)
            error += squared_error(test, b, b0) / test[0, 0]
        i = int(np.argmin(error))
        if error[i] < best[0]:
            best = (error[i], i, r)
    err, i, r = best
    b, b0 = elastic_path(sum(folds), alphas[i:i + 1], ratios[r])
    return b[0], float(b0[0]), float(alphas[i]), float(ratios[r]), float(err / len(pairs))


def t_two_sided(t: np.ndarray, dof: float) -> np.ndarray:
    """Two-sided p-value of Student's t: tail integral of ``cos^(dof-1)`` by quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(96)
    low = np.arctan(np.abs(np.asarray(t, dtype=float)) / math.sqrt(dof))
    half = (math.pi / 2 - low) / 2
    theta = low[:, None] + half[:, None] * (nodes[None, :] + 1)
    log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(math.pi)
    integral = (weights * np.cos(theta) ** (dof - 1)).sum(axis=1) * half
    return np.clip(2 * math.exp(log_c) * integral, 0.0, 1.0)
