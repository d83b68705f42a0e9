"""Eigenpairs of a symmetric matrix inside an interval by FEAST contour integration.

The spectral projector of an interval is the integral of the resolvent over a circle through its ends. Quadrature needs a complex shifted solve at
each node; the projected block goes through Rayleigh-Ritz and around again until the residuals vanish. How many eigenvalues an interval
has is known from inertia: the signs of the pivots of the shifted, tridiagonalised matrix (Sylvester's law).
"""

from __future__ import annotations

import numpy as np

NODES, ROUNDS = 8, 40
#: Residual, relative to the norm of the matrix, at which a pair is converged; intervals are split until they hold so many eigenvalues.
CONVERGED, PER_INTERVAL = 5e-14, 8
SEED = 13


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix (Householder reflections)."""
    a = np.array(v, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        b = a[k + 1 :, k + 1 :]
        p = b @ x
        w = p - (x @ p) * x
        b -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """Counts of eigenvalues below shifts."""

    def __init__(self, v: np.ndarray):
        self.d, e = tridiagonal(v)
        self.e2 = e * e
        reach = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
        self.low, self.high = float((self.d - reach).min()), float((self.d + reach).max())
        self.scale = max(abs(self.low), abs(self.high))

    def below(self, shifts: np.ndarray) -> np.ndarray:
        shifts = np.asarray(shifts, float)
        tiny = np.finfo(float).tiny / np.finfo(float).eps
        q = self.d[0] - shifts
        n = (q < 0).astype(int)
        for i in range(1, len(self.d)):
            q = np.where(np.abs(q) < tiny, -tiny, q)
            q = self.d[i] - shifts - self.e2[i - 1] / q
            n += q < 0
        return n


def clear_cut(inertia: Inertia, a: float, b: float) -> float | None:
    """A point between a and b with no eigenvalue near it, as far from the next ones as can be found; None inside a cluster."""
    points = a + (b - a) * (0.2 + 0.6 * (np.arange(31) + 0.5) / 31)
    points = points[np.argsort(np.abs(points - (a + b) / 2), kind="stable")]
    for room in (1e-2, 1e-3, 1e-4, 1e-5):
        gap = room * (b - a)
        if gap < 1e-9 * inertia.scale:
            break
        free = np.flatnonzero(inertia.below(points - gap) == inertia.below(points + gap))
        if len(free):
            return float(points[free[0]])
    return None


def intervals(v: np.ndarray, wanted: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that hold the ``wanted`` largest eigenvalues of ``v`` and perhaps a few more, highest first."""
    inertia, n = Inertia(v), len(v)
    if inertia.scale == 0:
        return []
    pad = 0.01 * inertia.scale
    todo, done = [(inertia.low - pad, inertia.high + pad, 0, n)], []  # low, high, eigenvalues below low, below high
    while todo:
        a, b, below_a, below_b = todo.pop()
        if below_a == below_b or n - below_b >= wanted:
            continue
        cut = clear_cut(inertia, a, b) if below_b - below_a > per_interval or n - below_a > wanted else None
        if cut is None:
            done.append((a, b, below_b - below_a))
        else:
            mid = int(inertia.below(np.array([cut]))[0])
            todo += [(a, cut, below_a, mid), (cut, b, mid, below_b)]
    return sorted(done, reverse=True)


def eigenpairs(v: np.ndarray, a: float, b: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of ``v`` in [a, b), ascending, and unit eigenvectors as columns; an error if one is missed."""
    n = len(v)
    norm = np.linalg.norm(v, 2)
    t, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + t))
    centre, radius = (a + b) / 2, (b - a) / 2
    size = min(n, 2 * count + 8)
    while True:
        y = np.random.default_rng([SEED, n, size]).standard_normal((n, size))
        for _ in range(ROUNDS):
            q = sum(0.5 * w[j] * (radius * turn[j] * np.linalg.solve((centre + radius * turn[j]) * np.eye(n) - v, y.astype(complex))).real for j in range(NODES))
            q, _ = np.linalg.qr(q)
            ritz, u = np.linalg.eigh(q.T @ v @ q)
            y = q @ u
            inside = (ritz >= a) & (ritz < b)
            residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * ritz[inside], axis=0)
            good = residual <= CONVERGED * n * norm
            if good.sum() == count and inside.sum() == count:
                return ritz[inside], y[:, inside]
        if size == n:
            raise ArithmeticError(f"{int(good.sum())} of {count} eigenvalues found between {a} and {b}")
        size = min(n, 2 * size)
