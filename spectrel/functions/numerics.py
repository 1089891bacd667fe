"""Numeric kernels on numpy arrays: non-negative least squares, least-squares splines, running averages."""

from __future__ import annotations

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson-Hanson: x >= 0 with the least |a x - b|."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gain = a.T @ (b - a @ x)
    limit = 10 * np.finfo(float).eps * max(1.0, np.abs(a).sum()) * n
    for _ in range(3 * n + 10):
        if free.all() or gain[~free].max(initial=-np.inf) <= limit:
            break
        free[np.argmax(np.where(free, -np.inf, gain))] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            below = free & (s <= 0)
            if not below.any():
                break
            step = np.min(x[below] / (x[below] - s[below]))
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
        x = s
        gain = a.T @ (b - a @ x)
    return x


def nnls_rows(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``nnls`` for each row of ``rows``: where the plain least-squares solution isn't negative anywhere, it is that."""
    if not len(rows):
        return np.zeros((0, a.shape[1]))
    found, _, rank, _ = np.linalg.lstsq(a, rows.T, rcond=None)
    found = found.T.copy()
    for i in np.flatnonzero((found < 0).any(axis=1)) if rank == a.shape[1] else range(len(rows)):
        found[i] = nnls(a, rows[i])
    return found


def running_mean(values: np.ndarray, m: int) -> np.ndarray:
    """Means of all m consecutive values."""
    total = np.concatenate(([0.0], np.cumsum(np.asarray(values, float))))
    return (total[m:] - total[:-m]) / m


def running_median(values: np.ndarray, m: int) -> np.ndarray:
    values = np.asarray(values, float)
    return np.median(np.lib.stride_tricks.sliding_window_view(values, m), axis=1) if len(values) >= m else np.zeros(0)


def averaged(values: np.ndarray, window: int | None = None, kind: str | None = "median") -> np.ndarray:
    window = window or max(100, len(values) // 50)
    return values if kind is None else running_median(values, window) if kind == "median" else running_mean(values, window)


class Spline:
    """Least-squares spline of a given degree with the given inner knots; linear systems on B-splines."""

    def __init__(self, x: np.ndarray, y: np.ndarray, knots: np.ndarray, degree: int = 2):
        self.degree = degree
        self.low, self.high = float(x[0]), float(x[-1])
        inner = np.unique([k for k in knots if self.low < k < self.high])
        # each knot needs data on both sides of it, else the system has no single solution
        counts = np.diff(np.searchsorted(x, np.concatenate(([self.low], inner, [self.high + 1e-9]))))
        inner = inner[(counts[:-1] > degree) & (counts[1:] > 0)] if len(inner) else inner
        self.t = np.concatenate((np.full(degree + 1, self.low), inner, np.full(degree + 1, self.high)))
        self.c = np.linalg.lstsq(self._basis(x), y, rcond=None)[0]

    def _basis(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(np.asarray(x, float), self.low, self.high)
        t, d = self.t, self.degree
        at = np.clip(np.searchsorted(t, x, side="right") - 1, d, len(t) - d - 2)
        b = np.zeros((len(x), len(t) - 1))
        b[np.arange(len(x)), at] = 1
        for k in range(1, d + 1):
            left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
            one = np.divide(x[:, None] - t[: -k - 1], left, out=np.zeros((len(x), len(left))), where=left > 0)
            two = np.divide(t[k + 1 :] - x[:, None], right, out=np.zeros((len(x), len(right))), where=right > 0)
            b = one * b[:, : len(left)] + two * b[:, 1 : len(right) + 1]
        return b

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._basis(np.asarray(x, float)) @ self.c


def local_basis(knots: np.ndarray, degree: int, piece: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The degree + 1 B-splines that aren't zero on the piece from knots[piece] to the next knot, at x: one row for each x."""
    b = np.ones((len(x), 1))
    for k in range(1, degree + 1):
        # knots around the piece that the functions of degree k begin and end at
        low = knots[piece[:, None] + np.arange(1 - k, 1)]
        high = knots[piece[:, None] + np.arange(1, k + 1)]
        part = b / (high - low)
        b = np.zeros((len(x), k + 1))
        b[:, :-1] += part * (high - x[:, None])
        b[:, 1:] += part * (x[:, None] - low)
    return b


def banded_solve(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of A x = right for a symmetric positive definite A, where bands[i, k] is A[i, i + k]."""
    a, x = bands.copy(), right.copy()
    n, w = a.shape
    for i in range(n):
        for k in range(1, min(w, n - i)):
            f = a[i, k] / a[i, 0]
            a[i + k, : w - k] -= f * a[i, k:]
            x[i + k] -= f * x[i]
    for i in reversed(range(n)):
        m = min(w, n - i)
        x[i] = (x[i] - a[i, 1:m] @ x[i + 1 : i + m]) / a[i, 0]
    return x


def cell_polynomials(cells: np.ndarray, moments: np.ndarray, rights: np.ndarray, n: int, least: int) -> np.ndarray:
    """The least-squares spline of points that are known by sums of powers: n x (degree + 1) coefficients, one polynomial a cell.

    Of each of ``cells`` (from 0 to n - 1, others are empty) there are the sums of u**k and of y * u**k, where u is a point's
    place in its cell, from 0 to 1. Knots are borders of cells with at least ``least`` points between two of them, taken
    from the left. What the points leave open is settled by the coefficients' being like their neighbours.
    """
    degree = rights.shape[1] - 1
    full = np.zeros((n, moments.shape[1]))
    right = np.zeros((n, degree + 1))
    full[cells], right[cells] = moments, rights
    seen = np.concatenate(([0.0], np.cumsum(full[:, 0])))
    inner = [0]
    while True:
        knot = int(np.searchsorted(seen, seen[inner[-1]] + least - 0.5))
        if knot >= n or seen[-1] - seen[knot] < least - 0.5:
            break
        inner.append(knot)
    knots = np.concatenate((np.zeros(degree), inner, np.full(degree + 1, n))).astype(float)
    every = np.arange(n)
    piece = np.searchsorted(knots, every, side="right") - 1
    # each function is a polynomial of u in a cell: known at degree + 1 places, it is known
    places = np.linspace(0, 1, degree + 1)
    values = np.stack([local_basis(knots, degree, piece, every + u) for u in places], axis=2)
    shapes = values @ np.linalg.inv(np.vander(places, increasing=True)).T
    hankel = full[:, np.arange(degree + 1)[:, None] + np.arange(degree + 1)]
    gram = shapes @ hankel @ shapes.transpose(0, 2, 1)
    load = (shapes @ right[:, :, None])[:, :, 0]
    first = piece - degree
    size = len(knots) - degree - 1
    bands, side = np.zeros((size, degree + 1)), np.zeros(size)
    for i in range(degree + 1):
        np.add.at(side, first + i, load[:, i])
        for k in range(degree + 1 - i):
            np.add.at(bands, (first + i, k), gram[:, i, i + k])
    alike = 1e-9 * max(bands[:, 0].mean(), 1e-300)
    bands[:-1, 0] += alike
    bands[1:, 0] += alike
    bands[:-1, 1] -= alike
    c = banded_solve(bands, side)
    return (c[first[:, None] + np.arange(degree + 1)][:, None, :] @ shapes)[:, 0]


class DeviationModel:
    """A deviation as a smooth function of a position: the mean of splines on random subsets of averaged points."""

    def __init__(self, deviation, position, average: str | None = None, window: int | None = None, cycles: int = 10, share: float = 0.4, least: int = 10, knots: int = 200, degree: int = 2, expansion: float = 0.1, seed: int = 1):
        y, x = np.asarray(deviation, float), np.asarray(position, float)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        if average:
            window = window or max(100, len(x) // 50)
            smooth = averaged(y, window, average)
            # the average of a window belongs to its middle; the lower side loses one point more where the window is even
            skip = window - 1 - (window - 1) // 2
            x, y = x[skip : skip + len(smooth)], smooth
        if len(x) == 0:
            raise ValueError("no data to fit")
        reach = (x[-1] - x[0]) * expansion
        steps = np.arange(100)
        x = np.concatenate((x[0] - reach / 100 * (101 - steps), x, x[-1] + reach / 100 * steps))
        y = np.concatenate((np.full(100, y[0]), y, np.full(100, y[-1])))
        rng = np.random.default_rng(seed)
        self.splines = []
        for _ in range(cycles):
            some = np.sort(rng.choice(len(x), int(len(x) * share), replace=False))
            xs, ys = x[some], y[some]
            low, high = xs[min(least, len(xs) - 1)], xs[-min(least, len(xs))]
            grid = low + (high - low) / max(knots, 1) * np.arange(1, max(knots, 2))
            kept = [grid[0]]
            for knot in grid[1:]:
                if np.searchsorted(xs, knot, side="right") - np.searchsorted(xs, kept[-1], side="left") >= least:
                    kept.append(knot)
            self.splines.append(Spline(xs, ys, np.array(kept), degree))

    def __call__(self, x) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, float))
        return np.mean([np.nan_to_num(s(x)) for s in self.splines], axis=0)
