"""Plain re-computations that the operators are checked against."""

import math

import numpy as np


def windows_of(n, size, shift):
    return [range(k * shift, k * shift + size) for k in range((n - size) // shift + 1)] if n >= size else []


def sgd(x, y, w, steps, rate, tol=0.001, drawn=None):
    """Gradient steps on the rows themselves; returns weights and steps taken."""
    previous = None
    taken = 0
    for i in range(1, steps + 1):
        taken = i
        xs, ys = (x, y) if drawn is None else (x[drawn[i - 1]], y[drawn[i - 1]])
        if len(ys) == 0:
            continue
        grad = ((xs @ w - ys)[:, None] * xs).sum(axis=0) / len(ys)
        new = w - rate / math.sqrt(i) * grad
        if previous is not None and np.linalg.norm(new - w) < tol * max(np.linalg.norm(new), 1.0):
            return new, taken
        previous, w = w, new
    return w, taken


def linreg(rows, size, shift, steps, rate, tol=0.001):
    """Per window: error and weights, from rows (y, x…) in order."""
    data = np.asarray(rows, dtype=float)
    w = np.zeros(data.shape[1] - 1)
    out = []
    for window in windows_of(len(data), size, shift):
        part = data[window.start : window.stop]
        y, x = part[:, 0], part[:, 1:]
        w, taken = sgd(x, y, w, steps, rate, tol)
        out.append((float(((x @ w - y) ** 2).mean()), w, taken))
    return out


def kmeans(points, k, steps):
    """Lloyd from the first k different points."""
    points = np.asarray(points, dtype=float)
    centers = []
    for p in points:
        if len(centers) < k and not any((p == c).all() for c in centers):
            centers.append(p)
    centers = np.array(centers)
    for _ in range(steps):
        near = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array(
            [points[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centers)]
        )
    cost = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()
    return centers, float(cost)
