"""Micro-clusters: additive summaries of nearby rows.

A kernel is one row of a matrix: [n, sum t, sum t², sums of x…, sums of x²…],
with t the arrival index. Adding two kernels summarises their union.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from tideline.plans.lloyd import assign, assign_by_products, first_distinct, lloyd

# Passes that settle the kernels of one block of rows.
_BLOCK_STEPS = 3


def width(dims: int) -> int:
    return 2 * dims + 3


def summarise_block(points: np.ndarray, times: np.ndarray, limit: int) -> np.ndarray:
    """At most ``limit`` kernels of one block, ordered by mean arrival."""
    # Starting points are spread over the block, so drift within it is covered.
    spread = np.argsort(np.arange(len(points)) % max(1, len(points) // limit), kind="stable")
    centers = first_distinct(points, spread, limit)
    centers = lloyd(points, centers, _BLOCK_STEPS, 0.0, nearest=assign_by_products)
    cid, _ = assign_by_products(points, centers)
    base = times.min()
    shifted = times - base
    k = len(centers)
    columns = [np.ones(len(points)), shifted, shifted**2]
    columns += [*points.T, *(points**2).T]
    kernels = np.stack([np.bincount(cid, c, minlength=k) for c in columns], axis=1)
    kernels = kernels[kernels[:, 0] > 0]
    # Times were summed from the start of the block, where the squares are small.
    n, t, tt = kernels[:, 0].copy(), kernels[:, 1].copy(), kernels[:, 2].copy()
    kernels[:, 1] = t + n * base
    kernels[:, 2] = tt + 2 * base * t + n * base * base
    return kernels[np.argsort(kernels[:, 1] / kernels[:, 0], kind="stable")]


class Kernels:
    """A bounded set of kernels that absorbs others, oldest first."""

    def __init__(
        self, rows: np.ndarray, limit: int, factor: float, horizon: int, dims: int, moved=None
    ):
        # Told of slots whose rows go to another slot, or are dropped (-1).
        self.moved = moved or (lambda slot, to: None)
        self.limit, self.factor, self.horizon, self.dims = limit, factor, horizon, dims
        self.count = len(rows)
        self.rows = np.zeros((limit, width(dims)))
        self.rows[: self.count] = rows
        self.centers = np.zeros((limit, dims))
        self.gaps = np.full((limit, limit), np.inf)
        self._measure_all()

    def used(self) -> np.ndarray:
        return self.rows[: self.count]

    def _measure_all(self) -> None:
        """Refresh all centres and distances."""
        c = self.count
        if c == 0:
            return
        centers = self.rows[:c, 3 : 3 + self.dims] / self.rows[:c, :1]
        self.centers[:c] = centers
        dist = np.zeros((c, c))
        for j in range(self.dims):
            dist += np.subtract.outer(centers[:, j], centers[:, j]) ** 2
        np.fill_diagonal(dist, np.inf)
        self.gaps[:c, :c] = dist

    def _measure(self, i: int) -> None:
        """Refresh the distances from kernel ``i`` to all others."""
        diff = self.centers[: self.count] - self.centers[i]
        dist = np.einsum("ij,ij->i", diff, diff)
        dist[i] = np.inf
        self.gaps[i, : self.count] = dist
        self.gaps[: self.count, i] = dist

    def _place(self, i: int, row: np.ndarray) -> None:
        self.rows[i] = row
        self.centers[i] = row[3 : 3 + self.dims] / row[0]
        self._measure(i)

    def _reach(self, i: int) -> float:
        """Squared distance within which kernel ``i`` absorbs."""
        row = self.rows[i]
        if row[0] < 2:
            return self.gaps[i, : self.count].min() if self.count > 1 else 0.0
        spread = row[3 + self.dims :] / row[0] - self.centers[i] ** 2
        return self.factor**2 * max(0.0, spread.sum())

    def _reaches(self) -> np.ndarray:
        """``_reach`` of every kernel."""
        rows = self.used()
        spread = (rows[:, 3 + self.dims :] / rows[:, :1]).sum(axis=1)
        spread -= (self.centers[: self.count] ** 2).sum(axis=1)
        nearest = self.gaps[: self.count, : self.count].min(axis=1)
        single = nearest if self.count > 1 else np.zeros(1)
        return np.where(rows[:, 0] < 2, single, self.factor**2 * np.maximum(spread, 0.0))

    def take(self, rows: np.ndarray) -> None:
        """Absorb what lies within reach of a kernel at once; insert the rest in order."""
        if self.count and len(rows):
            cid, dist = assign_by_products(rows[:, 3 : 3 + self.dims] / rows[:, :1],
                                           self.centers[: self.count])
            inside = dist <= self._reaches()[cid]
            np.add.at(self.rows, cid[inside], rows[inside])
            self._measure_all()
            rows = rows[~inside]
        for row in rows:
            self.insert(row)

    def _stalest(self, now: float) -> int | None:
        """The kernel whose recent rows are oldest, if all left the horizon."""
        rows = self.used()
        mean = rows[:, 1] / rows[:, 0]
        i = int(mean.argmin())
        n = rows[i, 0]
        stamp = mean[i]
        if n >= 2 * self.limit:
            # Arrival time of the last `limit` rows, taking times as normal.
            deviation = math.sqrt(max(0.0, rows[i, 2] / n - stamp * stamp))
            stamp += deviation * NormalDist().inv_cdf(1 - self.limit / (2 * n))
        return i if stamp < now - self.horizon else None

    def insert(self, row: np.ndarray) -> None:
        center = row[3 : 3 + self.dims] / row[0]
        if self.count:
            diff = self.centers[: self.count] - center
            dist = np.einsum("ij,ij->i", diff, diff)
            i = int(dist.argmin())
            if dist[i] <= self._reach(i):
                self._place(i, self.rows[i] + row)
                return
        if self.count < self.limit:
            self.count += 1
            self._place(self.count - 1, row)
            return
        free = self._stalest(row[1] / row[0])
        if free is None:
            if self.limit == 1:
                self._place(0, self.rows[0] + row)
                return
            flat = int(self.gaps.argmin())
            keep, free = divmod(flat, self.limit)
            merged = self.rows[keep] + self.rows[free]
            self.moved(free, keep)
            self._place(free, row)
            self._place(keep, merged)
            return
        self.moved(free, -1)
        self._place(free, row)


# Up to so many coordinates of kernels, plain numbers cost less than array calls.
FEW = 16


class FewKernels:
    """``Kernels`` that takes rows one at a time, for a limit of a few."""

    def __init__(self, rows: np.ndarray, limit: int, factor: float, horizon: int, dims: int):
        self.limit, self.reach, self.horizon, self.dims = limit, factor**2, horizon, dims
        self.rows: list[list[float]] = rows.tolist()
        self.centers = [self._center(row) for row in self.rows]

    def flat(self) -> list[float]:
        return [v for row in self.rows for v in row]

    def _center(self, row: list[float]) -> list[float]:
        n = row[0]
        return [v / n for v in row[3 : 3 + self.dims]]

    def _gap(self, a: list[float], b: list[float]) -> float:
        gap = 0.0
        for u, v in zip(a, b):
            gap += (u - v) * (u - v)
        return gap

    def _place(self, i: int, row: list[float]) -> None:
        self.rows[i] = row
        self.centers[i] = self._center(row)

    def _reach(self, i: int) -> float:
        row, center = self.rows[i], self.centers[i]
        if row[0] < 2:
            return min((self._gap(center, c) for j, c in enumerate(self.centers) if j != i), default=0.0)
        spread, n = 0.0, row[0]
        for c, ss in zip(center, row[3 + self.dims :]):
            spread += ss / n - c * c
        return self.reach * max(0.0, spread)

    def _stalest(self, now: float) -> int | None:
        means = [row[1] / row[0] for row in self.rows]
        stamp = min(means)
        i, edge = means.index(stamp), now - self.horizon
        if stamp >= edge:
            return None
        row = self.rows[i]
        n = row[0]
        if n >= 2 * self.limit:
            deviation = math.sqrt(max(0.0, row[2] / n - stamp * stamp))
            stamp += deviation * NormalDist().inv_cdf(1 - self.limit / (2 * n))
        return i if stamp < edge else None

    def insert(self, row: list[float]) -> None:
        center, count = self._center(row), len(self.rows)
        if count:
            gaps = [self._gap(c, center) for c in self.centers]
            gap = min(gaps)
            i = gaps.index(gap)
            if gap <= self._reach(i):
                self._place(i, [a + b for a, b in zip(self.rows[i], row)])
                return
        if count < self.limit:
            self.rows.append(row)
            self.centers.append(center)
            return
        free = self._stalest(row[1] / row[0])
        if free is None:
            if count == 1:
                self._place(0, [a + b for a, b in zip(self.rows[0], row)])
                return
            _, keep, free = min(
                (self._gap(self.centers[i], self.centers[j]), i, j)
                for i in range(count) for j in range(i + 1, count)
            )
            self._place(keep, [a + b for a, b in zip(self.rows[keep], self.rows[free])])
        self._place(free, row)


def merge(earlier, later, limit: int, factor: float, horizon: int, dims: int) -> np.ndarray:
    """Kernels of a span of rows followed by another; flat in, flat out."""
    held = Kernels(earlier.reshape(-1, width(dims)), limit, factor, horizon, dims)
    held.take(later.reshape(-1, width(dims)))
    return held.used().ravel().copy()


def reduce_kernels(earlier, later, limit: int, dims: int) -> np.ndarray:
    """At most ``limit`` kernels of the rows of two sets of kernels; flat in, flat out.

    Unlike ``merge`` it does not depend on which rows came first, so sets can be combined
    as a tree. The heaviest kernels of both are moved to the means of what is nearest to
    them, and all kernels join these; sums are kept exactly.
    """
    both = np.concatenate([earlier, later]).reshape(-1, width(dims))
    if len(both) <= limit:
        return both.ravel()
    points, weights = both[:, 3 : 3 + dims] / both[:, :1], both[:, 0]
    heaviest = np.lexsort((both[:, 1] / weights, -weights))
    centers = first_distinct(points, heaviest, limit)
    centers = lloyd(points, centers, _BLOCK_STEPS, 0.0, weights, nearest=assign_by_products)
    cid, _ = assign_by_products(points, centers)
    out = np.zeros((len(centers), both.shape[1]))
    np.add.at(out, cid, both)
    out = out[out[:, 0] > 0]
    return out[np.argsort(out[:, 1] / out[:, 0], kind="stable")].ravel()


def macro_centers(kernels: np.ndarray, dims: int, k: int, steps: int, weighted: bool, seed):
    """``k`` centres over the kernels, and the squared error of their rows."""
    points = kernels[:, 3 : 3 + dims] / kernels[:, :1]
    rng = np.random.default_rng(seed)
    chosen = rng.permutation(len(points))[:k]
    weights = kernels[:, 0] if weighted else None
    centers = lloyd(points, points[chosen], steps, 0.0, weights)
    cid, dist = assign(points, centers)
    within = kernels[:, 3 + dims :].sum(axis=1) - kernels[:, 0] * (points**2).sum(axis=1)
    ssq = float(np.maximum(within, 0.0).sum() + (kernels[:, 0] * dist).sum())
    return centers, ssq


def macro_centers_of(batches, dims: int, k: int, steps: int, weighted: bool, seed: int, windows):
    """``macro_centers`` of many sets of kernels, flat; those of at most ``k`` kernels at once.

    Where each kernel is nearest to its own centre, it is a cluster by itself.
    """
    found, wide = [None] * len(batches), width(dims)
    counts = np.array([len(b) // wide for b in batches])
    for m in range(1, min(k, int(counts.max(initial=0))) + 1):
        at = np.flatnonzero(counts == m)
        if not len(at):
            continue
        rows = np.stack([batches[i] for i in at]).reshape(-1, m, wide)
        n = rows[:, :, 0]
        points = rows[:, :, 3 : 3 + dims] / n[:, :, None]
        centers = points
        if weighted and steps > 0:
            centers = points * n[:, :, None] / np.maximum(n, 1e-300)[:, :, None]

        def alone(to):
            gaps = ((points[:, :, None, :] - to[:, None, :, :]) ** 2).sum(axis=3)
            own = gaps[:, range(m), range(m)].copy()
            gaps[:, range(m), range(m)] = np.inf
            return (own < gaps.min(axis=2)).all(axis=1), own

        apart, dist = alone(centers)
        apart &= alone(points)[0]
        within = rows[:, :, 3 + dims :].sum(axis=2) - n * (points**2).sum(axis=2)
        errors = np.maximum(within, 0.0).sum(axis=1) + (n * dist).sum(axis=1)
        for j in np.flatnonzero(apart).tolist():
            i = int(at[j])
            order = np.random.default_rng([seed, windows[i]]).permutation(m) if m > 1 else [0]
            found[i] = centers[j][order], float(errors[j])
    for i in np.flatnonzero(counts == 0).tolist():
        found[i] = [], 0.0
    return [
        f or macro_centers(b.reshape(-1, wide), dims, k, steps, weighted, [seed, w])
        for f, b, w in zip(found, batches, windows)
    ]
