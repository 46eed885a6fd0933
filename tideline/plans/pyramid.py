"""Kernel snapshots at geometric distances, and the kernels of any recent span by subtraction.

A snapshot is taken after every period. Its order is the number of times that its period's
number is divisible by ``base``; of each order the last ``base ** depth + 1`` are kept. So
for any span there is a snapshot from before it that is at most a factor of
``1 + 1 / base ** (depth - 1)`` too old, and a history of T periods keeps a number of
snapshots that grows with the logarithm of T.

Kernels merge and give way to others later. Each snapshot therefore holds, for each of its
kernels, the slot that its rows are in now, or -1 where they are gone. That is what can be
subtracted from the kernels of now; lists of merged kernels, which would grow without
bound, are not needed.
"""

from __future__ import annotations

import numpy as np


def order_of(time: int, base: int) -> int:
    order = 0
    while time % base == 0:
        time //= base
        order += 1
    return order


class Pyramid:
    """Snapshots (time, kernels, slot of each kernel's rows now), oldest first."""

    def __init__(self, base: int = 2, depth: int = 2):
        if base < 2 or depth < 1:
            raise ValueError("base must be at least 2 and depth at least 1")
        self.base, self.kept = base, base**depth + 1
        self.shots: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flat(self) -> np.ndarray:
        """The snapshots as doubles, from which ``restore`` gets them back."""
        parts = [[len(self.shots)]]
        for time, kernels, into in self.shots:
            parts += [[time, len(kernels)], kernels.ravel(), into]
        return np.concatenate(parts).astype(float)

    def restore(self, flat: np.ndarray, width: int) -> None:
        at, self.shots = 1, []
        for _ in range(int(flat[0])):
            time, count = (int(v) for v in flat[at : at + 2])
            mid = at + 2 + count * width
            kernels, into = flat[at + 2 : mid].reshape(count, width), flat[mid : mid + count]
            self.shots.append((time, kernels.copy(), into.astype(np.int64)))
            at = mid + count

    def moved(self, slot: int, to: int) -> None:
        """The rows of a kernel went to another one, or were dropped (-1)."""
        for _, _, into in self.shots:
            into[into == slot] = to

    def take(self, time: int, kernels: np.ndarray) -> None:
        """Keep the kernels after period number ``time`` (1, 2 ...)."""
        self.shots.append((time, kernels.copy(), np.arange(len(kernels))))
        order = order_of(time, self.base)
        same = [i for i, s in enumerate(self.shots) if order_of(s[0], self.base) == order]
        if len(same) > self.kept:
            del self.shots[same[0]]

    def since(self, time: int):
        """The latest snapshot taken at ``time`` or before, if any is left."""
        return next((s for s in reversed(self.shots) if s[0] <= time), None)

    @staticmethod
    def after(kernels: np.ndarray, shot) -> np.ndarray:
        """What the kernels hold of the rows that came after the snapshot."""
        if shot is None:
            return kernels
        _, then, into = shot
        out, here = kernels.copy(), into >= 0
        np.subtract.at(out, into[here], then[here])
        # Counts are whole numbers; sums of a kernel without new rows are rounding errors.
        return out[out[:, 0] > 0.5]
