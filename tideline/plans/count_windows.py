"""Count windows over the arrival index, and sums per window."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.arrival import RN

WINDOW_ID = "window_id"
PANE = "_tl_pane"


def int_div(a: Column, b: int) -> Column:
    """Integer quotient, rounded towards zero."""
    return F.call_function("div", a, F.lit(b))


@dataclass(frozen=True)
class CountWindows:
    """Window k holds rows k*shift to k*shift + size - 1 of its key.

    A pane is the longest run of rows that no window boundary cuts.
    """

    size: int
    shift: int

    @property
    def pane(self) -> int:
        return math.gcd(self.size, self.shift)

    @property
    def span(self) -> int:
        """Panes in a window."""
        return self.size // self.pane

    @property
    def stride(self) -> int:
        """Panes between the starts of two windows."""
        return self.shift // self.pane

    @property
    def tumbling(self) -> bool:
        return self.size == self.shift

    def count(self, rows: int) -> int:
        """Windows that ``rows`` rows complete."""
        return 0 if rows < self.size else (rows - self.size) // self.shift + 1

    def pane_of(self, rn: Column) -> Column:
        return int_div(rn, self.pane)

    def closes(self, rn: Column) -> Column:
        """True on the row that completes a window."""
        over = rn - F.lit(self.size - 1)
        return (over >= 0) & (over % F.lit(self.shift) == 0)

    def closed_by(self, rn: Column) -> Column:
        """Id of the window completed by a row for which ``closes`` holds."""
        return int_div(rn - F.lit(self.size - 1), self.shift)

    def members(self, rows: DataFrame, rn: str = RN) -> DataFrame:
        """Rows with the id of each window they belong to, one copy per window."""
        if self.tumbling:
            return rows.withColumn(WINDOW_ID, int_div(F.col(rn), self.size))
        first = F.greatest(
            F.lit(0).cast("long"),
            int_div(F.col(rn) - F.lit(self.size - self.shift), self.shift),
        )
        last = int_div(F.col(rn), self.shift)
        # Rows between two windows do not occur: the shift is at most the size.
        return rows.withColumn(WINDOW_ID, F.explode(F.sequence(first, last)))


def window_sums(
    panes: DataFrame, keys: Sequence[str], values: Sequence[str], windows: CountWindows
) -> DataFrame:
    """Sums per (keys, window) from sums per (keys, pane).

    Panes are cut into blocks of one window's length. A window is a block, or
    the tail of one block plus the head of the next; heads and tails are running
    sums inside a block. So every pane costs a constant amount of work whatever
    the overlap, no group is longer than a window, and sums are only ever added
    (subtracting prefix sums would lose digits). Incomplete windows at the end
    are returned too; the caller drops them by their row count.
    """
    names = [f"`{k}`" for k in keys]
    if windows.tumbling:
        return panes.select(*names, F.col(PANE).alias(WINDOW_ID), *values)
    m, stride = windows.span, windows.stride
    block = Window.partitionBy(*names, int_div(F.col(PANE), m))
    ahead = block.orderBy(PANE).rowsBetween(Window.unboundedPreceding, 0)
    behind = block.orderBy(F.desc(PANE)).rowsBetween(Window.unboundedPreceding, 0)
    running = panes.select(
        *names,
        PANE,
        *[F.sum(v).over(ahead).alias(f"_tl_h{i}") for i, v in enumerate(values)],
        *[F.sum(v).over(behind).alias(f"_tl_t{i}") for i, v in enumerate(values)],
    )
    start = F.col(PANE) - F.lit(m - 1)
    head = F.when(
        (start >= 0) & (start % F.lit(stride) == 0),
        F.struct(
            int_div(start, stride).alias(WINDOW_ID),
            *[F.col(f"_tl_h{i}").alias(v) for i, v in enumerate(values)],
        ),
    )
    tail = F.when(
        (F.col(PANE) % F.lit(stride) == 0) & (F.col(PANE) % F.lit(m) != 0),
        F.struct(
            int_div(F.col(PANE), stride).alias(WINDOW_ID),
            *[F.col(f"_tl_t{i}").alias(v) for i, v in enumerate(values)],
        ),
    )
    parts = F.filter(F.array(head, tail), lambda s: s.isNotNull())
    return (
        running.select(*names, F.inline(parts))
        .groupBy(*names, WINDOW_ID)
        .agg(*[F.sum(v).alias(v) for v in values])
    )
