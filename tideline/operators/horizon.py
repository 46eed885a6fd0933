"""Clusters of the last rows of a feed or table, for any number of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import MicroClusterOptions
from tideline.operators.microcluster import _blocks, limit_rows, period_doubles, with_centers
from tideline.plans.arrival import RN, as_names
from tideline.plans.gram import feature
from tideline.plans.kernels import Kernels, width
from tideline.plans.pyramid import Pyramid
from tideline.plans.rows import as_columns, index_rows, typed
from tideline.plans.walk import walk_blocks


def horizon_clusters(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    rows: int,
    partition_by: str | Sequence[str] | None = None,
    options: MicroClusterOptions = MicroClusterOptions(),
    on_null: str = "error",
    base: int = 2,
    depth: int = 2,
) -> DataFrame:
    """Micro-clusters of the last ``rows`` rows after every period, and centres over them.

    Columns: keys, window_id, since, n, ssq, centers, kernels. ``since`` is the index of the
    first row that counts: the kernels are those of now less a snapshot from before the last
    ``rows`` rows, the latest that a pyramid of snapshots still has, or from the start. With
    ``rows`` a multiple of the period and at most ``base ** depth`` periods, ``since`` is
    exact. Rows of kernels that gave way to others (see ``horizon`` of the options) are in
    neither. Blocks of rows are summarised in parallel; one walk per key over the summaries
    holds the kernels and some snapshots, whose number grows with the logarithm of the periods.
    A long walk is cut into parts, and the centres are found after it, in parallel.
    """
    if rows < 1:
        raise ValueError("rows must be at least 1")
    Pyramid(base, depth)
    keys, given = as_names(partition_by), as_columns(features)
    dims, size = len(given), options.batch_size
    arrived = index_rows(df, given, order_by, partition_by, on_null)
    numeric = limit_rows(arrived.rows, options.instance_limit).select(
        *[F.col(f"`{k}`") for k in keys],
        RN,
        *[v.alias(feature(i)) for i, v in enumerate(typed(given, on_null))],
    )
    blocks = _blocks(numeric, keys, dims, options, arrived.total)
    back = -(-rows // size)
    periods = min(arrived.longest, arrived.total) // size + 2
    walked = walk_blocks(
        blocks, keys, size, lambda state: _Recent(state, options, dims, base, depth, back), ["since"],
        periods, period_doubles(options, dims), arrived.total // size + 2,
    )
    return with_centers(walked, keys, dims, options, ["since"])


class _Recent:
    """Kernels of a key as its blocks come, and snapshots of them."""

    def __init__(self, state, options: MicroClusterOptions, dims: int, base: int, depth: int, back: int):
        self.wide, self.back, self.size = width(dims), back, options.batch_size
        self.pyramid, rows = Pyramid(base, depth), np.empty((0, self.wide))
        if state is not None:
            end = 1 + int(state[0]) * self.wide
            rows = state[1:end].reshape(-1, self.wide)
            self.pyramid.restore(state[end:], self.wide)
        self.held = Kernels(
            rows, options.max_kernels, options.radius_factor, options.horizon, dims, self.pyramid.moved
        )

    def take(self, acc: np.ndarray) -> None:
        self.held.take(acc.reshape(-1, self.wide))

    def state(self) -> np.ndarray:
        held = self.held.used()
        return np.concatenate([[float(len(held))], held.ravel(), self.pyramid.flat()])

    def close(self, window: int):
        shot = self.pyramid.since(window + 1 - self.back)
        kernels = Pyramid.after(self.held.used(), shot)
        self.pyramid.take(window + 1, self.held.used())
        return (0 if shot is None else shot[0] * self.size,), kernels.ravel().copy()
