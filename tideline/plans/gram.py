"""Sufficient statistics of least squares, per window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.plans.arrival import RN
from tideline.plans.count_windows import PANE, WINDOW_ID, CountWindows, window_sums
from tideline.plans.draws import drawn_rows
from tideline.plans.ordered import changes, double_arrays, doubles, out_batch

LABEL = "_tl_y"
STEP = "_tl_it"
# Up to this many features each sum is an aggregate of its own, which fits in
# one generated aggregate; beyond it, tasks build partial matrices.
NARROW = 12


def feature(i: int) -> str:
    return f"_tl_x{i}"


def upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def pane_sums(
    rows: DataFrame, keys: Sequence[str], p: int, dense: bool = True
) -> tuple[DataFrame, list[str], list[str]]:
    """Sums per (keys, step, pane); returns them with group and value names.

    ``rows`` carries keys, pane, step, label and features, and ``_tl_hit``
    (0 or 1), by which a row counts.
    """
    names = [f"`{k}`" for k in keys]
    hit = F.col("_tl_hit")
    if p <= NARROW:
        y = F.col(LABEL)
        xs = [F.col(feature(i)) for i in range(p)]
        sums = {"_tl_n": F.sum(hit), "_tl_yy": F.sum(hit * y * y)}
        sums |= {f"_tl_b{i}": F.sum(hit * xs[i] * y) for i in range(p)}
        sums |= {f"_tl_g{i}_{j}": F.sum(hit * xs[i] * xs[j]) for i, j in upper(p)}
        panes = rows.groupBy(*names, STEP, PANE).agg(*[c.alias(n) for n, c in sums.items()])
        return panes, [*keys, STEP], list(sums)
    vectors = rows.select(
        *names, STEP, PANE,
        F.array(
            hit, hit * F.col(LABEL), *[hit * F.col(feature(i)) for i in range(p)]
        ).alias("_tl_z"),
    )
    panes = (
        _partial_matrices(vectors, keys, p)
        .select(*names, STEP, PANE, F.posexplode("acc").alias("_tl_at", "_tl_v"))
        .groupBy(*names, STEP, "_tl_at", PANE)
        .agg(F.sum("_tl_v").alias("_tl_v"))
    )
    return panes, [*keys, STEP, "_tl_at"], ["_tl_v"]


def _partial_matrices(vectors: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """One cross-product vector per run of equal panes in a batch."""
    groups = [*keys, STEP, PANE]
    schema = T.StructType(
        [vectors.schema[g] for g in groups]
        + [T.StructField("acc", T.ArrayType(T.DoubleType()))]
    )
    arrow = to_arrow_schema(schema)
    left, right = products(p)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = doubles(batch, "_tl_z")
            differs = np.zeros(batch.num_rows, bool)
            differs[0] = True
            for g in groups:
                differs[1:] |= changes(batch.column(g))
            edges = np.flatnonzero(differs).tolist()
            ends = edges[1:] + [batch.num_rows]
            sums = []
            for a, b in zip(edges, ends):
                product = z[a:b].T @ z[a:b]
                sums.append(product[left, right])
            out = {g: batch.column(g).take(edges_array(edges)) for g in groups}
            out["acc"] = double_arrays(sums)
            yield out_batch(out, arrow)

    def edges_array(edges):
        import pyarrow as pa

        return pa.array(edges, type=pa.int64())

    return vectors.mapInArrow(run, schema)


def gram_stats(
    rows: DataFrame,
    keys: Sequence[str],
    p: int,
    windows: CountWindows,
    steps: int,
    fraction: float,
    seed: int,
) -> DataFrame:
    """(keys, window, step, n, yy, b, g) for every complete window.

    The step ``steps + 1`` holds the sums over all rows of the window. With a
    fraction below 1 the steps 1…steps hold those over the rows that a hash of
    (index, step, seed) selects for that step.
    """
    rn = F.col(RN)
    full = steps + 1
    pane = windows.pane_of(rn).alias(PANE)
    names = [f"`{k}`" for k in keys]
    data = [LABEL, *[feature(i) for i in range(p)]]
    if fraction < 1 and steps > 0:
        return _drawn_stats(rows, keys, p, windows, steps, fraction, seed)
    picked = rows.select(
        *names, pane, *data, F.lit(full).alias(STEP), F.lit(1.0).alias("_tl_hit")
    )
    panes, groups, values = pane_sums(picked, keys, p)
    return _packed(window_sums(panes, groups, values, windows), keys, p, full, windows)


def _packed(
    sums: DataFrame, keys: Sequence[str], p: int, full: int, windows: CountWindows
) -> DataFrame:
    """Window sums as (keys, window, step, n, yy, b, g), complete windows only."""
    names = [f"`{k}`" for k in keys]
    if "_tl_at" not in sums.columns:
        stats = sums.select(
            *names, WINDOW_ID, STEP,
            F.col("_tl_n").alias("n"),
            F.col("_tl_yy").alias("yy"),
            F.array(*[f"_tl_b{i}" for i in range(p)]).alias("b"),
            F.array(*[f"_tl_g{i}_{j}" for i, j in upper(p)]).alias("g"),
        )
    else:
        packed = sums.groupBy(*names, WINDOW_ID, STEP).agg(
            F.sort_array(F.collect_list(F.struct("_tl_at", "_tl_v"))).alias("_tl_s")
        )
        flat = F.col("_tl_s")["_tl_v"]
        stats = packed.select(
            *names, WINDOW_ID, STEP,
            flat[0].alias("n"),
            flat[1].alias("yy"),
            F.slice(flat, 3, p).alias("b"),
            F.slice(flat, 3 + p, p * (p + 1) // 2).alias("g"),
        )
    return stats.where((F.col(STEP) < full) | (F.col("n") == windows.size))


def drawn_products(z: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Sums of the products of rows, for each step over the rows it has drawn.

    ``z`` has rows [1, y, x...], ``hits`` is a 0/1 matrix of rows and steps; the result holds
    for each step the kept products, in the order of ``products``.
    """
    left, right = products(z.shape[1] - 2)
    return hits.T.astype(float) @ (z[:, left] * z[:, right])


def products(p: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each kept product in [1, y, x...] times itself: count, squared
    label, label times feature, feature times feature."""
    take = [(0, 0), (1, 1)] + [(1, 2 + i) for i in range(p)]
    take += [(2 + i, 2 + j) for i, j in upper(p)]
    left, right = (np.array(side) for side in zip(*take))
    return left, right


def _drawn_stats(
    rows: DataFrame, keys: Sequence[str], p: int, windows: CountWindows, steps: int,
    fraction: float, seed: int,
) -> DataFrame:
    """Statistics of every step of a mini-batch descent.

    No row is copied for the steps that draw it, and no draw leaves its task, which multiplies,
    for each run of rows of one pane, the matrix of its draws with the products of its rows.
    """
    rn, names, full = F.col(RN), [f"`{k}`" for k in keys], steps + 1
    data = [LABEL, *[feature(i) for i in range(p)]]
    sent = rows.select(*names, windows.pane_of(rn).alias(PANE), RN, *data)
    values = ["_tl_n", "_tl_yy", *[f"_tl_b{i}" for i in range(p)], *[f"_tl_g{i}_{j}" for i, j in upper(p)]]
    groups = [*keys, PANE]
    schema = T.StructType(
        [sent.schema[g] for g in groups]
        + [T.StructField(STEP, T.IntegerType())]
        + (
            [T.StructField(v, T.DoubleType()) for v in values]
            if p <= NARROW else [T.StructField("acc", T.ArrayType(T.DoubleType()))]
        )
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            ones = np.ones((batch.num_rows, 1))
            z = np.column_stack([ones, *[batch.column(c).to_numpy(zero_copy_only=False) for c in data]])
            index = batch.column(RN).to_numpy(zero_copy_only=False)
            hits = np.column_stack([drawn_rows(index, steps, seed, fraction), ones])
            differs = np.zeros(batch.num_rows, bool)
            differs[0] = True
            for g in groups:
                differs[1:] |= changes(batch.column(g))
            edges = np.flatnonzero(differs)
            ends = np.append(edges[1:], batch.num_rows)
            # Every pane reports to every step, so that it exists in each, drawn or not.
            sums = np.concatenate([drawn_products(z[a:b], hits[a:b]) for a, b in zip(edges, ends)])
            at = pa.array(np.repeat(edges, full))
            out = {g: batch.column(g).take(at) for g in groups}
            out[STEP] = np.tile(np.arange(1, full + 1, dtype=np.int32), len(edges))
            if p <= NARROW:
                out |= {v: sums[:, i] for i, v in enumerate(values)}
            else:
                out["acc"] = double_arrays(sums)
            yield out_batch(out, arrow)

    parts = sent.mapInArrow(run, schema)
    if p > NARROW:
        parts = parts.select(*names, STEP, PANE, F.posexplode("acc").alias("_tl_at", "_tl_v"))
        panes = parts.groupBy(*names, STEP, "_tl_at", PANE).agg(F.sum("_tl_v").alias("_tl_v"))
        sums = window_sums(panes, [*keys, STEP, "_tl_at"], ["_tl_v"], windows)
        return _packed(sums, keys, p, full, windows)
    panes = parts.groupBy(*names, STEP, PANE).agg(*[F.sum(v).alias(v) for v in values])
    sums = window_sums(panes, [*keys, STEP], values, windows)
    return _packed(sums, keys, p, full, windows)
