"""Warm-started gradient descent along the windows of each key."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.config import LinRegOptions
from tideline.functions.vectors import squared_distance
from tideline.plans.arrival import same_keys
from tideline.plans.count_windows import WINDOW_ID, int_div
from tideline.plans.gram import STEP, upper
from tideline.plans.ordered import double_arrays, doubles, ordered_map, out_batch
from tideline.plans.prefix import exclusive_prefix
from tideline.plans.rows import with_one_row
from tideline.scratch import materialise

log = logging.getLogger(__name__)

CHUNK = "_tl_chunk"
_START = "_tl_w0"
_DOUBLES = T.ArrayType(T.DoubleType())
# Statistics that one task should walk in sequence, in doubles.
_CHUNK_DOUBLES = 4_000_000
# Largest relative difference left between the end of a chunk and the start of
# the next one.
_SEAM = 1e-10


def chunk_windows(p: int) -> int:
    """Windows that one task walks in sequence."""
    return max(64, min(65536, _CHUNK_DOUBLES // (p * (p + 3) // 2 + 3)))


def descend(w, draws, options: LinRegOptions, jacobian=None):
    """Gradient steps from ``w``; returns the weights and the steps taken.

    ``draws[i]`` is (n, gram, rhs) for step i + 1, or None where nothing was
    drawn. ``jacobian``, if given, is multiplied in place by each step's matrix.
    """
    moved = False
    for i, draw in enumerate(draws, start=1):
        if draw is None:
            continue
        n, gram, rhs = draw
        rate = options.step_size / math.sqrt(i)
        new = w - rate * ((gram @ w - rhs) / n)
        if jacobian is not None:
            jacobian -= (rate / n) * (gram @ jacobian)
        delta = new - w
        w = new
        # The first step has no earlier weights to compare with.
        if moved and math.sqrt(delta @ delta) < options.convergence_tol * max(
            math.sqrt(w @ w), 1.0
        ):
            return w, i
        moved = True
    return w, len(draws)


def _walk(marked, p: int, options: LinRegOptions, track: bool):
    """Train window after window; yields one list of results per batch."""
    steps = options.num_iterations
    full = steps + 1
    rows_up, cols_up = (np.array(side) for side in zip(*upper(p)))
    sampled = options.mini_batch_fraction < 1
    w = jac = None
    window, drawn = None, {}
    for batch, flags in marked:
        ns = batch.column("n").to_numpy(zero_copy_only=False)
        yys = batch.column("yy").to_numpy(zero_copy_only=False)
        its = batch.column(STEP).to_numpy(zero_copy_only=False)
        wins = batch.column(WINDOW_ID).to_numpy(zero_copy_only=False)
        bs, gs = doubles(batch, "b"), doubles(batch, "g")
        grams = np.empty((batch.num_rows, p, p))
        grams[:, rows_up, cols_up] = gs
        grams[:, cols_up, rows_up] = gs
        starts = batch.column(_START)
        out = []
        # Divergence is reported by the caller, where it is asked for.
        with np.errstate(all="ignore"):
            for i, first in enumerate(flags):
                if first:
                    start = starts[i]
                    w = (
                        np.array(start.values.to_numpy(zero_copy_only=False))
                        if start.is_valid
                        else np.zeros(p)
                    )
                    jac = np.eye(p) if track else None
                    window = None
                if wins[i] != window:
                    window, drawn = wins[i], {}
                gram = grams[i]
                this = (ns[i], gram, bs[i])
                if its[i] < full:
                    if ns[i] > 0:
                        drawn[int(its[i])] = this
                    continue
                draws = [drawn.get(s) for s in range(1, full)] if sampled else [this] * steps
                before = w
                w, taken = descend(w, draws, options, jac)
                mse = max(0.0, (yys[i] - 2 * (w @ bs[i]) + w @ gram @ w) / ns[i])
                out.append((i, first, before, w, taken, mse, ns[i], yys[i] / ns[i], jac))
        yield batch, out


def _emit(
    staged: DataFrame, keys: Sequence[str], p: int, options: LinRegOptions, most: int
) -> DataFrame:
    schema = T.StructType(
        [staged.schema[k] for k in keys]
        + [
            T.StructField(WINDOW_ID, T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("stderr", T.DoubleType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("weights", _DOUBLES),
            T.StructField("iterations", T.IntegerType()),
            T.StructField("mean_yy", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    kept = [*keys, WINDOW_ID]

    def body(marked):
        for batch, out in _walk(marked, p, options, track=False):
            if not out:
                continue
            at, _, _, weights, taken, mse, n, mean_yy, _ = zip(*out)
            if options.on_diverge == "error" and not np.isfinite(np.stack(weights)).all():
                for i, w in zip(at, weights):
                    if not np.isfinite(w).all():
                        where = {c: batch.column(c)[i].as_py() for c in kept}
                        raise ArithmeticError(f"gradient descent diverged in window {where}")
            rows = batch.take(pa.array(at, type=pa.int64()))
            columns = {c: rows.column(c) for c in kept}
            columns |= {
                "n": np.asarray(n).astype("int64"),
                "stderr": list(mse),
                "intercept": [0.0] * len(at),
                "weights": double_arrays(weights),
                "iterations": list(taken),
                "mean_yy": list(mean_yy),
            }
            yield out_batch(columns, arrow)

    return ordered_map(staged, [*keys, CHUNK], [WINDOW_ID, STEP], body, schema, most)


def _summarise(
    staged: DataFrame, keys: Sequence[str], p: int, options: LinRegOptions, most: int
) -> DataFrame:
    """Start, end and derivative of every chunk."""
    schema = T.StructType(
        [staged.schema[k] for k in keys]
        + [
            T.StructField("idx", T.LongType()),
            T.StructField("w_in", _DOUBLES),
            T.StructField("w_out", _DOUBLES),
            T.StructField("jac", _DOUBLES),
        ]
    )
    arrow = to_arrow_schema(schema)

    def body(marked):
        held = None

        def flush():
            row, w_in, w_out, jac = held
            columns = {k: row.column(k) for k in keys}
            columns["idx"] = row.column(CHUNK)
            columns["w_in"] = double_arrays([w_in])
            columns["w_out"] = double_arrays([w_out])
            columns["jac"] = double_arrays([jac])
            return out_batch(columns, arrow)

        for batch, out in _walk(marked, p, options, track=True):
            for i, first, before, w, _, _, _, _, jac in out:
                row = batch.slice(i, 1)
                same = held is not None and jac is held[3]
                if held is not None and not same:
                    yield flush()
                held = (row, held[1] if same else before, w, jac)
        if held is not None:
            yield flush()

    return ordered_map(staged, [*keys, CHUNK], [WINDOW_ID, STEP], body, schema, most)


def _fold_affine(p: int):
    """Composition of two maps w -> A w + c, stored as [A, c]."""

    def fold(a, b):
        a_mat, a_off = a[: p * p].reshape(p, p), a[p * p:]
        b_mat, b_off = b[: p * p].reshape(p, p), b[p * p:]
        with np.errstate(all="ignore"):
            return np.concatenate([(b_mat @ a_mat).ravel(), b_mat @ a_off + b_off])

    return fold


def _attach(stats: DataFrame, keys: Sequence[str], starts: DataFrame | None, by_chunk: bool):
    """Add the starting weights; ``starts`` is (keys[, idx], w)."""
    if starts is None:
        return stats.withColumn(_START, F.lit(None).cast(_DOUBLES))
    renamed = starts.select(
        *[F.col(f"`{k}`").alias(f"_tl_s{i}") for i, k in enumerate(keys)],
        *([F.col("idx").alias("_tl_s_idx")] if by_chunk else []),
        F.col("w").alias(_START),
    )
    left = [F.col(f"`{k}`") for k in keys]
    right = [F.col(f"_tl_s{i}") for i in range(len(keys))]
    if by_chunk:
        left, right = [*left, F.col(CHUNK)], [*right, F.col("_tl_s_idx")]
    if not left:
        return with_one_row(stats, renamed).select(*stats.columns, _START)
    return stats.join(renamed, same_keys(left, right), "left").select(*stats.columns, _START)


def chain_models(
    stats: DataFrame,
    keys: Sequence[str],
    p: int,
    options: LinRegOptions,
    start: DataFrame | None,
    longest: int,
    most: int,
    chunk: int | None = None,
) -> DataFrame:
    """Model of every window, each trained from the weights of the one before.

    ``start`` holds (keys, w), the weights before the first window. ``longest``
    bounds the number of windows of a key, ``most`` that of all keys together.

    A chain is sequential, but a window maps its starting weights to its final
    ones by an affine map as long as the number of steps taken does not change.
    Long chains are therefore cut into chunks that run in parallel from guessed
    starts; each reports its end and its derivative, composing those gives
    better starts, and the round is repeated until the ends meet the starts.
    Every round settles at least one more chunk, so the result is that of the
    sequential chain.
    """
    chunk = chunk or chunk_windows(p)
    if longest <= chunk:
        staged = _attach(stats.withColumn(CHUNK, F.lit(0).cast("long")), keys, start, False)
        return _emit(staged, keys, p, options, most if keys else 1)

    low, high = stats.agg(F.min(WINDOW_ID), F.max(WINDOW_ID)).first()
    if low is None:
        staged = _attach(stats.withColumn(CHUNK, F.lit(0).cast("long")), keys, start, False)
        return _emit(staged, keys, p, options, 1)
    base = low // chunk
    chunks = high // chunk - base + 1
    stats = materialise(
        stats.withColumn(CHUNK, int_div(F.col(WINDOW_ID), chunk) - F.lit(base)), "gram"
    )
    most = most if keys else chunks
    starts = None
    for turn in range(chunks + 1):
        staged = _attach(stats, keys, starts, True) if starts is not None else _attach(
            stats, keys, start, False
        )
        summary = materialise(_summarise(staged, keys, p, options, most), "chunks")
        starts = materialise(_next_starts(summary, keys, p, start, chunks), "starts")
        gap = _seam_gap(summary, starts, keys)
        log.info("chain round %d over %d chunks: gap %s", turn, chunks, gap)
        if gap <= _SEAM:
            break
    return _emit(_attach(stats, keys, starts, True), keys, p, options, most)


def _next_starts(summary, keys, p, start, chunks):
    """Chunk starts implied by the chunk maps: (keys, idx, w)."""
    mat = F.col("jac")
    # Offset of the map: end minus matrix times start.
    parts = summary.select(
        *[f"`{k}`" for k in keys],
        "idx",
        F.concat(
            mat,
            F.transform(
                F.sequence(F.lit(0), F.lit(p - 1)),
                lambda r: F.get("w_out", r)
                - F.aggregate(
                    F.zip_with(F.slice(mat, r * p + 1, F.lit(p)), F.col("w_in"), lambda a, b: a * b),
                    F.lit(0.0),
                    lambda s, v: s + v,
                ),
            ),
        ).alias("acc"),
    )
    prefix = exclusive_prefix(parts, keys, _fold_affine(p), chunks)
    first = _attach(prefix.withColumn(CHUNK, F.lit(0)), keys, start, False)
    zero = F.array_repeat(F.lit(0.0), p)
    w0 = F.coalesce(F.col(_START), zero)
    acc = F.col("acc")
    moved = F.transform(
        F.sequence(F.lit(0), F.lit(p - 1)),
        lambda r: F.aggregate(
            F.zip_with(F.slice(acc, r * p + 1, F.lit(p)), w0, lambda a, b: a * b),
            F.lit(0.0),
            lambda s, v: s + v,
        )
        + F.get(acc, F.lit(p * p) + r),
    )
    return first.select(
        *[f"`{k}`" for k in keys], "idx", F.when(acc.isNull(), w0).otherwise(moved).alias("w")
    )


def _seam_gap(summary, starts, keys) -> float:
    """Largest relative difference between assumed and implied starts."""
    renamed = starts.select(
        *[F.col(f"`{k}`").alias(f"_tl_s{i}") for i, k in enumerate(keys)],
        F.col("idx").alias("_tl_s_idx"), "w",
    )
    match = same_keys(
        [*[F.col(f"`{k}`") for k in keys], F.col("idx")],
        [*[F.col(f"_tl_s{i}") for i in range(len(keys))], F.col("_tl_s_idx")],
    )
    finite = lambda c: ~F.exists(c, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    size = F.sqrt(squared_distance(F.col("w"), F.transform("w", lambda v: F.lit(0.0))))
    gap = F.sqrt(squared_distance(F.col("w"), F.col("w_in"))) / F.greatest(size, F.lit(1.0))
    settled = F.when(finite(F.col("w")) & finite(F.col("w_in")), gap).when(
        finite(F.col("w")) | finite(F.col("w_in")), F.lit(float("inf"))
    ).otherwise(F.lit(0.0))
    return summary.join(renamed, match).agg(F.max(settled)).first()[0] or 0.0
