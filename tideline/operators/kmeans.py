"""Mini-batch k-means, retrained from the start for every window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.config import KMeansOptions, LearnType
from tideline.functions.vectors import format_center, nearest_center
from tideline.plans.arrival import RN, as_names, same_keys
from tideline.plans.count_windows import WINDOW_ID, CountWindows
from tideline.plans.gram import feature
from tideline.plans.lloyd import GATHER_DOUBLES, fit_windows, slide_windows
from tideline.plans.ordered import ordered_map, out_batch
from tideline.plans.rows import as_columns, attach_models, check_numeric, index_rows, safe_keys, typed, with_one_row


@dataclass
class ClusterFit:
    """Indexed rows and the centres of every complete window."""

    rows: DataFrame
    models: DataFrame
    keys: list[str]
    windows: CountWindows


def fit_kmeans(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: KMeansOptions = KMeansOptions(),
    on_null: str = "error",
    base: DataFrame | None = None,
    start: DataFrame | None = None,
    gather: int = GATHER_DOUBLES,
) -> ClusterFit:
    if options.learn_type == LearnType.TIME:
        raise ValueError("time windows need a time column: use kmeans_time_windows")
    keys = as_names(partition_by)
    given = as_columns(features)
    dims = len(given)
    windows = CountWindows(options.batch_size, options.shift)
    arrived = index_rows(df, given, order_by, partition_by, on_null, base)
    numeric = arrived.rows.select(
        *[F.col(f"`{k}`") for k in keys],
        RN,
        *[v.alias(feature(i)) for i, v in enumerate(typed(given, on_null))],
    )
    most = arrived.total // windows.shift + 1
    if not windows.tumbling and windows.size * dims <= gather:
        models = slide_windows(numeric, keys, dims, options, windows, most)
    else:
        models = fit_windows(
            windows.members(numeric), keys, dims, options, windows.size, gather, most=most
        )
    if options.update == "decay":
        models = decay_centers(models, keys, options.alpha, start)
    return ClusterFit(arrived.rows, models, keys, windows)


def decay_centers(
    models: DataFrame,
    keys: str | Sequence[str] | None,
    alpha: float,
    start: DataFrame | None = None,
) -> DataFrame:
    """Merge each window's centres into held centres that lose weight.

    Every window is trained from scratch, so its cluster ids mean nothing to the next
    one. Each of its centres (mean x of m rows) goes to the nearest held centre, the
    first of equally near ones: ``n' = n·alpha + m`` and ``c' = (c·n·alpha + x·m) / n'``.
    A held centre that gets none keeps its place. The first window is held as it is; a
    place that it left empty is taken by the first later centre that is held nowhere.
    With alpha 1 all history counts alike, with 0 none.

    ``models`` holds keys, window_id, centers, weights; other columns pass through, and
    ``history`` is added. ``start`` (keys, acc) is the history before the first window.
    One ordered walk per key reads k centres a window.
    """
    keys = as_names(keys)
    history = F.lit(None).cast("array<double>").alias("_tl_acc")
    if start is None:
        models = models.select("*", history)
    elif not keys:
        models = with_one_row(models, start.select(F.col("acc").alias("_tl_acc")))
    else:
        first = start.select(
            *[F.col(f"`{k}`").alias(f"_tl_e{i}") for i, k in enumerate(keys)],
            F.col("acc").alias("_tl_acc"),
        )
        match = same_keys(
            [F.col(f"`{k}`") for k in keys], [F.col(f"_tl_e{i}") for i in range(len(keys))]
        )
        models = models.join(first, match, "left").select(*models.columns, "_tl_acc")
    kept = [c for c in models.columns if c not in ("centers", "weights", "_tl_acc")]
    schema = T.StructType(
        [models.schema[c] for c in kept]
        + [models.schema["centers"], models.schema["weights"]]
        + [T.StructField("history", T.ArrayType(T.DoubleType()))]
    )
    arrow = to_arrow_schema(schema)

    def body(marked):
        held = None  # weights, centres with NaN in empty places
        for batch, flags in marked:
            centers, weights = batch.column("centers").to_pylist(), batch.column("weights").to_pylist()
            starts = batch.column("_tl_acc").to_pylist()
            out = {"centers": [], "weights": [], "history": []}
            for i, first in enumerate(flags):
                if first:
                    held = unpack_history(starts[i], len(weights[i])) if starts[i] else None
                held = absorb_centers(held, centers[i], weights[i], alpha)
                n, c = held
                out["centers"].append([None if x[0] != x[0] else x for x in c.tolist()])
                out["weights"].append(n.tolist())
                out["history"].append([*n.tolist(), *c.ravel().tolist()])
            yield out_batch({c: batch.column(c) for c in kept} | out, arrow)

    return ordered_map(
        models.withColumn("_tl_all", F.lit(0)), [*keys, "_tl_all"], [WINDOW_ID], body, schema
    )


def unpack_history(acc: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.array(acc, dtype=float)
    return flat[:k], flat[k:].reshape(k, -1)


def absorb_centers(held, centers, weights, alpha: float):
    """Held (weights, centres) after the centres of one window."""
    dims = next((len(c) for c in centers if c is not None), 0 if held is None else held[1].shape[1])
    new = np.array([[np.nan] * dims if c is None else c for c in centers], dtype=float)
    m = np.array([0.0 if c is None else w for c, w in zip(centers, weights)])
    new = new.reshape(len(centers), dims)
    if held is None:
        return m, new
    n, c = held[0] * alpha, held[1].copy()
    if c.shape[1] != dims:
        c = np.full((len(n), dims), np.nan)
    gain, moved = np.zeros(len(n)), np.zeros_like(c)
    for x, w in zip(new, m):
        if w == 0:
            continue
        apart = ((c - x) ** 2).sum(axis=1)
        full = ~np.isnan(apart)
        if not full.all() and (not full.any() or np.nanmin(apart) > 0):
            j = int(np.argmin(full))
            c[j] = x
        else:
            j = int(np.nanargmin(apart))
        gain[j] += w
        moved[j] += w * x
    total = n + gain
    some = gain > 0
    c[some] = (c[some] * n[some, None] + moved[some]) / total[some, None]
    return total, c


def center_columns(k: int, error: str = "wssse") -> list[Column]:
    """``stderr, center0 … center{k-1}``: error, then one string per centre."""
    return [
        F.col(error).alias("stderr"),
        *[format_center(F.get("centers", F.lit(i))).alias(f"center{i}") for i in range(k)],
    ]


def stream_kmeans(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: KMeansOptions = KMeansOptions(),
    on_null: str = "error",
) -> DataFrame:
    """Closing row of each window with ``stderr, center0 … center{k-1}`` appended.

    ``stderr`` is the within-set sum of squared errors of the window's own
    model. Centres are strings of comma-separated coordinates, null where the
    window has fewer different points than clusters.
    """
    df, partition_by, helpers = safe_keys(df, partition_by)
    fit = fit_kmeans(df, features, order_by, partition_by, options, on_null)
    return attach_models(
        fit.rows, fit.models, fit.keys, fit.windows, center_columns(options.num_clusters)
    ).drop(*helpers)


def kmeans_models(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: KMeansOptions = KMeansOptions(),
    on_null: str = "error",
) -> DataFrame:
    """Model history: keys, window_id, n, wssse, centers, weights."""
    return fit_kmeans(df, features, order_by, partition_by, options, on_null).models


def stream_kmeans_call(
    df: DataFrame,
    *arguments,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    on_null: str = "error",
) -> DataFrame:
    """Positional form: seven constants (or none), then the features."""
    options, columns = KMeansOptions.from_arguments(arguments)
    return stream_kmeans(df, columns, order_by, partition_by, options, on_null)


def assign_clusters(
    df: DataFrame, features: Sequence[str | Column], centers: Sequence[Sequence[float]]
) -> DataFrame:
    """Add ``cluster_id`` and ``distance_sq`` of the nearest given centre."""
    given = as_columns(features)
    check_numeric(df, given)
    if not centers or any(len(c) != len(given) for c in centers):
        raise ValueError(f"every centre needs {len(given)} coordinates")
    x = F.array(*[f.cast("double") for f in given])
    literal = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    near = nearest_center(x, literal, len(centers), len(given))
    return (
        df.withColumn("_tl_near", near)
        .withColumn("cluster_id", F.col("_tl_near.cid"))
        .withColumn("distance_sq", F.col("_tl_near.dist"))
        .drop("_tl_near")
    )


def cluster_weights(
    df: DataFrame, features: Sequence[str | Column], centers: Sequence[Sequence[float]]
) -> DataFrame:
    """Rows and squared error per centre: cluster_id, weight, wssse."""
    return (
        assign_clusters(df, features, centers)
        .groupBy("cluster_id")
        .agg(F.count("*").alias("weight"), F.sum("distance_sq").alias("wssse"))
    )
