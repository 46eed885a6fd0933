"""Event-time training windows (an extension: the count windows' time twin)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import KMeansOptions, LinRegOptions
from tideline.operators.kmeans import center_columns, decay_centers
from tideline.operators.linreg import CANCELLED, beta_columns, predict
from tideline.plans.arrival import RN, as_names, same_keys
from tideline.plans.count_windows import WINDOW_ID
from tideline.plans.gram import LABEL, feature
from tideline.plans.lloyd import fit_windows
from tideline.plans.rows import as_columns, check_numeric, index_rows, missing, typed
from tideline.plans.sgd_chain import chain_models
from tideline.plans.time_stats import (
    chain_input,
    checked_time,
    duration_micros,
    paned_stats,
    time_stats,
    window_bounds,
    window_number,
)
from tideline.scratch import materialise


def linreg_time_windows(
    df: DataFrame,
    ts: str,
    y: str | Column,
    xs: Sequence[str | Column],
    frame: str,
    slide: str | None = None,
    partition_by: str | Sequence[str] | None = None,
    options: LinRegOptions = LinRegOptions(),
    on_null: str = "error",
) -> DataFrame:
    """One row per window: keys, window_start, window_end, n, stderr, beta0 ….

    ``options.batch_size`` and ``window_shift`` have no effect here.
    """
    if options.mini_batch_fraction < 1:
        raise ValueError("time windows train on all their rows: mini_batch_fraction must be 1")
    spark = df.sparkSession
    keys = as_names(partition_by)
    features = as_columns([y]) + as_columns(xs)
    p = len(features) - 1
    check_numeric(df, features)
    df = checked_time(df, ts, on_null)
    if on_null == "drop":
        df = df.where(~missing(features))
    length = duration_micros(spark, frame)
    step = duration_micros(spark, slide) if slide else length
    full = options.num_iterations + 1
    if step < length:
        chained = materialise(paned_stats(df, ts, keys, features, length, step, full, on_null), "time")
    else:
        stats = materialise(time_stats(df, ts, keys, features, frame, slide, on_null), "time")
        chained = chain_input(stats, keys, step, full)
    low, high, most = chained.agg(
        F.min(WINDOW_ID), F.max(WINDOW_ID), F.count("*")
    ).first()
    longest = 0 if low is None else high - low + 1
    models = materialise(
        chain_models(chained, keys, p, options, None, longest, most), "models"
    )
    models = _exact_errors(models, df, ts, keys, features, frame, slide, on_null, step)
    kind = df.schema[ts].dataType.simpleString()
    return window_bounds(models, step, length, kind).select(
        *[f"`{k}`" for k in keys], "window_start", "window_end", "n", *beta_columns(p)
    )


def _exact_errors(models, df, ts, keys, features, frame, slide, on_null, step) -> DataFrame:
    """Recompute nearly perfect fits from the rows, as for count windows."""
    close = models.where(
        (F.col("stderr") < F.col("mean_yy") * F.lit(CANCELLED)) & (F.col("mean_yy") > 0)
    )
    if close.isEmpty():
        return models
    names = [f"`{k}`" for k in keys]
    values = typed(features, on_null)
    p = len(features) - 1
    rows = df.select(
        *names,
        values[0].alias(LABEL),
        *[v.alias(feature(i)) for i, v in enumerate(values[1:])],
        F.window(F.col(f"`{ts}`"), frame, slide).alias("_tl_w"),
    ).withColumn(
        "_tl_number",
        window_number(F.col("_tl_w.start"), step, df.schema[ts].dataType.simpleString()),
    )
    wanted = close.select(
        *[F.col(n).alias(f"_tl_c{i}") for i, n in enumerate(names)],
        F.col(WINDOW_ID).alias("_tl_win"),
        "weights",
    )
    left = [F.col(n) for n in names]
    right = [F.col(f"_tl_c{i}") for i in range(len(keys))]
    residual = F.col(LABEL) - predict([F.col(feature(i)) for i in range(p)], F.col("weights"))
    errors = (
        rows.join(wanted, same_keys([*left, F.col("_tl_number")], [*right, F.col("_tl_win")]))
        .groupBy(*[f"_tl_c{i}" for i in range(len(keys))], "_tl_win")
        .agg(F.avg(residual * residual).alias("_tl_mse"))
    )
    match = same_keys([*left, F.col(WINDOW_ID)], [*right, F.col("_tl_win")])
    return models.join(errors, match, "left").select(
        *[
            F.coalesce("_tl_mse", "stderr").alias(c) if c == "stderr" else F.col(f"`{c}`")
            for c in models.columns
        ]
    )


def kmeans_time_windows(
    df: DataFrame,
    ts: str,
    features: Sequence[str | Column],
    frame: str,
    slide: str | None = None,
    order_by: str | Sequence[str] | None = None,
    partition_by: str | Sequence[str] | None = None,
    options: KMeansOptions = KMeansOptions(),
    on_null: str = "error",
) -> DataFrame:
    """One row per window: keys, window_start, window_end, n, stderr, center0 ….

    A time window may hold any number of rows, so the centres are computed by
    aggregations over all windows at once. ``order_by`` (the time column by
    default) decides which points come first.
    """
    spark = df.sparkSession
    keys = as_names(partition_by)
    given = as_columns(features)
    length = duration_micros(spark, frame)
    step = duration_micros(spark, slide) if slide else length
    df = checked_time(df, ts, on_null)
    arrived = index_rows(df, given, order_by or ts, partition_by, on_null)
    names = [f"`{k}`" for k in keys]
    kind = df.schema[ts].dataType.simpleString()
    rows = arrived.rows.select(
        *names,
        RN,
        *[v.alias(feature(i)) for i, v in enumerate(typed(given, on_null))],
        F.window(F.col(f"`{ts}`"), frame, slide).alias("_tl_w"),
    )
    numbered = rows.select(
        *names,
        window_number(F.col("_tl_w.start"), step, kind).alias(WINDOW_ID),
        RN,
        *[feature(i) for i in range(len(given))],
    )
    models = fit_windows(numbered, keys, len(given), options, None)
    if options.update == "decay":
        models = decay_centers(models, keys, options.alpha)
    return window_bounds(models, step, length, kind).select(
        *names, "window_start", "window_end", "n", *center_columns(options.num_clusters)
    )
