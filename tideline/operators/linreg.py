"""Mini-batch linear regression by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import LearnType, LinRegOptions
from tideline.functions.vectors import dot
from tideline.plans.arrival import RN, as_names, same_keys
from tideline.plans.as_of import as_of_join, small
from tideline.plans.count_windows import PANE, WINDOW_ID, CountWindows
from tideline.plans.gram import LABEL, feature, gram_stats
from tideline.plans.rows import as_columns, attach_models, index_rows, safe_keys, typed
from tideline.plans.sgd_chain import chain_models
from tideline.scratch import materialise

# Below this share of the mean squared label, the error computed from the sums
# has lost too many digits and is computed from the rows.
CANCELLED = 1e-6


@dataclass
class Fit:
    """Indexed rows and the model of every complete window."""

    rows: DataFrame
    models: DataFrame
    keys: list[str]
    windows: CountWindows


def fit_linreg(
    df: DataFrame,
    y: str | Column,
    xs: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: LinRegOptions = LinRegOptions(),
    on_null: str = "error",
    base: DataFrame | None = None,
    start: DataFrame | None = None,
    chunk: int | None = None,
) -> Fit:
    if options.learn_type == LearnType.TIME:
        raise ValueError("time windows need a time column: use linreg_time_windows")
    keys = as_names(partition_by)
    features = as_columns([y]) + as_columns(xs)
    if len(features) < 2:
        raise ValueError("at least one feature besides the label is required")
    p = len(features) - 1
    windows = CountWindows(options.batch_size, options.shift)
    arrived = index_rows(df, features, order_by, partition_by, on_null, base)
    rows = arrived.rows
    values = typed(features, on_null)
    numeric = rows.select(
        *[F.col(f"`{k}`") for k in keys],
        RN,
        values[0].alias(LABEL),
        *[v.alias(feature(i)) for i, v in enumerate(values[1:])],
    )
    stats = gram_stats(
        numeric, keys, p, windows,
        options.num_iterations, options.mini_batch_fraction, options.seed,
    )
    models = chain_models(
        stats, keys, p, options, start,
        windows.count(arrived.longest), arrived.total // windows.shift + 1, chunk,
    )
    models = _exact_errors(materialise(models, "models"), numeric, keys, p, windows)
    return Fit(rows, models, keys, windows)


def _exact_errors(
    models: DataFrame, numeric: DataFrame, keys: Sequence[str], p: int, windows: CountWindows
) -> DataFrame:
    """Recompute the error from the rows where the sums have cancelled.

    The sums give the error without a second pass. Only windows whose fit is
    nearly perfect need one, so usually no row is read again.
    """
    names = [f"`{k}`" for k in keys]
    close = models.where(
        (F.col("stderr") < F.col("mean_yy") * F.lit(CANCELLED)) & (F.col("mean_yy") > 0)
    )
    if close.isEmpty():
        return models.drop("mean_yy")
    first = F.col(WINDOW_ID) * F.lit(windows.stride)
    wanted = close.select(
        *[F.col(f"`{k}`").alias(f"_tl_c{i}") for i, k in enumerate(keys)],
        F.col(WINDOW_ID).alias("_tl_win"),
        "weights",
        F.explode(F.sequence(first, first + F.lit(windows.span - 1))).alias("_tl_cpane"),
    )
    paned = numeric.withColumn(PANE, windows.pane_of(F.col(RN)))
    match = F.col(PANE) == F.col("_tl_cpane")
    if keys:
        match = match & same_keys(
            [F.col(n) for n in names], [F.col(f"_tl_c{i}") for i in range(len(keys))]
        )
    residual = F.col(LABEL) - predict([F.col(feature(i)) for i in range(p)], F.col("weights"))
    errors = (
        paned.join(wanted, match)
        .groupBy(*[f"_tl_c{i}" for i in range(len(keys))], "_tl_win")
        .agg(F.avg(residual * residual).alias("_tl_mse"))
    )
    match = F.col(WINDOW_ID) == F.col("_tl_win")
    if keys:
        match = match & same_keys(
            [F.col(n) for n in names], [F.col(f"_tl_c{i}") for i in range(len(keys))]
        )
    kept = [c for c in models.columns if c != "mean_yy"]
    return models.join(errors, match, "left").select(
        *[
            F.coalesce("_tl_mse", "stderr").alias("stderr") if c == "stderr" else F.col(f"`{c}`")
            for c in kept
        ]
    )


def predict(xs: Sequence[Column], weights: Column) -> Column:
    if len(xs) <= 48:
        return reduce(lambda a, b: a + b, [x * F.get(weights, F.lit(i)) for i, x in enumerate(xs)])
    return dot(F.array(*xs), weights)


def beta_columns(p: int) -> list[Column]:
    """``stderr, beta0 … beta{p}``: error, intercept, weights."""
    return [
        F.col("stderr"),
        F.col("intercept").alias("beta0"),
        *[F.get("weights", F.lit(i)).alias(f"beta{i + 1}") for i in range(p)],
    ]


def stream_linreg(
    df: DataFrame,
    y: str | Column,
    xs: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: LinRegOptions = LinRegOptions(),
    on_null: str = "error",
) -> DataFrame:
    """Closing row of each window with ``stderr, beta0 … beta{p}`` appended.

    ``stderr`` is the mean squared error on the rows of the window, under the
    model just trained on them; ``beta0`` is the intercept, which this trainer
    leaves at 0. Each window starts from the weights of the window before.
    Select the columns the result needs first: all columns of ``df`` are sorted.
    """
    df, partition_by, helpers = safe_keys(df, partition_by)
    fit = fit_linreg(df, y, xs, order_by, partition_by, options, on_null)
    p = len(as_columns(xs))
    return attach_models(fit.rows, fit.models, fit.keys, fit.windows, beta_columns(p)).drop(*helpers)


def linreg_models(
    df: DataFrame,
    y: str | Column,
    xs: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: LinRegOptions = LinRegOptions(),
    on_null: str = "error",
) -> DataFrame:
    """Model history: keys, window_id, n, stderr, intercept, weights, iterations."""
    return fit_linreg(df, y, xs, order_by, partition_by, options, on_null).models


def linreg_prequential(
    df: DataFrame,
    y: str | Column,
    xs: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: LinRegOptions = LinRegOptions(),
    on_null: str = "error",
) -> DataFrame:
    """Every row with the prediction of the last model trained before it (test, then train).

    Adds ``model_window`` and ``prediction``, null for the rows before the first model is there.
    Which model that is follows from the index of the row, so rows are joined with the
    history by number, broadcast if its counted size allows it.
    """
    df, partition_by, helpers = safe_keys(df, partition_by)
    fit = fit_linreg(df, y, xs, order_by, partition_by, options, on_null)
    windows, keys, p = fit.windows, fit.keys, len(as_columns(xs))
    known = F.when(F.col(RN) >= windows.size, windows.closed_by(F.col(RN) - 1))
    rows = fit.rows.withColumn("_tl_known", known)
    history = fit.models.select(
        *[F.col(f"`{k}`").alias(f"_tl_p{i}") for i, k in enumerate(keys)],
        F.col(WINDOW_ID).alias("_tl_w"), F.col("weights").alias("_tl_weights"),
    )
    match = F.col("_tl_known") == F.col("_tl_w")
    if keys:
        match = match & same_keys(
            [F.col(f"`{k}`") for k in keys], [F.col(f"_tl_p{i}") for i in range(len(keys))]
        )
    values = typed(as_columns(xs), on_null)
    kept = [c for c in df.columns if c not in ("model_window", "prediction")]
    return rows.join(small(history, 8 * p + 64), match, "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("_tl_known").alias("model_window"),
        predict(values, F.col("_tl_weights")).alias("prediction"),
    ).drop(*helpers)


def score_as_of(
    df: DataFrame,
    xs: Sequence[str | Column],
    history: DataFrame,
    time: str,
    since: str = "window_end",
    partition_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Every row with the prediction of the last model whose ``since`` is not after its ``time``.

    ``history`` holds ``since``, ``beta0 …`` and the key columns, as ``linreg_time_windows``
    returns them. Adds ``model_since`` and ``prediction``, null before the first model.
    """
    features, keys = as_columns(xs), as_names(partition_by)
    betas = [F.col(f"beta{i}") for i in range(len(features) + 1)]
    models = history.select(
        *[F.col(f"`{k}`") for k in keys], F.col(f"`{since}`").alias("model_since"), F.array(*betas).alias("_tl_betas")
    ).withColumn("_tl_since", F.col("model_since"))
    kept = [c for c in df.columns if c not in ("model_since", "prediction")]
    found = as_of_join(
        df.select(*[F.col(f"`{c}`") for c in kept]), models, time, "_tl_since", keys, ["model_since", "_tl_betas"]
    )
    value = predict([f.cast("double") for f in features], F.slice("_tl_betas", 2, len(features)))
    return found.select(
        *[F.col(f"`{c}`") for c in kept], "model_since",
        (value + F.get("_tl_betas", F.lit(0))).alias("prediction"),
    )


def stream_linreg_call(
    df: DataFrame,
    *arguments,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    on_null: str = "error",
) -> DataFrame:
    """Positional form: seven constants (or none), the label, the features."""
    options, columns = LinRegOptions.from_arguments(arguments)
    return stream_linreg(df, columns[0], columns[1:], order_by, partition_by, options, on_null)


def score(
    df: DataFrame,
    xs: Sequence[str | Column],
    weights: Sequence[float] | Column,
    intercept: float | Column = 0.0,
    name: str = "prediction",
) -> DataFrame:
    """Add the prediction ``weights · xs + intercept``."""
    features = [x.cast("double") for x in as_columns(xs)]
    if isinstance(weights, Column):
        value = predict(features, weights)
    else:
        if len(weights) != len(features):
            raise ValueError(f"{len(weights)} weights for {len(features)} features")
        value = reduce(
            lambda a, b: a + b, [x * F.lit(float(w)) for x, w in zip(features, weights)]
        )
    offset = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    return df.withColumn(name, value + offset)
