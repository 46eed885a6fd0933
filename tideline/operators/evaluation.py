"""Rows held out for evaluation (an extension)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import KMeansOptions, LearnType
from tideline.functions.vectors import nearest_center, text_unit
from tideline.operators.kmeans import assign_clusters
from tideline.plans.arrival import RN, as_names, same_keys
from tideline.plans.as_of import small
from tideline.plans.count_windows import WINDOW_ID, CountWindows
from tideline.plans.gram import feature
from tideline.plans.lloyd import fit_windows
from tideline.plans.rows import as_columns, index_rows, typed
from tideline.scratch import materialise


def eval_split(
    df: DataFrame,
    order_by: str | Sequence[str],
    ratio: float = 0.5,
    seed: int = 42,
    name: str = "held_out",
) -> DataFrame:
    """Mark a share ``ratio`` of the rows as held out, by a hash of their order key.

    The key is read as text, so null parts of it are left out.
    """
    if not 0 <= ratio <= 1:
        raise ValueError(f"ratio must lie between 0 and 1, got {ratio}")
    order = [F.col(f"`{c}`") for c in as_names(order_by)]
    return df.withColumn(name, text_unit(*order, F.lit(seed)) < F.lit(float(ratio)))


def held_out_ssq(
    df: DataFrame,
    features: Sequence[str | Column],
    centers: Sequence[Sequence[float]],
    order_by: str | Sequence[str],
    ratio: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Rows and squared error of given centres, on held-out and other rows."""
    marked = eval_split(df, order_by, ratio, seed)
    return (
        assign_clusters(marked, features, centers)
        .groupBy("held_out")
        .agg(F.count("*").alias("n"), F.sum("distance_sq").alias("ssq"))
    )


def kmeans_held_out(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    ratio: float = 0.5,
    partition_by: str | Sequence[str] | None = None,
    options: KMeansOptions = KMeansOptions(),
    on_null: str = "error",
    seed: int = 42,
) -> DataFrame:
    """Error of each window's centres on the rows they were trained on, and on held-out rows.

    Held-out rows (see ``eval_split``) are numbered and count towards the size of a window, but
    teach nothing. Columns: keys, window_id, n_train, ssq_train, n_held, ssq_held, centers. A
    window without a training row has no centres and no errors.
    """
    if options.learn_type == LearnType.TIME:
        raise ValueError("held-out rows need windows of rows")
    if not 0 <= ratio <= 1:
        raise ValueError(f"ratio must lie between 0 and 1, got {ratio}")
    keys, given, k = as_names(partition_by), as_columns(features), options.num_clusters
    names, dims = [f"`{c}`" for c in keys], len(given)
    windows = CountWindows(options.batch_size, options.shift)
    arrived = index_rows(df, given, order_by, partition_by, on_null)
    order = [F.col(f"`{c}`") for c in as_names(order_by)]
    numeric = arrived.rows.select(
        *names, RN, (text_unit(*order, F.lit(seed)) < F.lit(float(ratio))).alias("_tl_held"),
        *[v.alias(feature(i)) for i, v in enumerate(typed(given, on_null))],
    )
    members = windows.members(materialise(numeric, "marked"))
    models = fit_windows(
        members.where("not _tl_held").drop("_tl_held"), keys, dims, options, windows.size,
        most=arrived.total // windows.shift + 1, partial=True,
    )
    models = materialise(models, "models").select(
        *[F.col(n).alias(f"_tl_e{i}") for i, n in enumerate(names)], F.col(WINDOW_ID).alias("_tl_w"), "centers"
    )
    match = F.col(WINDOW_ID) == F.col("_tl_w")
    if keys:
        match = match & same_keys([F.col(n) for n in names], [F.col(f"_tl_e{i}") for i in range(len(keys))])
    joined = members.join(small(models, 8 * k * dims + 64), match, "left")
    point = F.array(*[feature(i) for i in range(dims)])
    cost = nearest_center(point, F.col("centers"), k, dims)["dist"]
    held = F.col("_tl_held")
    return (
        joined.select(*names, WINDOW_ID, "_tl_held", "centers", cost.alias("_tl_cost"))
        .groupBy(*names, WINDOW_ID)
        .agg(
            F.count(F.when(~held, 1)).alias("n_train"), F.sum(F.when(~held, F.col("_tl_cost"))).alias("ssq_train"),
            F.count(F.when(held, 1)).alias("n_held"), F.sum(F.when(held, F.col("_tl_cost"))).alias("ssq_held"),
            F.first("centers").alias("centers"),
        )
        .where(F.col("n_train") + F.col("n_held") == windows.size)
    )
