"""From a caller's frame to indexed rows with typed features, and back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.arrival import RN, SEQ, Arrived, arrival_index, as_names, same_keys
from tideline.plans.count_windows import WINDOW_ID, CountWindows


def as_columns(exprs: Sequence[str | Column] | str | Column) -> list[Column]:
    if isinstance(exprs, (str, Column)):
        exprs = [exprs]
    return [F.col(e) if isinstance(e, str) else e for e in exprs]


def array_elements(column: str, size: int) -> list[Column]:
    """The ``size`` elements of an array column, as features; other lengths fail the query.

    A null array gives null features.
    """
    array = F.col(column)
    stop = F.raise_error(F.lit(f"an array of {column} does not have {size} elements"))
    fits = array.isNull() | (F.size(array) == size)
    first = F.when(fits, F.get(array, F.lit(0)).cast("double")).otherwise(stop.cast("double"))
    return [first, *[F.get(array, F.lit(i)) for i in range(1, size)]]


def one_row(df: DataFrame) -> DataFrame | None:
    """A table that has one row or none, as a row that is broadcast; more are an error."""
    found = df.limit(2).collect()
    if len(found) > 1:
        raise ValueError("expected at most one row")
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if found else None


def with_one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of the only row of ``right``, or nulls."""
    row = one_row(right)
    if row is None:
        return left.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema])
    return left.crossJoin(row)


def check_numeric(df: DataFrame, features: Sequence[Column]) -> None:
    """Reject features that are not numbers."""
    for field, given in zip(df.select(*features).schema.fields, features):
        if not isinstance(field.dataType, T.NumericType):
            raise TypeError(
                f"feature {field.name} must be numeric, got {field.dataType.simpleString()}"
            )


def missing(features: Sequence[Column]) -> Column:
    return reduce(
        lambda a, b: a | b, [f.isNull() | F.isnan(f.cast("double")) for f in features]
    )


def index_rows(
    df: DataFrame,
    features: Sequence[Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None,
    on_null: str,
    base: DataFrame | None = None,
) -> Arrived:
    """Rows with their arrival index, after the null rule."""
    if on_null not in ("error", "drop"):
        raise ValueError(f"on_null must be 'error' or 'drop', got {on_null!r}")
    check_numeric(df, features)
    for name in df.columns:
        if name.startswith("_tl_") and name != SEQ:
            raise ValueError(f"column names starting with _tl_ are reserved, got {name}")
    if on_null == "drop":
        df = df.where(~missing(features))
    return arrival_index(df, order_by, partition_by, base)


def typed(features: Sequence[Column], on_null: str) -> list[Column]:
    """Features as doubles; a null or NaN fails the query unless dropped earlier."""
    if on_null == "drop":
        return [f.cast("double") for f in features]
    stop = F.raise_error(F.lit("null or NaN feature value; use on_null='drop' to skip such rows"))
    return [
        F.when(f.isNotNull() & ~F.isnan(f.cast("double")), f.cast("double")).otherwise(
            stop.cast("double")
        )
        for f in features
    ]


# Names of model columns, which a key must not have.
_MODEL_NAMES = {
    WINDOW_ID, "n", "stderr", "intercept", "weights", "iterations", "mean_yy", "centers", "wssse",
    "ssq", "kernels", "history", "acc", "idx", "block", "base", "w",
}


def safe_keys(
    df: DataFrame, partition_by: str | Sequence[str] | None
) -> tuple[DataFrame, list[str], list[str]]:
    """(frame, keys, helpers): keys with the name of a model column are replaced by copies."""
    keys, helpers = as_names(partition_by), []
    for i, key in enumerate(keys):
        if key in _MODEL_NAMES:
            helpers.append(f"_tlkey{i}")
            df = df.withColumn(helpers[-1], F.col(f"`{key}`"))
            keys[i] = helpers[-1]
    return df, keys, helpers


def attach_models(
    rows: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    windows: CountWindows,
    columns: Sequence[Column],
) -> DataFrame:
    """Closing row of every window, all its columns, then the model ``columns``.

    A column of the input that has the name of an appended one gives way to it, so a
    result can be the input of a further operator.
    """
    # The model columns are computed first and given reserved names: no column of the
    # caller can clash with them.
    names = models.select(*columns).columns
    made = models.select(
        *[F.col(f"`{k}`").alias(f"_tl_m{i}") for i, k in enumerate(keys)],
        F.col(WINDOW_ID).alias("_tl_window"),
        *[c.alias(f"_tl_o{i}") for i, c in enumerate(columns)],
    )
    plain = [c for c in rows.columns if c not in (RN, SEQ, *names)]
    closing = rows.where(windows.closes(F.col(RN))).select(
        *[F.col(f"`{k}`").alias(f"_tl_k{i}") for i, k in enumerate(keys)],
        windows.closed_by(F.col(RN)).alias("_tl_closes"),
        *[F.col(f"`{c}`") for c in plain],
    )
    match = F.col("_tl_closes") == F.col("_tl_window")
    if keys:
        match = match & same_keys(
            [F.col(f"_tl_k{i}") for i in range(len(keys))],
            [F.col(f"_tl_m{i}") for i in range(len(keys))],
        )
    return closing.join(made, match).select(
        *[F.col(f"`{c}`") for c in plain],
        *[F.col(f"_tl_o{i}").alias(n) for i, n in enumerate(names)],
    )


__all__ = [
    "array_elements", "as_columns", "as_names", "attach_models", "check_numeric",
    "index_rows", "missing", "one_row", "safe_keys", "typed", "with_one_row",
]
