"""Least-squares statistics per event-time window, for tables and feeds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.plans.count_windows import PANE, WINDOW_ID, int_div
from tideline.plans.gram import LABEL, STEP, feature, upper
from tideline.plans.rows import typed


def duration_micros(spark: SparkSession, duration: str) -> int:
    """Length of a fixed duration such as ``10 minutes``."""
    moved = F.timestamp_micros(F.lit(0)) + F.expr(f"interval {duration}")
    return spark.range(1).select(F.unix_micros(moved)).first()[0]


def as_instant(ts: Column, kind: str) -> Column:
    """The time as a timestamp; a time without zone is taken as UTC."""
    if kind != "timestamp_ntz":
        return ts.cast("timestamp")
    second = F.extract(F.lit("SECOND"), ts)
    return F.make_timestamp(
        F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.minute(ts), second, F.lit("UTC")
    )


def _from_micros(micros: Column, kind: str) -> Column:
    if kind != "timestamp_ntz":
        return F.timestamp_micros(micros).cast(kind)
    seconds = (micros / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=seconds)


def checked_time(df: DataFrame, ts: str, on_null: str) -> DataFrame:
    """The null rule for the time column: rows without a time fail the query or go."""
    if on_null == "drop":
        return df.where(F.col(f"`{ts}`").isNotNull())
    stop = F.raise_error(F.lit("null time; use on_null='drop' to skip such rows"))
    kind = df.schema[ts].dataType
    return df.withColumn(ts, F.coalesce(F.col(f"`{ts}`"), stop.cast(kind)))


def window_number(start: Column, step: int, kind: str) -> Column:
    """A number that grows by one from window to window."""
    return int_div(F.unix_micros(as_instant(start, kind)), step)


def time_stats(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    features: Sequence[Column],
    frame: str,
    slide: str | None,
    on_null: str,
) -> DataFrame:
    """One aggregation: keys, window start and end, n, yy, b, g."""
    p = len(features) - 1
    names = [f"`{k}`" for k in keys]
    values = typed(features, on_null)
    rows = df.select(
        *names,
        F.col(f"`{ts}`").alias("_tl_ts"),
        values[0].alias(LABEL),
        *[v.alias(feature(i)) for i, v in enumerate(values[1:])],
    )
    y = F.col(LABEL)
    xs = [F.col(feature(i)) for i in range(p)]
    sums = {"n": F.count("*").cast("double"), "yy": F.sum(y * y)}
    sums |= {f"_tl_b{i}": F.sum(xs[i] * y) for i in range(p)}
    sums |= {f"_tl_g{i}_{j}": F.sum(xs[i] * xs[j]) for i, j in upper(p)}
    grouped = rows.groupBy(*names, F.window("_tl_ts", frame, slide).alias("_tl_w")).agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    return grouped.select(
        *names,
        F.col("_tl_w.start").alias("window_start"),
        F.col("_tl_w.end").alias("window_end"),
        "n",
        "yy",
        F.array(*[f"_tl_b{i}" for i in range(p)]).alias("b"),
        F.array(*[f"_tl_g{i}_{j}" for i, j in upper(p)]).alias("g"),
    )


def paned_stats(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    features: Sequence[Column],
    length: int,
    step: int,
    full: int,
    on_null: str,
) -> DataFrame:
    """Statistics of overlapping windows in the shape of the count-window chain.

    Rows are summed once, by panes of the largest duration that no window boundary cuts.
    Panes are put in blocks of one window's length; a window is the tail of a block, or a
    tail and the head of the next block, so no row and no pane is copied for every window it
    is in. Empty panes do not exist: the sums of an existing pane stand for the boundaries up
    to its neighbour.
    """
    p, names = len(features) - 1, [f"`{k}`" for k in keys]
    pane = math.gcd(length, step)
    m, stride = length // pane, step // pane
    values = typed(features, on_null)
    kind = df.schema[ts].dataType.simpleString()
    micros = F.unix_micros(as_instant(F.col(f"`{ts}`"), kind))
    rows = df.select(
        *names, int_div(micros - F.pmod(micros, F.lit(pane)), pane).alias(PANE),
        values[0].alias(LABEL), *[v.alias(feature(i)) for i, v in enumerate(values[1:])],
    )
    y, xs = F.col(LABEL), [F.col(feature(i)) for i in range(p)]
    sums = {"n": F.count("*").cast("double"), "yy": F.sum(y * y)}
    sums |= {f"_tl_b{i}": F.sum(xs[i] * y) for i in range(p)}
    sums |= {f"_tl_g{i}_{j}": F.sum(xs[i] * xs[j]) for i, j in upper(p)}
    panes = rows.groupBy(*names, PANE).agg(*[c.alias(n) for n, c in sums.items()])
    at = F.col(PANE)
    panes = panes.withColumn("_tl_low", at - F.pmod(at, F.lit(m)))
    block = Window.partitionBy(*names, "_tl_low")
    ahead = block.orderBy(PANE).rowsBetween(Window.unboundedPreceding, 0)
    behind = block.orderBy(F.desc(PANE)).rowsBetween(Window.unboundedPreceding, 0)
    running = panes.select(
        *names, PANE, "_tl_low",
        F.coalesce(F.lag(PANE).over(block.orderBy(PANE)) + 1, F.col("_tl_low")).alias("_tl_from"),
        F.coalesce(F.lead(PANE).over(block.orderBy(PANE)) - 1, F.col("_tl_low") + F.lit(m - 1)).alias("_tl_to"),
        F.struct(*[F.sum(v).over(ahead).alias(v) for v in sums]).alias("_tl_head"),
        F.struct(*[F.sum(v).over(behind).alias(v) for v in sums]).alias("_tl_tail"),
    )

    def starts(low: Column, high: Column) -> Column:
        """Numbers of the windows that start at one of the panes ``low`` to ``high``."""
        first, last = low + F.pmod(-low, F.lit(stride)), high - F.pmod(high, F.lit(stride))
        found = F.sequence(int_div(first, stride), int_div(last, stride))
        return F.when(first <= last, found).otherwise(F.array().cast("array<bigint>"))

    # A window that starts here takes the tail; one that ends here, and started before, the head.
    tails = starts(F.col("_tl_from"), at)
    ends = F.least(F.col("_tl_to"), F.col("_tl_low") + F.lit(m - 2)) - F.lit(m - 1)
    heads = starts(at - F.lit(m - 1), ends)
    parts = running.select(*names, F.explode(tails).alias(WINDOW_ID), "_tl_tail.*").union(
        running.select(*names, F.explode(heads).alias(WINDOW_ID), "_tl_head.*")
    )
    whole = parts.groupBy(*names, WINDOW_ID).agg(*[F.sum(v).alias(v) for v in sums])
    return whole.select(
        *names, WINDOW_ID, F.lit(full).alias(STEP), "n", "yy",
        F.array(*[f"_tl_b{i}" for i in range(p)]).alias("b"),
        F.array(*[f"_tl_g{i}_{j}" for i, j in upper(p)]).alias("g"),
    )


def chain_input(stats: DataFrame, keys: Sequence[str], step: int, full: int) -> DataFrame:
    """The statistics in the shape of the count-window chain."""
    kind = stats.schema["window_start"].dataType.simpleString()
    return stats.select(
        *[f"`{k}`" for k in keys],
        window_number(F.col("window_start"), step, kind).alias(WINDOW_ID),
        F.lit(full).alias(STEP),
        "n", "yy", "b", "g",
    )


def window_bounds(models: DataFrame, step: int, length: int, ts_type: str) -> DataFrame:
    """Replace the window number by the window's start and end."""
    start = F.col(WINDOW_ID) * F.lit(step)
    kept = [c for c in models.columns if c != WINDOW_ID]
    return models.select(
        _from_micros(start, ts_type).alias("window_start"),
        _from_micros(start + F.lit(length), ts_type).alias("window_end"),
        *kept,
    )
