"""Event-time windows over a feed.

Of a regression Spark keeps the sums of open windows and closes them, and the chain trains.
Clusters need the rows themselves, so these are kept until their last window has closed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.config import KMeansOptions, LinRegOptions
from tideline.operators.linreg import beta_columns
from tideline.operators.time_windows import kmeans_time_windows
from tideline.plans.arrival import as_names
from tideline.plans.count_windows import WINDOW_ID
from tideline.plans.rows import as_columns, check_numeric, missing
from tideline.plans.sgd_chain import chain_models
from tideline.plans.time_stats import (
    as_instant,
    chain_input,
    checked_time,
    duration_micros,
    time_stats,
    window_bounds,
)
from tideline.scratch import delete_path, materialise, scratch_scope
from tideline.feeds.runner import carried_over, last_of, read_version, state_version


def run_time_windows(
    stream: DataFrame,
    ts: str,
    y: str | Column,
    xs: Sequence[str | Column],
    frame: str,
    sink: str | Callable[[DataFrame, int], None],
    checkpoint: str,
    delay: str = "0 seconds",
    slide: str | None = None,
    partition_by: str | Sequence[str] | None = None,
    options: LinRegOptions = LinRegOptions(),
    on_null: str = "error",
    fmt: str = "parquet",
    trigger: dict | None = None,
):
    """Train on each event-time window once the watermark has passed it.

    Rows more than ``delay`` behind the latest time seen are late, and dropped
    when their window has closed. With ``on_null="drop"`` a row without values still
    shows that time has passed, so such a row closes the last windows of a feed.
    """
    if options.mini_batch_fraction < 1:
        raise ValueError("time windows train on all their rows: mini_batch_fraction must be 1")
    spark = stream.sparkSession
    keys = as_names(partition_by)
    features = as_columns([y]) + as_columns(xs)
    p = len(features) - 1
    check_numeric(stream, features)
    stream = checked_time(stream, ts, on_null)
    kind = stream.schema[ts].dataType.simpleString()
    if not isinstance(stream.schema[ts].dataType, T.TimestampType):
        # Watermarks need a timestamp with a time zone.
        stream = stream.withColumn(ts, as_instant(F.col(f"`{ts}`"), kind))
    length = duration_micros(spark, frame)
    step = duration_micros(spark, slide) if slide else length
    stream = stream.withWatermark(ts, delay)
    if on_null == "drop":
        # The condition names the time, or it would be moved before the watermark.
        stream = stream.where(F.when(F.col(f"`{ts}`").isNotNull(), ~missing(features)).otherwise(False))
    closed = time_stats(stream, ts, keys, features, frame, slide, on_null)

    def advance(micro: DataFrame, batch_id: int) -> None:
        session = micro.sparkSession
        with scratch_scope(session):
            stats = materialise(chain_input(micro, keys, step, options.num_iterations + 1), "time")
            low, high, most = stats.agg(
                F.min(WINDOW_ID), F.max(WINDOW_ID), F.count("*")
            ).first()
            state = read_version(session, checkpoint, batch_id - 1, "model") if batch_id else None
            longest = 0 if low is None else high - low + 1
            models = materialise(
                chain_models(stats, keys, p, options, state, longest, most), "models"
            )
            output = window_bounds(models, step, length, kind).select(
                *[f"`{k}`" for k in keys], "window_start", "window_end", "n", *beta_columns(p)
            )
            if callable(sink):
                sink(output, batch_id)
            else:
                output.write.mode("overwrite").format(fmt).save(
                    f"{sink.rstrip('/')}/batch_id={batch_id}"
                )
            model = last_of(models, keys, F.col("weights").alias("w"))
            if state is not None:
                model = carried_over(state, model, keys)
            model.write.mode("overwrite").parquet(
                f"{state_version(checkpoint, batch_id)}/model"
            )
        if batch_id > 1:
            delete_path(session, state_version(checkpoint, batch_id - 2))

    return (
        closed.writeStream.outputMode("append")
        .foreachBatch(advance)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/query")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_time_clusters(
    stream: DataFrame,
    ts: str,
    features: Sequence[str | Column],
    frame: str,
    sink: str | Callable[[DataFrame, int], None],
    checkpoint: str,
    delay: str = "0 seconds",
    slide: str | None = None,
    partition_by: str | Sequence[str] | None = None,
    options: KMeansOptions = KMeansOptions(),
    on_null: str = "error",
    fmt: str = "parquet",
    trigger: dict | None = None,
):
    """Cluster each event-time window of a feed once the latest time is ``delay`` past its end.

    Windows are those of ``kmeans_time_windows``; with ``init="first_k"`` the results are the
    same (other starts draw by the number of a row, which a feed does not know). The rows
    of open windows are kept, in a version for each micro-batch, so that a replay repeats its
    result. Rows whose windows have all closed are late; they are counted (``late_rows``) and
    take no part. With ``on_null="drop"`` a row without values still shows that time has passed.
    """
    if options.update != "replace":
        raise ValueError("time windows of a feed are clustered each for itself: update='replace'")
    spark, given = stream.sparkSession, as_columns(features)
    check_numeric(stream, given)
    length = duration_micros(spark, frame)
    step = duration_micros(spark, slide) if slide else length
    wait = duration_micros(spark, delay)
    kind = stream.schema[ts].dataType.simpleString()
    stream = checked_time(stream, ts, on_null)
    micros = F.unix_micros(as_instant(F.col(f"`{ts}`"), kind))
    # End of the last window that holds a row.
    last = micros - F.pmod(micros, F.lit(step)) + F.lit(length)

    def advance(micro: DataFrame, batch_id: int) -> None:
        session = micro.sparkSession
        with scratch_scope(session):
            before = read_version(session, checkpoint, batch_id - 1, "passed") if batch_id else None
            passed = before.first()["passed"] if before is not None else None
            rows = materialise(micro, "rows")
            late = 0 if passed is None else rows.where(last <= F.lit(passed)).count()
            latest = rows.agg(F.max(micros)).first()[0]
            now = max((t for t in (passed, None if latest is None else latest - wait) if t is not None), default=None)
            if on_null == "drop":
                rows = rows.where(F.when(F.col(f"`{ts}`").isNotNull(), ~missing(given)).otherwise(False))
            if passed is not None:
                rows = rows.where(last > F.lit(passed))
                rows = read_version(session, checkpoint, batch_id - 1, "open").unionByName(rows)
            rows = materialise(rows, "open")
            models = kmeans_time_windows(
                rows, ts, features, frame, slide, partition_by=partition_by, options=options, on_null=on_null
            )
            end = F.unix_micros(as_instant(F.col("window_end"), kind))
            closed = F.lit(False) if now is None else end <= F.lit(now)
            if passed is not None:
                closed = closed & (end > F.lit(passed))
            output = models.where(closed)
            if callable(sink):
                sink(output, batch_id)
            else:
                output.write.mode("overwrite").format(fmt).save(f"{sink.rstrip('/')}/batch_id={batch_id}")
            path = state_version(checkpoint, batch_id)
            still = rows if now is None else rows.where(last > F.lit(now))
            still.write.mode("overwrite").parquet(f"{path}/open")
            session.range(1).select(F.lit(now).cast("long").alias("passed")).write.mode("overwrite").parquet(
                f"{path}/passed"
            )
            session.range(1).select(F.lit(late).cast("long").alias("late")).write.mode("overwrite").parquet(
                f"{checkpoint.rstrip('/')}/metrics/batch_id={batch_id}"
            )
        if batch_id > 1:
            delete_path(session, state_version(checkpoint, batch_id - 2))

    return (
        stream.writeStream.foreachBatch(advance)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/query")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
