"""Registered queries, their expected results, and the flagship query."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles as O  # noqa: E402
from tideline.config import KMeansOptions, LinRegOptions, MicroClusterOptions  # noqa: E402
from tideline.functions import format_center  # noqa: E402
from tideline.operators import (  # noqa: E402
    assign_clusters,
    cluster_weights,
    eval_split,
    held_out_ssq,
    horizon_clusters,
    kmeans_held_out,
    kmeans_models,
    kmeans_time_windows,
    limit_rows,
    linreg_models,
    linreg_prequential,
    linreg_time_windows,
    micro_clusters,
    microcluster_models,
    score,
    score_as_of,
    stream_kmeans,
    stream_kmeans_call,
    stream_linreg,
    stream_linreg_call,
    stream_microcluster,
    stream_microcluster_call,
)
from tideline.plans.arrival import arrival_index  # noqa: E402
from tideline.plans.count_windows import CountWindows, int_div  # noqa: E402
from tideline.plans.gram import LABEL, feature, gram_stats  # noqa: E402
from tideline.plans.rows import array_elements  # noqa: E402
from tideline.scratch import scratch_path  # noqa: E402
from tideline.sources import read_csv_rows, stream_table, write_rows  # noqa: E402
from tideline.feeds import (  # noqa: E402
    KMeansStream,
    LinRegStream,
    MicroClusterStream,
    run_keyed_stream,
    run_stream,
    run_time_clusters,
    run_time_windows,
)

try:
    from tideline.llm import queries as llm_queries
except ImportError:  # the text operators are an optional part
    llm_queries = None

LINE_KEY = O.LINE_KEY
SIZE, STEPS, RATE = 1000, 20, 1e-4
CAP = 5000


def _line(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(*LINE_KEY, *columns)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )


def _points():
    return ["l_quantity", F.col("l_extendedprice") / 1000]


def _betas(df: DataFrame, p: int, digits: int = 2) -> DataFrame:
    """Results rounded to the digits that do not depend on the order of sums."""
    out = df.withColumn("stderr", F.round("stderr", digits))
    for i in range(p + 1):
        out = out.withColumn(f"beta{i}", F.round(f"beta{i}", 6))
    return out


def _numbers(df: DataFrame, k: int, dims: int) -> DataFrame:
    """Centre strings parsed back to rounded numbers."""
    out = df.withColumn("stderr", F.round("stderr", 4))
    for i in range(k):
        parts = F.split(f"center{i}", ",")
        for j in range(dims):
            out = out.withColumn(f"c{i}_{j}", F.round(F.get(parts, F.lit(j)).cast("double"), 6))
    return out.drop(*[f"center{i}" for i in range(k)])


def linreg_tumbling(spark, sf):
    options = LinRegOptions(batch_size=SIZE, num_iterations=STEPS, step_size=RATE)
    df = stream_linreg(
        _line(spark, sf, "l_quantity", "l_discount"),
        "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY, options=options,
    )
    return _betas(df, 2, 0)


def linreg_call(spark, sf):
    """The positional call: seven constants, label, features."""
    df = stream_linreg_call(
        _line(spark, sf, "l_quantity", "l_discount", "l_tax"),
        0, 1, SIZE, STEPS, RATE, 1.0, 0.95,
        "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        order_by=LINE_KEY,
    )
    return _betas(df, 3, 0)


def linreg_defaults(spark, sf):
    """The bare call: every argument is data, so windows of 10 rows."""
    df = stream_linreg_call(
        _line(spark, sf, "l_quantity"), "l_extendedprice", "l_quantity", order_by=LINE_KEY
    )
    return _betas(df, 1, -1)


def linreg_five_columns(spark, sf):
    """A label and four features, one of them from a joined table."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_retailprice")
    rows = _line(spark, sf, "l_quantity", "l_discount", "l_tax").join(
        part, F.col("l_partkey") == F.col("p_partkey")
    ).drop("p_partkey")
    options = LinRegOptions(batch_size=SIZE, num_iterations=STEPS, step_size=1e-7)
    df = stream_linreg(
        rows, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "p_retailprice"],
        LINE_KEY, options=options,
    )
    return _betas(df, 4, 0)


def linreg_sliding(spark, sf):
    options = LinRegOptions(
        learn_type=1, window_shift=500, batch_size=2000, num_iterations=STEPS, step_size=RATE
    )
    df = stream_linreg(
        _line(spark, sf, "l_quantity", "l_discount"),
        "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY, options=options,
    )
    return _betas(df, 2, 0)


def linreg_per_key(spark, sf):
    """An independent model per event type."""
    options = LinRegOptions(batch_size=100, num_iterations=STEPS, step_size=1e-3)
    rows = _events(spark, sf).withColumn("hour", F.hour("ts").cast("double")).drop("ts")
    df = stream_linreg(
        rows, "value", ["hour", F.lit(1.0)], "event_id", "event_type", options=options
    )
    return _betas(df, 2)


def linreg_sliding_per_key(spark, sf):
    options = LinRegOptions(
        learn_type=1, window_shift=30, batch_size=120, num_iterations=10, step_size=1e-3
    )
    rows = _events(spark, sf).withColumn("hour", F.hour("ts").cast("double")).drop("ts")
    df = stream_linreg(
        rows, "value", ["hour", F.lit(1.0)], "event_id", "event_type", options=options
    )
    return _betas(df, 2)


def linreg_model_history(spark, sf):
    options = LinRegOptions(batch_size=SIZE, num_iterations=STEPS, step_size=RATE)
    models = linreg_models(
        _line(spark, sf, "l_quantity"), "l_extendedprice", ["l_quantity"], LINE_KEY,
        options=options,
    )
    return models.select(
        "window_id", "n", F.round("stderr", 0).alias("stderr"), "intercept",
        F.round(F.get("weights", F.lit(0)), 6).alias("weight"), "iterations",
    )


def linreg_mini_batch(spark, sf):
    """Each step trains on a hash sample of half the window."""
    options = LinRegOptions(
        batch_size=SIZE, num_iterations=STEPS, step_size=RATE, mini_batch_fraction=0.5
    )
    df = stream_linreg(
        _line(spark, sf, "l_quantity", "l_discount"),
        "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY, options=options,
    )
    return _betas(df, 2, 0)


def linreg_gram_tumbling(spark, sf):
    """The per-window sums that training reads."""
    rows = arrival_index(_line(spark, sf, "l_quantity", "l_discount"), LINE_KEY).rows
    numeric = rows.select(
        "_tl_rn", F.col("l_extendedprice").alias(LABEL),
        F.col("l_quantity").alias(feature(0)), F.col("l_discount").alias(feature(1)),
    )
    stats = gram_stats(numeric, [], 2, CountWindows(SIZE, SIZE), STEPS, 1.0, 42)
    return stats.select(
        "window_id",
        F.col("n").cast("long").alias("n"),
        F.round(F.col("yy") / 1e6, 3).alias("yy"),
        *[F.round(F.get("b", F.lit(i)), 3).alias(f"b{i + 1}") for i in range(2)],
        *[F.round(F.get("g", F.lit(i)), 4).alias(c) for i, c in enumerate(["g11", "g12", "g22"])],
    )


def linreg_score(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(*LINE_KEY, "l_quantity", "l_discount")
    return score(rows, ["l_quantity", "l_discount"], [1500.5, 20.25], 7.0).withColumn(
        "prediction", F.round("prediction", 6)
    )


def linreg_time_window(spark, sf):
    options = LinRegOptions(num_iterations=STEPS, step_size=1e-3)
    rows = _events(spark, sf)
    df = linreg_time_windows(
        rows, "ts", "value", [F.hour("ts").cast("double"), F.lit(1.0)], "1 day", options=options
    )
    return _betas(df, 2)


def linreg_time_window_sliding(spark, sf):
    options = LinRegOptions(num_iterations=STEPS, step_size=1e-3)
    df = linreg_time_windows(
        _events(spark, sf), "ts", "value", [F.hour("ts").cast("double"), F.lit(1.0)],
        "2 days", "12 hours", "event_type", options=options,
    )
    return _betas(df, 2)


def kmeans_tumbling_first_k(spark, sf):
    options = KMeansOptions(
        batch_size=SIZE, num_iterations=5, num_clusters=2, init="first_k", epsilon=0.0
    )
    df = stream_kmeans(_line(spark, sf, "l_quantity"), _points(), LINE_KEY, options=options)
    return _numbers(df, 2, 2)


def kmeans_sliding(spark, sf):
    options = KMeansOptions(
        learn_type=1, window_shift=500, batch_size=1000, num_iterations=4, num_clusters=3,
        init="first_k", epsilon=0.0,
    )
    df = stream_kmeans(_line(spark, sf, "l_quantity"), _points(), LINE_KEY, options=options)
    return _numbers(df, 3, 2)


def kmeans_per_key(spark, sf):
    options = KMeansOptions(
        batch_size=150, num_iterations=4, num_clusters=3, init="first_k", epsilon=0.0
    )
    rows = _events(spark, sf).withColumn("hour", F.hour("ts").cast("double")).drop("ts")
    df = stream_kmeans(rows, ["value", "hour"], "event_id", "event_type", options=options)
    return _numbers(df, 3, 2)


def kmeans_large_windows(spark, sf):
    """Windows solved by aggregations over all of them, as for windows of any length."""
    from tideline.operators.kmeans import center_columns, fit_kmeans
    from tideline.plans.rows import attach_models

    options = KMeansOptions(
        batch_size=5000, num_iterations=3, num_clusters=2, init="first_k", epsilon=0.0
    )
    fit = fit_kmeans(
        _line(spark, sf, "l_quantity"), _points(), LINE_KEY, options=options, gather=0
    )
    df = attach_models(fit.rows, fit.models, fit.keys, fit.windows, center_columns(2))
    return _numbers(df, 2, 2)


def kmeans_decay(spark, sf):
    options = KMeansOptions(
        batch_size=SIZE, num_iterations=3, num_clusters=2, init="first_k", epsilon=0.0,
        update="decay", alpha=0.5,
    )
    models = kmeans_models(_line(spark, sf, "l_quantity"), _points(), LINE_KEY, options=options)
    each = F.posexplode(F.arrays_zip("centers", "weights")).alias("cluster_id", "c")
    return models.select("window_id", each).select(
        "window_id",
        F.col("cluster_id").cast("long").alias("cluster_id"),
        F.round("c.weights", 6).alias("weight"),
        *[F.round(F.get("c.centers", F.lit(j)), 6).alias(f"center_{j}") for j in range(2)],
    )


def kmeans_call(spark, sf):
    """The positional call, with the default start; its centres depend on a hash."""
    return stream_kmeans_call(
        _line(spark, sf, "l_quantity"),
        0, 0, SIZE, 10, 2, 1, 0.95, "l_quantity", F.col("l_extendedprice") / 1000,
        order_by=LINE_KEY,
    )


def _sides():
    """Two features that split the rows into two far groups, by the parity of the line number."""
    return [F.col("l_linenumber") % 2 * 1000 + F.col("l_quantity"), F.col("l_extendedprice") / 1000]


def _low_high(df):
    """Two centres in the order of their first coordinate: their ids depend on a random start."""
    out = _numbers(df, 2, 2)
    low = F.col("c0_0") < F.col("c1_0")
    for j in range(2):
        a, b = F.col(f"c0_{j}"), F.col(f"c1_{j}")
        out = out.withColumns({f"low_{j}": F.when(low, a).otherwise(b), f"high_{j}": F.when(low, b).otherwise(a)})
    return out.drop("c0_0", "c0_1", "c1_0", "c1_1")


def kmeans_default_start(spark, sf):
    """The positional call with the default start: it finds two far groups in every window."""
    df = stream_kmeans_call(
        _line(spark, sf, "l_quantity"), 0, 0, SIZE, 10, 2, 1, 0.95, *_sides(), order_by=LINE_KEY
    )
    return _low_high(df).withColumn("stderr", F.round("stderr", 2))


def kmeans_default_start_large(spark, sf):
    """The same by aggregations over all windows at once, as for windows of any length."""
    from tideline.operators.kmeans import center_columns, fit_kmeans
    from tideline.plans.rows import attach_models

    options = KMeansOptions(batch_size=5000, num_iterations=10, num_clusters=2)
    fit = fit_kmeans(_line(spark, sf, "l_quantity"), _sides(), LINE_KEY, options=options, gather=0)
    df = attach_models(fit.rows, fit.models, fit.keys, fit.windows, center_columns(2))
    return _low_high(df).withColumn("stderr", F.round("stderr", 2))


def microcluster_two_groups(spark, sf):
    """Two macro centres of the default 100 kernels, with its random start: the two far groups so far."""
    options = MicroClusterOptions(batch_size=SIZE, num_clusters=2, num_iterations=10, horizon=10**12)
    df = stream_microcluster(_line(spark, sf, "l_quantity"), _sides(), LINE_KEY, options=options)
    return _low_high(df)


def kmeans_few_points(spark, sf):
    """More clusters than different points: the centres that are missing are null."""
    options = KMeansOptions(batch_size=SIZE, num_iterations=5, num_clusters=3, init="first_k")
    side = [F.col("l_linenumber") % 2]
    return _numbers(stream_kmeans(_line(spark, sf, "l_quantity"), side, LINE_KEY, options=options), 3, 1)


def kmeans_embeddings(spark, sf):
    options = KMeansOptions(batch_size=250, num_iterations=10, num_clusters=10)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return stream_kmeans(rows, array_elements("embedding", 64), "vec_id", options=options)


CENTERS = [[10.0, 20.0], [25.5, 40.0], [40.0, 70.25]]


def kmeans_assign(spark, sf):
    df = assign_clusters(_line(spark, sf, "l_quantity"), _points(), CENTERS)
    return df.withColumn("distance_sq", F.round("distance_sq", 6))


def kmeans_weights(spark, sf):
    df = cluster_weights(_line(spark, sf, "l_quantity"), _points(), CENTERS)
    return df.select("cluster_id", "weight")


def kmeans_wssse(spark, sf):
    df = cluster_weights(_line(spark, sf, "l_quantity"), _points(), CENTERS)
    return df.agg(F.round(F.sum("wssse"), 3).alias("wssse"))


def kmeans_time_window(spark, sf):
    options = KMeansOptions(num_iterations=3, num_clusters=2, init="first_k", epsilon=0.0)
    rows = _events(spark, sf).withColumn("hour", F.hour("ts").cast("double"))
    df = kmeans_time_windows(rows, "ts", ["value", "hour"], "1 day", options=options)
    return _numbers(df, 2, 2)


def microcluster_cf(spark, sf):
    """Kernels are additive: their sums are the sums over the rows."""
    options = MicroClusterOptions(batch_size=SIZE, num_clusters=2)
    cf = micro_clusters(_line(spark, sf, "l_quantity"), _points(), LINE_KEY, options=options)
    return cf.groupBy("window_id").agg(
        F.sum("n").cast("long").alias("n"),
        F.sum("lst").cast("long").alias("lst"),
        *[F.round(F.sum(F.get("ls", F.lit(j))), 6).alias(f"ls{j}") for j in range(2)],
        *[F.round(F.sum(F.get("ss", F.lit(j))), 3).alias(f"ss{j}") for j in range(2)],
    )


def microcluster_one_center(spark, sf):
    """With one cluster and an endless horizon the centre is the running mean."""
    options = MicroClusterOptions(
        batch_size=SIZE, num_clusters=1, num_iterations=1, horizon=10**12
    )
    df = stream_microcluster(
        _line(spark, sf, "l_quantity"), _points(), LINE_KEY, options=options, with_ssq=True
    )
    return _numbers(df, 1, 2).withColumn("ssq", F.round(F.col("ssq"), 1))


def microcluster_centers(spark, sf):
    """The documented example call: k = 2, batch 1000, 10 iterations."""
    return stream_microcluster_call(
        _line(spark, sf, "l_quantity"),
        0, 0, SIZE, 10, 2, 1, 0.95, "l_quantity", F.col("l_extendedprice") / 1000,
        order_by=LINE_KEY,
    )


def microcluster_closing_rows(spark, sf):
    """Which rows carry a result, and the constant error column."""
    df = stream_microcluster_call(
        _events(spark, sf).drop("ts"), 0, 0, 100, 10, 2, 1, 0.95, "value",
        order_by="event_id", partition_by="event_type",
    )
    return df.drop("center0", "center1")


def microcluster_embeddings(spark, sf):
    options = MicroClusterOptions(batch_size=250, num_clusters=10, num_iterations=10)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return microcluster_models(
        rows, array_elements("embedding", 64), "vec_id", options=options
    ).select("window_id", "n", "ssq", "centers")


def window_index(spark, sf):
    """Arrival index, window and closing mark of every row."""
    rows = arrival_index(_line(spark, sf), LINE_KEY, name="rn").rows
    windows = CountWindows(SIZE, SIZE)
    return rows.withColumn("batch_id", int_div(F.col("rn"), SIZE)).withColumn(
        "closes", windows.closes(F.col("rn"))
    )


def window_index_per_key(spark, sf):
    rows = arrival_index(_events(spark, sf).drop("ts"), "event_id", "event_type", name="rn").rows
    return rows.withColumn("batch_id", int_div(F.col("rn"), 100))


def instance_limit(spark, sf):
    """Rows up to a cap on what the learner is fed."""
    rows = arrival_index(_events(spark, sf).drop("ts"), "event_id", name="rn").rows
    return limit_rows(rows, CAP, "rn")


def evaluation_split(spark, sf):
    return eval_split(_line(spark, sf, "l_quantity"), LINE_KEY, 0.5)


def evaluation_ssq(spark, sf):
    out = held_out_ssq(_line(spark, sf, "l_quantity"), _points(), CENTERS, LINE_KEY, 0.5)
    return out.withColumn("ssq", F.round("ssq", 3))


def center_text(spark, sf):
    """Centre text of every row's point, read back as numbers."""
    rows = _line(spark, sf, "l_quantity")
    text = format_center(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000))
    parts = F.split(text, ",")
    return rows.select(
        *LINE_KEY,
        F.size(parts).cast("long").alias("parts"),
        F.round(parts[0].cast("double"), 6).alias("p0"),
        F.round(parts[1].cast("double"), 6).alias("p1"),
    )


def csv_round_trip(spark, sf):
    """Rows written as headerless CSV, read back, and used for training."""
    path = scratch_path(spark, "csv")
    rows = _events(spark, sf).select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    write_rows(rows, path, "csv")
    back = read_csv_rows(spark, path, rows.schema)
    options = LinRegOptions(batch_size=500, num_iterations=STEPS, step_size=1e-3)
    return _betas(stream_linreg(back, "value", ["hour", F.lit(1.0)], "event_id", options=options), 2)


PARTS = 3


def _replay(spark, sf, table, op, columns, key, start=run_stream, **more):
    """Run an operator over a table that arrives in three micro-batches, and read its sink.

    The cuts lie at thirds of the range of ``key``, inside windows. Each third is written by as
    many tasks as Spark takes, and the feed is started anew for it.
    """
    rows = spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    part = F.least(F.floor((F.col(key) - low) * PARTS / (high - low + 1)), F.lit(PARTS - 1))
    folder, sink, state = (scratch_path(spark, n) for n in ("pieces", "sink", "feed"))
    for i in range(PARTS):
        rows.where(part == i).write.mode("append").parquet(folder)
        start(op, stream_table(spark, folder, rows.schema), sink, state, **more).awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


def feed_linreg(spark, sf):
    op = LinRegStream(
        "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY,
        options=LinRegOptions(batch_size=SIZE, num_iterations=STEPS, step_size=RATE),
    )
    columns = [*LINE_KEY, "l_quantity", "l_discount"]
    return _betas(_replay(spark, sf, "lineitem", op, columns, "l_orderkey"), 2, 0)


def feed_restart(spark, sf):
    """The regression over a feed whose parts arrive with a few files a micro-batch, and restarts."""
    op = LinRegStream(
        "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY,
        options=LinRegOptions(batch_size=SIZE, num_iterations=STEPS, step_size=RATE),
    )
    columns = [*LINE_KEY, "l_quantity", "l_discount"]
    return _betas(_replay(spark, sf, "lineitem", op, columns, "l_orderkey"), 2, 0)


def feed_history(spark, sf):
    """The models of a feed, read back from the CSV files that it writes beside its rows."""
    op = LinRegStream(
        "l_extendedprice", ["l_quantity"], LINE_KEY,
        options=LinRegOptions(batch_size=SIZE, num_iterations=STEPS, step_size=RATE),
    )
    folder = scratch_path(spark, "history")
    _replay(spark, sf, "lineitem", op, [*LINE_KEY, "l_quantity"], "l_orderkey", history_to=folder)
    schema = "window_id long, n long, stderr double, intercept double, weights string, iterations int"
    found = spark.read.schema(schema).option("header", True).csv(f"{folder}/batch_id=*")
    weight = F.get(F.from_json("weights", "array<double>"), F.lit(0))
    return found.select(
        "window_id", "n", F.round("stderr", 0).alias("stderr"), "intercept",
        F.round(weight, 6).alias("weight"), "iterations",
    )


def feed_keyed(spark, sf):
    """A model for each event type, with the state of the types in the state store."""
    op = LinRegStream(
        "value", [F.col("user_id") % 24, F.lit(1.0)], "event_id", "event_type",
        options=LinRegOptions(batch_size=100, num_iterations=STEPS, step_size=1e-3),
    )
    columns = ["event_id", "user_id", "event_type", "value"]
    return _betas(_replay(spark, sf, "events", op, columns, "event_id", run_keyed_stream), 2)


def feed_keyed_kmeans(spark, sf):
    """Clusters for each event type, with the state of the types in the state store."""
    op = KMeansStream(
        [F.col("value") / 3, F.col("user_id") % 24], "event_id", "event_type",
        options=KMeansOptions(batch_size=120, num_iterations=4, num_clusters=3, init="first_k", epsilon=0.0),
    )
    columns = ["event_id", "user_id", "event_type", "value"]
    return _numbers(_replay(spark, sf, "events", op, columns, "event_id", run_keyed_stream), 3, 2)


def linreg_prequential_lines(spark, sf):
    """Each row scored by the model of the last window that closed before it."""
    options = LinRegOptions(batch_size=SIZE, num_iterations=STEPS, step_size=RATE)
    df = linreg_prequential(
        _line(spark, sf, "l_quantity", "l_discount"),
        "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY, options=options,
    )
    return df.withColumn("prediction", F.round("prediction", 2))


def linreg_time_as_of(spark, sf):
    """Each event scored by the model of its type whose time window was the last to end by then."""
    rows = _events(spark, sf).withColumn("hour", F.hour("ts").cast("double"))
    xs = ["hour", F.lit(1.0)]
    options = LinRegOptions(num_iterations=STEPS, step_size=1e-3)
    models = linreg_time_windows(rows, "ts", "value", xs, "1 day", partition_by="event_type", options=options)
    df = score_as_of(rows, xs, models, "ts", partition_by="event_type")
    return df.withColumn("prediction", F.round("prediction", 4))


def kmeans_held_out_windows(spark, sf):
    """Half of the rows of each window teach its centres; the error on both halves."""
    options = KMeansOptions(batch_size=SIZE, num_iterations=3, num_clusters=2, init="first_k", epsilon=0.0)
    df = kmeans_held_out(_line(spark, sf, "l_quantity"), _points(), LINE_KEY, 0.5, options=options)
    return df.select(
        "window_id", "n_train", F.round("ssq_train", 3).alias("ssq_train"),
        "n_held", F.round("ssq_held", 3).alias("ssq_held"),
    )


def microcluster_horizon(spark, sf):
    """Kernels of the last 2,500 rows after every period: their sums are the sums of the rows."""
    options = MicroClusterOptions(batch_size=250, num_clusters=2, num_iterations=2, horizon=10**12)
    df = horizon_clusters(_line(spark, sf, "l_quantity"), _points(), LINE_KEY, 2500, options=options)
    width = 7
    cut = F.transform(
        F.sequence(F.lit(0), (F.size("kernels") / width - 1).cast("int")),
        lambda i: F.slice("kernels", i * width + 1, F.lit(width)),
    )
    each = df.select("window_id", "since", "n", F.explode(cut).alias("k"))
    return each.groupBy("window_id", "since", "n").agg(
        F.round(F.sum(F.get("k", F.lit(3))), 2).alias("ls0"), F.round(F.sum(F.get("k", F.lit(4))), 2).alias("ls1"),
        F.round(F.sum(F.get("k", F.lit(5))), 0).alias("ss0"), F.round(F.sum(F.get("k", F.lit(6))), 0).alias("ss1"),
    )


def microcluster_tree(spark, sf):
    """Kernels combined as a tree over the periods: their sums are those of all rows so far."""
    options = MicroClusterOptions(batch_size=SIZE, num_clusters=1, num_iterations=1, mode="tree", block_rows=400)
    df = stream_microcluster(
        _line(spark, sf, "l_quantity"), _points(), LINE_KEY, options=options, with_ssq=True
    )
    return _numbers(df, 1, 2).withColumn("ssq", F.round(F.col("ssq"), 1))


def feed_kmeans(spark, sf):
    op = KMeansStream(
        _points(), LINE_KEY,
        options=KMeansOptions(
            batch_size=SIZE, num_iterations=5, num_clusters=2, init="first_k", epsilon=0.0
        ),
    )
    columns = [*LINE_KEY, "l_quantity"]
    return _numbers(_replay(spark, sf, "lineitem", op, columns, "l_orderkey"), 2, 2)


LONG = MicroClusterOptions(
    batch_size=1, num_clusters=2, num_iterations=1, max_kernels=2, horizon=10**12
)


def _two_centers(df):
    """The two centres, smaller first: which is which depends on a random start."""
    found = [F.col(f"center{i}").cast("double") for i in range(2)]
    return df.select(
        "event_id", "user_id", "event_type", "value",
        F.round(F.least(*found), 6).alias("low"),
        F.round(F.when(found[1].isNotNull(), F.greatest(*found)), 6).alias("high"),
    )


def microcluster_long(spark, sf):
    """A period for every row, so the walk of each key is as long as the key."""
    rows = _events(spark, sf).drop("ts")
    return _two_centers(
        stream_microcluster(rows, ["value"], "event_id", "event_type", options=LONG)
    )


def feed_microcluster(spark, sf):
    op = MicroClusterStream(["value"], "event_id", "event_type", options=LONG)
    columns = ["event_id", "user_id", "event_type", "value"]
    return _two_centers(_replay(spark, sf, "events", op, columns, "event_id"))


def linreg_over_kmeans(spark, sf):
    """One operator over the result of another: errors of k-means windows from a centre."""
    rows = kmeans_tumbling_first_k(spark, sf)
    options = LinRegOptions(batch_size=10, num_iterations=STEPS, step_size=1e-4)
    return _betas(stream_linreg(rows, "stderr", ["c0_0", "c0_1"], LINE_KEY, options=options), 2, -1)


def feed_time_window(spark, sf):
    """Event-time windows of a feed; a last row without a value closes the last ones."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "value")
    folder, sink, state = (scratch_path(spark, n) for n in ("pieces", "sink", "feed"))
    end = rows.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts"))
    end = end.select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("double").alias("value")
    )
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    first = F.col("event_id") <= middle
    for part in (rows.where(first), rows.where(~first), end):
        part.write.mode("append").parquet(folder)
        feed = stream_table(spark, folder, rows.schema)
        run_time_windows(
            feed.withColumn("hour", F.hour("ts").cast("double")), "ts", "value",
            ["hour", F.lit(1.0)], "1 day", sink, state,
            options=LinRegOptions(num_iterations=STEPS, step_size=1e-3), on_null="drop",
        ).awaitTermination()
    return _betas(spark.read.parquet(sink).drop("batch_id"), 2)


def feed_kmeans_time(spark, sf):
    """Clusters of the event-time windows of a feed; a row without a value closes the last ones."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "value")
    folder, sink, state = (scratch_path(spark, n) for n in ("pieces", "sink", "feed"))
    end = rows.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts"))
    end = end.select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("double").alias("value")
    )
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    first = F.col("event_id") <= middle
    options = KMeansOptions(num_iterations=3, num_clusters=2, init="first_k", epsilon=0.0)
    for part in (rows.where(first), rows.where(~first), end):
        part.write.mode("append").parquet(folder)
        feed = stream_table(spark, folder, rows.schema).withColumn("hour", F.hour("ts").cast("double"))
        run_time_clusters(
            feed, "ts", ["value", "hour"], "1 day", sink, state, options=options, on_null="drop"
        ).awaitTermination()
    return _numbers(spark.read.parquet(sink).drop("batch_id"), 2, 2)


def entry(spark: SparkSession) -> DataFrame:
    """Tumbling-window regression on the smallest tables."""
    return linreg_tumbling(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (session, folder of the tables)."""
    found = {
        f.__name__: f
        for f in (
            linreg_tumbling, linreg_call, linreg_defaults, linreg_five_columns, linreg_sliding,
            linreg_per_key, linreg_sliding_per_key, linreg_model_history, linreg_mini_batch,
            linreg_gram_tumbling, linreg_score, linreg_time_window, linreg_time_window_sliding,
            kmeans_tumbling_first_k, kmeans_sliding, kmeans_per_key, kmeans_large_windows,
            kmeans_decay, kmeans_default_start, kmeans_default_start_large, microcluster_two_groups,
            kmeans_few_points, kmeans_call, kmeans_embeddings, kmeans_assign, kmeans_weights,
            kmeans_wssse, kmeans_time_window,
            microcluster_cf, microcluster_one_center, microcluster_centers,
            microcluster_closing_rows, microcluster_embeddings,
            window_index, window_index_per_key, instance_limit, evaluation_split, evaluation_ssq,
            center_text, csv_round_trip, feed_linreg, feed_kmeans, feed_time_window,
            feed_restart, microcluster_long, feed_microcluster, linreg_over_kmeans,
            feed_history, feed_keyed, feed_keyed_kmeans, linreg_prequential_lines,
            linreg_time_as_of, kmeans_held_out_windows, microcluster_horizon, microcluster_tree,
            feed_kmeans_time,
        )
    }
    return found | (llm_queries.QUERIES if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    """Expected results, for DuckDB, of the queries that SQL can express."""
    key = ", ".join(LINE_KEY)
    line2 = "l_extendedprice AS y, l_quantity AS x1, l_discount AS x2"
    xy = "l_quantity AS x1, l_extendedprice / 1000 AS x2"
    hour = O.EVENT_HOUR
    ev = f"(SELECT event_id, user_id, event_type, value, {hour} AS hour FROM events) events"
    evy = "value AS y, hour AS x1, CAST(1 AS DOUBLE) AS x2"
    ev_kept = ["event_id", "user_id", "event_type", "value", "hour"]
    joined = (
        "(SELECT l.*, p_retailprice FROM lineitem l JOIN part ON l_partkey = p_partkey) lineitem"
    )
    near = (
        f"SELECT {key}, l_quantity, cid, dist, row_number() OVER (PARTITION BY {key}, l_quantity, dup "
        f"ORDER BY dist, cid) AS nearest FROM (SELECT l.*, c.cid, "
        f"(l_quantity - c.a) ** 2 + (l_extendedprice / 1000 - c.b) ** 2 AS dist FROM "
        f"(SELECT *, row_number() OVER () AS dup FROM lineitem) l, (VALUES "
        + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(CENTERS))
        + ") c(cid, a, b))"
    )
    out = {}
    out["linreg_tumbling"] = O.linreg(
        "lineitem", LINE_KEY, line2, [*LINE_KEY, "l_quantity", "l_discount"], 2,
        SIZE, SIZE, STEPS, RATE, digits=0,
    )
    out["feed_linreg"] = out["feed_restart"] = out["linreg_tumbling"]
    out["linreg_mini_batch"] = O.linreg_drawn(
        "lineitem", LINE_KEY, line2, [*LINE_KEY, "l_quantity", "l_discount"], 2,
        SIZE, STEPS, RATE, 0.5, 42, digits=0,
    )
    out["linreg_call"] = O.linreg(
        "lineitem", LINE_KEY, line2 + ", l_tax AS x3",
        [*LINE_KEY, "l_quantity", "l_discount", "l_tax"], 3, SIZE, SIZE, STEPS, RATE, digits=0,
    )
    out["linreg_defaults"] = O.linreg(
        "lineitem", LINE_KEY, "l_extendedprice AS y, l_quantity AS x1",
        [*LINE_KEY, "l_quantity"], 1, 10, 10, 100, 1e-8, digits=-1,
    )
    out["linreg_five_columns"] = O.linreg(
        joined, LINE_KEY, line2 + ", l_tax AS x3, p_retailprice AS x4",
        [*LINE_KEY, "l_quantity", "l_discount", "l_tax", "p_retailprice"], 4,
        SIZE, SIZE, STEPS, 1e-7, digits=0,
    )
    out["linreg_sliding"] = O.linreg(
        "lineitem", LINE_KEY, line2, [*LINE_KEY, "l_quantity", "l_discount"], 2,
        2000, 500, STEPS, RATE, digits=0,
    )
    out["linreg_per_key"] = O.linreg(
        ev, ["event_id"], evy, ev_kept, 2, 100, 100, STEPS, 1e-3, ["event_type"]
    )
    out["linreg_sliding_per_key"] = O.linreg(
        ev, ["event_id"], evy, ev_kept, 2, 120, 30, 10, 1e-3, ["event_type"]
    )
    one = "l_extendedprice AS y, l_quantity AS x1"
    out["linreg_model_history"] = (
        f"WITH RECURSIVE idx AS ({O.indexed('lineitem', LINE_KEY, one)}), "
        f"mem AS ({O.members(SIZE, SIZE)}), g AS ({O.gram(1, 'mem', (), SIZE)}), "
        f"{O.chain(1, STEPS, RATE)}, {O.trained(1)} "
        "SELECT win AS window_id, m.n AS n, round(mse, 0) AS stderr, "
        "0.0::DOUBLE AS intercept, round(m.w1, 6) AS weight, CAST(it AS INTEGER) AS iterations "
        "FROM m JOIN chain USING (win) WHERE done"
    )
    out["linreg_gram_tumbling"] = (
        f"WITH idx AS ({O.indexed('lineitem', LINE_KEY, line2)}), "
        f"mem AS ({O.members(SIZE, SIZE)}), g AS ({O.gram(2, 'mem', (), SIZE)}) "
        "SELECT win AS window_id, n, round(yy / 1e6, 3) AS yy, round(b1, 3) AS b1, round(b2, 3) AS b2, "
        "round(g1_1, 4) AS g11, round(g1_2, 4) AS g12, round(g2_2, 4) AS g22 FROM g"
    )
    out["linreg_score"] = (
        f"SELECT {key}, l_quantity, l_discount, "
        "round(l_quantity * 1500.5::DOUBLE + l_discount * 20.25::DOUBLE + 7, 6) AS prediction "
        "FROM lineitem"
    )
    day = f"SELECT *, value AS y, {hour} AS x1, CAST(1 AS DOUBLE) AS x2, "
    out["linreg_time_window"] = (
        f"WITH RECURSIVE mem AS ({day} date_diff('day', DATE '1970-01-01', ts) AS win FROM events), "
        f"raw AS ({O.gram(2, 'mem')}), "
        "lo AS (SELECT min(win) AS lo FROM raw), "
        "g AS (SELECT raw.* REPLACE (win - lo AS win) FROM raw, lo), "
        f"{O.chain(2, STEPS, 1e-3)}, {O.trained(2)} "
        "SELECT TIMESTAMP '1970-01-01' + to_days(CAST(win + lo AS INTEGER)) AS window_start, "
        "TIMESTAMP '1970-01-01' + to_days(CAST(win + lo + 1 AS INTEGER)) AS window_end, "
        f"n, {O.betas(2)} FROM m, lo"
    )
    out["linreg_time_window_sliding"] = (
        f"WITH RECURSIVE mem AS ({day} unnest([b - 3, b - 2, b - 1, b]) AS win FROM "
        "(SELECT *, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS b FROM events)), "
        f"raw AS ({O.gram(2, 'mem', ['event_type'])}), "
        "lo AS (SELECT event_type, min(win) AS lo FROM raw GROUP BY event_type), "
        "g AS (SELECT raw.* REPLACE (row_number() OVER (PARTITION BY event_type ORDER BY win) - 1 "
        "AS win), win AS at FROM raw), "
        f"{O.chain(2, STEPS, 1e-3, ['event_type'])}, {O.trained(2, ['event_type'])} "
        "SELECT event_type, TIMESTAMP '1970-01-01' + to_hours(12 * g.at) AS window_start, "
        "TIMESTAMP '1970-01-01' + to_hours(12 * g.at + 48) AS window_end, "
        f"m.n AS n, {O.betas(2)} FROM m JOIN g USING (event_type, win)"
    )
    out["kmeans_tumbling_first_k"] = O.kmeans(
        "lineitem", LINE_KEY, xy, [*LINE_KEY, "l_quantity"], 2, 2, SIZE, SIZE, 5
    )
    out["feed_kmeans"] = out["kmeans_tumbling_first_k"]
    inner = out["kmeans_tumbling_first_k"]
    out["linreg_over_kmeans"] = O.linreg(
        f"(SELECT * RENAME (stderr AS cost) FROM ({inner})) km", LINE_KEY,
        "cost AS y, c0_0 AS x1, c0_1 AS x2",
        [*LINE_KEY, "l_quantity", "c0_0", "c0_1", "c1_0", "c1_1"], 2, 10, 10, STEPS, 1e-4, digits=-1,
    )
    out["microcluster_long"] = out["feed_microcluster"] = O.two_kernels(LONG.radius_factor)
    marked = (
        f"(SELECT *, CAST('0x' || substr(md5(concat_ws('|', {key}, 42)), 1, 8) AS BIGINT) "
        "/ 4294967296.0 < 0.5 AS held_out FROM lineitem)"
    )
    out["evaluation_split"] = f"SELECT {key}, l_quantity, held_out FROM {marked}"
    out["evaluation_ssq"] = (
        "SELECT held_out, count(*) AS n, round(sum(d), 3) AS ssq FROM (SELECT held_out, least("
        + ", ".join(f"(l_quantity - {a}) ** 2 + (l_extendedprice / 1000 - {b}) ** 2" for a, b in CENTERS)
        + f") AS d FROM {marked}) GROUP BY held_out"
    )
    out["kmeans_sliding"] = O.kmeans(
        "lineitem", LINE_KEY, xy, [*LINE_KEY, "l_quantity"], 2, 3, 1000, 500, 4
    )
    out["kmeans_per_key"] = O.kmeans(
        ev, ["event_id"], "value AS x1, hour AS x2", ev_kept, 2, 3, 150, 150, 4, ["event_type"]
    )
    out["kmeans_large_windows"] = O.kmeans(
        "lineitem", LINE_KEY, xy, [*LINE_KEY, "l_quantity"], 2, 2, 5000, 5000, 3
    )
    out["kmeans_decay"] = O.kmeans_history("lineitem", LINE_KEY, xy, SIZE, 3, 0.5)
    out["kmeans_assign"] = (
        f"SELECT {key}, l_quantity, CAST(cid AS INTEGER) AS cluster_id, "
        f"round(dist, 6) AS distance_sq FROM ({near}) WHERE nearest = 1"
    )
    out["kmeans_weights"] = (
        f"SELECT CAST(cid AS INTEGER) AS cluster_id, count(*) AS weight FROM ({near}) "
        "WHERE nearest = 1 GROUP BY cid"
    )
    out["kmeans_wssse"] = f"SELECT round(sum(dist), 3) AS wssse FROM ({near}) WHERE nearest = 1"
    ev_day = f"(SELECT *, {hour} AS hour FROM events) events"
    out["kmeans_time_window"] = (
        f"WITH idx AS ({O.indexed(ev_day, ['ts'], 'value AS x1, hour AS x2')}), "
        "by_day AS (SELECT *, date_diff('day', DATE '1970-01-01', ts) AS win FROM idx), "
        + O.kmeans_steps(2, 2, 3, 1, 1).replace(
            f"alls AS ({O.members(1, 1)})", "alls AS (SELECT * FROM by_day)"
        ).replace(" HAVING count(*) = 1", "")
        + ", cost AS (SELECT win, count(*) AS n, round(sum(dist), 4) AS stderr FROM asg GROUP BY win), "
        "wide AS (SELECT win, "
        + ", ".join(
            f"round(max(CASE WHEN cid = {i} THEN x{j} END), 6) AS c{i}_{j - 1}"
            for i in range(2) for j in (1, 2)
        )
        + " FROM c3 GROUP BY win) SELECT "
        "TIMESTAMP '1970-01-01' + to_days(CAST(win AS INTEGER)) AS window_start, "
        "TIMESTAMP '1970-01-01' + to_days(CAST(win + 1 AS INTEGER)) AS window_end, "
        "n, stderr, wide.* EXCLUDE (win) FROM cost JOIN wide USING (win)"
    )
    sides = "l_linenumber % 2 * 1000 + l_quantity AS x1, l_extendedprice / 1000 AS x2"
    out["kmeans_default_start"] = O.two_groups("lineitem", LINE_KEY, sides, [*LINE_KEY, "l_quantity"], SIZE)
    out["kmeans_default_start_large"] = O.two_groups("lineitem", LINE_KEY, sides, [*LINE_KEY, "l_quantity"], 5000)
    out["kmeans_few_points"] = (
        f"WITH idx AS (SELECT *, rn // {SIZE} AS win FROM "
        f"({O.indexed('lineitem', LINE_KEY, 'CAST(l_linenumber % 2 AS DOUBLE) AS x1')})), "
        "seen AS (SELECT win, x1, row_number() OVER (PARTITION BY win ORDER BY min(rn)) AS nth FROM idx GROUP BY win, x1), "
        "c AS (SELECT win, max(x1) FILTER (nth = 1) AS c0_0, max(x1) FILTER (nth = 2) AS c1_0, "
        "max(x1) FILTER (nth = 3) AS c2_0 FROM seen GROUP BY win) "
        f"SELECT {key}, l_quantity, 0.0::DOUBLE AS stderr, c0_0, c1_0, c2_0 FROM idx JOIN c USING (win) "
        f"WHERE rn % {SIZE} = {SIZE - 1}"
    )
    so_far = ", ".join(
        f"round(avg(x{j}) FILTER ({test}) OVER (ORDER BY rn), 6) AS {name}_{j - 1}"
        for name, test in (("low", "x1 < 500"), ("high", "x1 >= 500")) for j in (1, 2)
    )
    out["microcluster_two_groups"] = (
        f"WITH idx AS ({O.indexed('lineitem', LINE_KEY, sides)}), acc AS (SELECT *, {so_far} FROM idx) "
        f"SELECT {key}, l_quantity, 0.0::DOUBLE AS stderr, low_0, low_1, high_0, high_1 "
        f"FROM acc WHERE rn % {SIZE} = {SIZE - 1}"
    )
    out["microcluster_cf"] = (
        f"WITH idx AS ({O.indexed('lineitem', LINE_KEY, xy)}) "
        f"SELECT rn // {SIZE} AS window_id, count(*) AS n, CAST(sum(rn) AS BIGINT) AS lst, "
        "round(sum(x1), 6) AS ls0, round(sum(x2), 6) AS ls1, "
        "round(sum(x1 * x1), 3) AS ss0, round(sum(x2 * x2), 3) AS ss1 FROM idx GROUP BY 1"
    )
    run = "OVER (ORDER BY rn)"
    out["microcluster_one_center"] = (
        f"WITH idx AS ({O.indexed('lineitem', LINE_KEY, xy)}), "
        f"acc AS (SELECT *, avg(x1) {run} AS m1, avg(x2) {run} AS m2, "
        f"sum(x1 * x1) {run} AS q1, sum(x2 * x2) {run} AS q2 FROM idx) "
        f"SELECT {key}, l_quantity, 0.0::DOUBLE AS stderr, "
        "round(q1 + q2 - (rn + 1) * (m1 * m1 + m2 * m2), 1) AS ssq, "
        "round(m1, 6) AS c0_0, round(m2, 6) AS c0_1 "
        f"FROM acc WHERE rn % {SIZE} = {SIZE - 1}"
    )
    out["microcluster_closing_rows"] = (
        "SELECT event_id, user_id, event_type, value, 0.0::DOUBLE AS stderr FROM "
        "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn "
        "FROM events) WHERE rn % 100 = 99"
    )
    out["window_index"] = (
        f"SELECT {key}, rn, rn // {SIZE} AS batch_id, rn % {SIZE} = {SIZE - 1} AS closes FROM "
        f"(SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS rn FROM lineitem)"
    )
    out["window_index_per_key"] = (
        "SELECT event_id, user_id, event_type, value, rn, rn // 100 AS batch_id FROM "
        "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn "
        "FROM events)"
    )
    out["instance_limit"] = (
        "SELECT event_id, user_id, event_type, value, rn FROM "
        "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) "
        f"WHERE rn < {CAP}"
    )
    out["center_text"] = (
        f"SELECT {key}, CAST(2 AS BIGINT) AS parts, round(l_quantity, 6) AS p0, "
        "round(l_extendedprice / 1000, 6) AS p1 FROM lineitem"
    )
    out["csv_round_trip"] = O.linreg(
        f"(SELECT event_id, value, {hour} AS hour FROM events) events", ["event_id"], evy,
        ["event_id", "value", "hour"], 2, 500, 500, STEPS, 1e-3,
    )
    out["microcluster_tree"] = out["microcluster_one_center"]
    out["feed_kmeans_time"] = out["kmeans_time_window"]
    out["feed_history"] = out["linreg_model_history"]
    fold = "value AS y, CAST(user_id % 24 AS DOUBLE) AS x1, CAST(1 AS DOUBLE) AS x2"
    out["feed_keyed"] = O.linreg(
        "events", ["event_id"], fold, ["event_id", "user_id", "event_type", "value"], 2, 100, 100, STEPS, 1e-3,
        ["event_type"],
    )
    out["feed_keyed_kmeans"] = O.kmeans(
        "events", ["event_id"], "value / 3 AS x1, CAST(user_id % 24 AS DOUBLE) AS x2",
        ["event_id", "user_id", "event_type", "value"], 2, 3, 120, 120, 4, ["event_type"],
    )
    out["linreg_prequential_lines"] = (
        f"WITH RECURSIVE idx AS ({O.indexed('lineitem', LINE_KEY, line2)}), "
        f"mem AS ({O.members(SIZE, SIZE)}), g AS ({O.gram(2, 'mem', (), SIZE)}), "
        f"{O.chain(2, STEPS, RATE)}, {O.trained(2)} "
        f"SELECT {', '.join('idx.' + c for c in LINE_KEY)}, l_quantity, l_discount, "
        f"CASE WHEN rn >= {SIZE} THEN (rn - {SIZE}) // {SIZE} END AS model_window, "
        "round(x1 * w1 + x2 * w2, 2) AS prediction "
        f"FROM idx LEFT JOIN m ON idx.rn >= {SIZE} AND (idx.rn - {SIZE}) // {SIZE} = m.win"
    )
    out["linreg_time_as_of"] = (
        f"WITH RECURSIVE mem AS ({day} date_diff('day', DATE '1970-01-01', ts) AS win FROM events), "
        f"raw AS ({O.gram(2, 'mem', ['event_type'])}), "
        "g AS (SELECT raw.* REPLACE (row_number() OVER (PARTITION BY event_type ORDER BY win) - 1 "
        "AS win), win AS at FROM raw), "
        f"{O.chain(2, STEPS, 1e-3, ['event_type'])}, {O.trained(2, ['event_type'])}, "
        "ends AS (SELECT event_type, TIMESTAMP '1970-01-01' + to_days(CAST(g.at + 1 AS INTEGER)) AS model_since, "
        "w1, w2 FROM m JOIN g USING (event_type, win)) "
        "SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.x1 AS hour, model_since, "
        "round(x1 * w1 + x2 * w2, 4) AS prediction FROM mem e ASOF LEFT JOIN ends "
        "ON e.event_type = ends.event_type AND e.ts >= ends.model_since"
    )
    out["kmeans_held_out_windows"] = (
        f"WITH idx AS ({O.indexed(marked, LINE_KEY, xy)}), "
        + O.kmeans_steps(2, 2, 3, SIZE, SIZE).replace(
            "mem AS (SELECT alls.* FROM alls JOIN full_w USING (win))",
            "mem AS (SELECT alls.* FROM alls JOIN full_w USING (win) WHERE NOT held_out)",
        )
        + ", cost AS (SELECT r.win, r.rn, r.held_out, min((r.x1 - c.x1) ** 2 + (r.x2 - c.x2) ** 2) AS d "
        "FROM alls r JOIN full_w USING (win) JOIN c3 c ON c.win = r.win GROUP BY r.win, r.rn, r.held_out) "
        "SELECT win AS window_id, count(*) FILTER (NOT held_out) AS n_train, "
        "round(sum(d) FILTER (NOT held_out), 3) AS ssq_train, count(*) FILTER (held_out) AS n_held, "
        "round(sum(d) FILTER (held_out), 3) AS ssq_held FROM cost GROUP BY win"
    )
    # Of each order of snapshots the last five are left: those with fewer than five later ones.
    out["microcluster_horizon"] = (
        f"WITH idx AS ({O.indexed('lineitem', LINE_KEY, xy)}), "
        "p AS (SELECT rn // 250 AS win, count(*) AS n, sum(x1) AS a, sum(x2) AS b, sum(x1 * x1) AS c, "
        "sum(x2 * x2) AS d FROM idx GROUP BY 1 HAVING count(*) = 250), "
        "s AS (SELECT *, sum(n) OVER w AS n1, sum(a) OVER w AS a1, sum(b) OVER w AS b1, sum(c) OVER w AS c1, "
        "sum(d) OVER w AS d1 FROM p WINDOW w AS (ORDER BY win)), "
        "o AS (SELECT win + 1 AS t, list_max(list_filter(range(40), lambda i: (win + 1) % (1::BIGINT << i) = 0)) AS o FROM p), "
        "kept AS (SELECT x.win, max(o.t) AS t FROM p x JOIN o ON o.t <= x.win + 1 - 10 AND "
        "((x.win // (1::BIGINT << o.o) + 1) // 2) - ((o.t // (1::BIGINT << o.o) + 1) // 2) < 5 GROUP BY x.win) "
        "SELECT s.win AS window_id, coalesce(k.t, 0) * 250 AS since, CAST(s.n1 - coalesce(z.n1, 0) AS BIGINT) AS n, "
        "round(s.a1 - coalesce(z.a1, 0), 2) AS ls0, round(s.b1 - coalesce(z.b1, 0), 2) AS ls1, "
        "round(s.c1 - coalesce(z.c1, 0), 0) AS ss0, round(s.d1 - coalesce(z.d1, 0), 0) AS ss1 "
        "FROM s LEFT JOIN kept k USING (win) LEFT JOIN s z ON z.win + 1 = k.t"
    )
    # The watermark ends at the latest time seen, so the last day stays open.
    out["feed_time_window"] = out["linreg_time_window"]
    return out | (llm_queries.ORACLES if llm_queries else {})
