import os
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideline.config import KMeansOptions, LinRegOptions, MicroClusterOptions
from tideline.operators import (
    kmeans_time_windows,
    linreg_time_windows,
    stream_kmeans,
    stream_linreg,
    stream_microcluster,
)
from tideline.sources import read_csv_rows, row_schema, stream_csv_rows, stream_table, write_rows
from tideline.feeds import (
    KMeansStream,
    LinRegStream,
    MicroClusterStream,
    late_rows,
    run_stream,
    run_time_windows,
)
from brute import linreg


def frame(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 4, (n, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=n)
    keys = ["hot" if i % 3 else "cold" for i in range(n)]
    rows = [(i, keys[i], float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, k string, y double, x0 double, x1 double")


def pieces(df, folder, cuts):
    """Write the rows between the cuts as one file each."""
    os.makedirs(folder, exist_ok=True)
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        path = f"{folder}/{i:03d}.parquet"
        pq.write_table(df.where((F.col("seq") >= low) & (F.col("seq") < high)).toArrow(), path)
        os.utime(path, (1000 + i, 1000 + i))


def feed(spark, folder, schema):
    return stream_table(spark, folder, schema, files_per_trigger=1)


def same_rows(a, b, digits=8):
    def clean(df):
        rows = []
        for row in df.collect():
            cells = []
            for name in sorted(df.columns):
                v = row[name]
                if isinstance(v, str) and "," in v:
                    v = tuple(round(float(p), digits) for p in v.split(","))
                cells.append(round(v, digits) if isinstance(v, float) else v)
            rows.append(tuple(map(repr, cells)))
        return sorted(rows)

    assert sorted(a.columns) == sorted(b.columns)
    assert clean(a) == clean(b)


CUTS = [0, 3, 90, 130]


@pytest.mark.parametrize("key,shift", [(None, 20), ("k", 20), ("k", 5)])
def test_linreg_feed_equals_table(spark, tmp_path, key, shift):
    df = frame(spark, 130)
    options = LinRegOptions(
        learn_type=0 if shift == 20 else 1, window_shift=shift, batch_size=20,
        num_iterations=6, step_size=0.02,
    )
    pieces(df, f"{tmp_path}/in", CUTS)
    op = LinRegStream("y", ["x0", "x1"], "seq", key, options)
    query = run_stream(op, feed(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    same_rows(out, stream_linreg(df, "y", ["x0", "x1"], "seq", key, options))


def test_restart_and_rows_set_aside(spark, tmp_path):
    df = frame(spark, 130)
    options = LinRegOptions(batch_size=20, num_iterations=6, step_size=0.02)
    op = LinRegStream("y", ["x0", "x1"], "seq", None, options)
    folder, out, check, late = (f"{tmp_path}/{n}" for n in ("in", "out", "ck", "late"))
    pieces(df, folder, [0, 33, 71])
    run_stream(op, feed(spark, folder, df.schema), out, check, late_to=late).awaitTermination()
    assert late_rows(spark, check) == 0
    pieces(df, folder, [0, 33, 71, 130])
    pq.write_table(df.where("seq < 5").toArrow(), f"{folder}/zzz.parquet")
    run_stream(op, feed(spark, folder, df.schema), out, check, late_to=late).awaitTermination()
    same_rows(
        spark.read.parquet(out).drop("batch_id"),
        stream_linreg(df, "y", ["x0", "x1"], "seq", None, options),
    )
    assert late_rows(spark, check) == 5
    same_rows(spark.read.parquet(late).drop("batch_id"), df.where("seq < 5"))


@pytest.mark.parametrize("key", [None, "k"])
def test_late_and_tied_rows_count_where_they_arrive(spark, tmp_path, key):
    df = frame(spark, 61).withColumn("at", F.expr("seq div 2"))
    options = LinRegOptions(batch_size=10, num_iterations=6, step_size=0.02)
    op = LinRegStream("y", ["x0", "x1"], "at", key, options)
    # A cut between two tied rows, then rows that are out of order.
    parts = [df.where("seq < 31"), df.where("seq >= 50"), df.where("seq >= 31 and seq < 50")]
    folder, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    os.makedirs(folder)
    arrived = []
    for i, part in enumerate(parts):
        pq.write_table(part.toArrow(), f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1000 + i, 1000 + i))
        arrived.append(part.withColumn("batch", F.lit(i)))
    run_stream(op, feed(spark, folder, df.schema), out, check).awaitTermination()
    found = spark.read.parquet(out).drop("batch_id")
    whole = arrived[0].union(arrived[1]).union(arrived[2])
    table = stream_linreg(whole, "y", ["x0", "x1"], ["batch", "at"], key, options)
    if key is None:
        assert found.count() == 6
    assert found.count() == table.count()
    assert late_rows(spark, check) == 19


def test_replayed_micro_batch_gives_the_same_result(spark, tmp_path):
    from tideline.feeds.runner import _Feed

    df = frame(spark, 60)
    options = LinRegOptions(batch_size=20, num_iterations=6, step_size=0.02)
    op = LinRegStream("y", ["x0", "x1"], "seq", "k", options)
    step = _Feed(op, f"{tmp_path}/out", f"{tmp_path}/ck", "parquet")
    step(df.where("seq < 30"), 0)
    step(df.where("seq >= 30"), 1)
    step(df.where("seq >= 30"), 1)
    same_rows(
        spark.read.parquet(f"{tmp_path}/out").drop("batch_id"),
        stream_linreg(df, "y", ["x0", "x1"], "seq", "k", options),
    )


@pytest.mark.parametrize("update", ["replace", "decay"])
def test_kmeans_feed_equals_table(spark, tmp_path, update):
    df = frame(spark, 130)
    options = KMeansOptions(
        batch_size=15, num_iterations=4, num_clusters=2, update=update, alpha=0.5
    )
    pieces(df, f"{tmp_path}/in", CUTS)
    op = KMeansStream(["x0", "x1"], "seq", "k", options)
    run_stream(
        op, feed(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/ck"
    ).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    same_rows(out, stream_kmeans(df, ["x0", "x1"], "seq", "k", options))


def test_microcluster_feed_equals_table(spark, tmp_path):
    df = frame(spark, 130)
    options = MicroClusterOptions(batch_size=10, num_clusters=2, max_kernels=6, horizon=50)
    pieces(df, f"{tmp_path}/in", CUTS)
    op = MicroClusterStream(["x0", "x1"], "seq", "k", options)
    run_stream(
        op, feed(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/ck"
    ).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    same_rows(out, stream_microcluster(df, ["x0", "x1"], "seq", "k", options))


def test_csv_feed_and_csv_sink(spark, tmp_path):
    df = frame(spark, 45).select("seq", "y", "x0")
    schema = row_schema(["y", "x0"], ["seq"])
    os.makedirs(f"{tmp_path}/in")
    rows = df.orderBy("seq").collect()
    for i in range(3):
        with open(f"{tmp_path}/in/{i}.csv", "w") as f:
            f.writelines(f"{r.seq},{r.y},{r.x0}\n" for r in rows[15 * i : 15 * i + 15])
        os.utime(f"{tmp_path}/in/{i}.csv", (1000 + i, 1000 + i))
    options = LinRegOptions(batch_size=10, num_iterations=3, step_size=0.02)
    op = LinRegStream("y", ["x0"], "seq", None, options)
    stream = stream_csv_rows(spark, f"{tmp_path}/in", schema)
    run_stream(op, stream, f"{tmp_path}/out", f"{tmp_path}/ck", fmt="csv").awaitTermination()
    static = stream_linreg(read_csv_rows(spark, f"{tmp_path}/in", schema), "y", ["x0"], "seq", options=options)
    back = spark.read.schema(static.schema).csv([f"{tmp_path}/out/batch_id={i}" for i in range(3)])
    same_rows(back, static)


def test_malformed_csv_line_fails(spark, tmp_path):
    path = f"{tmp_path}/bad.csv"
    with open(path, "w") as f:
        f.write("1,2.0\n2,text\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv_rows(spark, path, row_schema(["x"], ["seq"])).collect()


def test_model_history_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "window_id long, weights array<double>")
    write_rows(df, f"{tmp_path}/h", "csv")
    write_rows(df, f"{tmp_path}/h", "csv")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/h").collect()] == ['1,"[1.0, 2.0]"'] * 2


def test_function_sink(spark, tmp_path):
    df = frame(spark, 40)
    pieces(df, f"{tmp_path}/in", [0, 25, 40])
    seen = {}
    op = LinRegStream("y", ["x0"], "seq", None, LinRegOptions(batch_size=10))
    run_stream(
        op, feed(spark, f"{tmp_path}/in", df.schema),
        lambda out, batch: seen.__setitem__(batch, out.count()), f"{tmp_path}/ck",
    ).awaitTermination()
    assert seen == {0: 2, 1: 2}


def timed(spark, n=60):
    t0 = datetime(2024, 1, 1)
    rng = np.random.default_rng(2)
    rows = [
        (i, t0 + timedelta(minutes=7 * i), float(i % 5 + rng.normal()), float(i % 5 + 1)) for i in range(n)
    ]
    return spark.createDataFrame(rows, "seq long, ts timestamp, y double, x double"), rows


@pytest.mark.parametrize("slide", [None, "20 minutes"])
def test_time_windows(spark, slide):
    df, rows = timed(spark)
    options = LinRegOptions(num_iterations=5, step_size=0.02)
    out = linreg_time_windows(df, "ts", "y", ["x"], "1 hour", slide, options=options)
    found = out.orderBy("window_start").collect()
    t0, step = datetime(2024, 1, 1), timedelta(minutes=20 if slide else 60)
    w, k, wanted = np.zeros(1), -3 if slide else 0, []
    from brute import sgd

    while t0 + k * step <= rows[-1][1]:
        start = t0 + k * step
        part = [r for r in rows if start <= r[1] < start + timedelta(hours=1)]
        if part:
            y, x = np.array([r[2] for r in part]), np.array([[r[3]] for r in part])
            w, _ = sgd(x, y, w, 5, 0.02)
            wanted.append((start, len(part), w[0], ((x @ w - y) ** 2).mean()))
        k += 1
    assert [(r.window_start, r.n) for r in found] == [v[:2] for v in wanted]
    assert np.allclose([r.beta1 for r in found], [v[2] for v in wanted])
    assert np.allclose([r.stderr for r in found], [v[3] for v in wanted])


def test_time_window_fit_without_error(spark):
    df, _ = timed(spark)
    exact = df.withColumn("y", F.col("x") * 3)
    options = LinRegOptions(num_iterations=200, step_size=0.1, convergence_tol=0.0)
    out = linreg_time_windows(exact, "ts", "y", ["x"], "1 hour", options=options).collect()
    assert max(r.stderr for r in out) < 1e-20


def test_kmeans_time_windows(spark):
    from brute import kmeans

    df, rows = timed(spark)
    options = KMeansOptions(num_iterations=3, num_clusters=2, init="first_k", epsilon=0.0)
    out = kmeans_time_windows(df, "ts", ["y", "x"], "1 hour", options=options)
    found = out.orderBy("window_start").collect()
    assert len(found) == 7
    for r in found:
        part = [v[2:] for v in rows if r.window_start <= v[1] < r.window_end]
        centers, cost = kmeans(part, 2, 3)
        assert r.n == len(part) and r.stderr == pytest.approx(cost)
        assert np.allclose([float(v) for v in r.center0.split(",")], centers[0])


def test_time_window_feed(spark, tmp_path):
    df, rows = timed(spark)
    folder = f"{tmp_path}/in"
    pieces(df, folder, [0, 20, 40, 60])
    pq.write_table(df.where("seq = 2").toArrow(), f"{folder}/003.parquet")
    options = LinRegOptions(num_iterations=5, step_size=0.02)
    query = run_time_windows(
        feed(spark, folder, df.schema), "ts", "y", ["x"], "1 hour",
        f"{tmp_path}/out", f"{tmp_path}/ck", delay="10 minutes", options=options,
    )
    query.awaitTermination()
    closed = rows[-1][1] - timedelta(minutes=10)
    static = linreg_time_windows(df, "ts", "y", ["x"], "1 hour", options=options)
    same_rows(
        spark.read.parquet(f"{tmp_path}/out").drop("batch_id"),
        static.where(F.col("window_end") <= F.lit(closed)),
    )


def test_times_without_zone_do_not_depend_on_the_session(spark):
    _, rows = timed(spark)
    plain = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, y double, x double")
    seen = []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            out = linreg_time_windows(plain, "ts", "y", ["x"], "1 day")
            seen.append(out.select("window_start", "window_end", "n").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen[0] == seen[1]
    assert seen[0][0].window_start == datetime(2024, 1, 1)
