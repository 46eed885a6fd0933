"""Keyed feeds whose state is in Spark's state store."""

import glob
import os
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.config import KMeansOptions, LinRegOptions, MicroClusterOptions
from tideline.feeds import KMeansStream, LinRegStream, MicroClusterStream, late_rows, run_keyed_stream
from tideline.feeds.keyed import _advance, _solver, units, window_sums
from tideline.functions.vectors import hash_unit
from tideline.operators import stream_kmeans, stream_linreg, stream_microcluster
from test_feeds import CUTS, feed, frame, pieces, same_rows

CASES = {
    "regression": (
        LinRegStream("y", ["x0", "x1"], "seq", "k", LinRegOptions(batch_size=8, num_iterations=5, step_size=0.05)),
        lambda df, op: stream_linreg(df, "y", ["x0", "x1"], "seq", "k", op.options),
    ),
    "sliding": (
        LinRegStream("y", ["x0", "x1"], "seq", "k", LinRegOptions(
            learn_type=1, window_shift=6, batch_size=10, num_iterations=4, step_size=0.05, mini_batch_fraction=0.5)),
        lambda df, op: stream_linreg(df, "y", ["x0", "x1"], "seq", "k", op.options),
    ),
    "kmeans": (
        KMeansStream(["x0", "x1"], "seq", "k", KMeansOptions(batch_size=12, num_clusters=3, num_iterations=4)),
        lambda df, op: stream_kmeans(df, ["x0", "x1"], "seq", "k", op.options),
    ),
    "decay": (
        KMeansStream(["x0", "x1"], "seq", "k", KMeansOptions(
            batch_size=9, num_clusters=2, num_iterations=4, update="decay", alpha=0.5, init="random")),
        lambda df, op: stream_kmeans(df, ["x0", "x1"], "seq", "k", op.options),
    ),
    "microcluster": (
        MicroClusterStream(["x0", "x1"], "seq", "k", MicroClusterOptions(
            batch_size=10, num_clusters=2, max_kernels=6, horizon=50, num_iterations=3, block_rows=4)),
        lambda df, op: stream_microcluster(df, ["x0", "x1"], "seq", "k", op.options),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_keyed_feed_equals_the_table(spark, tmp_path, name):
    op, table = CASES[name]
    df = frame(spark, 130, seed=4).withColumn("big", F.lit((1 << 62) + 1)).withColumn(
        "gap", F.when(F.col("seq") % 3 > 0, F.col("seq"))
    )
    pieces(df, f"{tmp_path}/in", CUTS)
    args = (f"{tmp_path}/out", f"{tmp_path}/state")
    # Stopped after the first piece of the feed and started again.
    run_keyed_stream(op, feed(spark, f"{tmp_path}/in", df.schema), *args).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    same_rows(found, table(df, op), digits=6)
    assert late_rows(spark, f"{tmp_path}/state") == 0


def test_restart_and_late_rows(spark, tmp_path):
    op, table = CASES["regression"]
    df = frame(spark, 90, seed=5)
    args = (f"{tmp_path}/out", f"{tmp_path}/state")
    for low, high in ((0, 40), (40, 90)):
        pieces(df.where((F.col("seq") >= low) & (F.col("seq") < high)), f"{tmp_path}/in{low}", [low, high])
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/in{low}/000.parquet", f"{tmp_path}/in/{low:03d}.parquet")
        run_keyed_stream(op, feed(spark, f"{tmp_path}/in", df.schema), *args).awaitTermination()
    same_rows(spark.read.parquet(args[0]).drop("batch_id"), table(df, op), digits=6)
    late = frame(spark, 5, seed=6)
    pieces(late, f"{tmp_path}/late", [0, 5])
    os.rename(f"{tmp_path}/late/000.parquet", f"{tmp_path}/in/999.parquet")
    run_keyed_stream(op, feed(spark, f"{tmp_path}/in", df.schema), *args).awaitTermination()
    assert late_rows(spark, args[1]) == 5


def test_a_micro_batch_writes_the_state_of_its_keys_alone(spark, tmp_path):
    """300 keys, then rows for 3 of them: about one hundredth of the state is written."""
    rng = np.random.default_rng(1)
    rows = [(i, f"k{i % 300}", float(i % 7), *rng.normal(size=2).tolist()) for i in range(6000)]
    rows += [(6000 + i, f"k{i % 3}", 1.0, 0.5, 0.25) for i in range(6)]
    df = spark.createDataFrame(rows, "seq long, k string, y double, x0 double, x1 double").coalesce(1)
    pieces(df, f"{tmp_path}/in", [0, 6000, 6006])
    op = LinRegStream("y", ["x0", "x1"], "seq", "k", LinRegOptions(batch_size=64, num_iterations=2, step_size=0.01))
    query = run_keyed_stream(op, feed(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    steps = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    updated = [s["numRowsUpdated"] for s in steps if s["numRowsUpdated"]]
    assert updated == [300, 3] and steps[-1]["numRowsTotal"] == 300

    def written(version):
        return sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/state/query/state/0/*/{version}*.changelog"))

    whole, few = written(1), written(2)
    assert whole > 100_000 and few < 0.04 * whole  # an empty partition writes a header too


def test_arguments_of_keyed_feeds(spark, tmp_path):
    df = frame(spark, 9)
    pieces(df, f"{tmp_path}/in", [0, 9])
    rows = feed(spark, f"{tmp_path}/in", df.schema)
    with pytest.raises(ValueError):
        run_keyed_stream(LinRegStream("y", ["x0"], "seq"), rows, "o", "c")
    with pytest.raises(TypeError):
        op = LinRegStream("y", ["x0"], "seq", "k")
        run_keyed_stream(op, rows.withColumn("list", F.array("x0")), "o", "c")


def test_sliding_sums_and_draws(spark):
    panes = np.random.default_rng(3).normal(size=(23, 2))
    got = window_sums(panes, 5, 2)
    want = [panes[i : i + 5].sum(axis=0) for i in range(0, 19, 2)]
    assert np.allclose(got, want) and len(window_sums(panes[:4], 5, 2)) == 0
    rows = spark.range(0, 40).select(hash_unit("id", F.lit(2), F.lit(-7)).alias("u")).collect()
    assert np.array_equal(units(np.arange(40), 2, -7), [r.u for r in rows])


def test_a_key_is_held_in_few_bytes():
    """A row of a key took more than 1,000 bytes of a worker's Python; texts are now in Arrow columns."""
    solver, held = _solver(CASES["kmeans"][0], 2), []
    n, each = 12_000, 1_000

    class State:
        exists = False

        def update(self, value):
            held.append(value[0])

    def parts():
        for at in range(n - each, -1, -each):
            i = np.arange(at, at + each)
            yield pd.DataFrame({
                "_tl_c0": i.astype(str), "_tl_c1": [None if v % 5 == 0 else f"t{v}" for v in i],
                "_tl_values": [np.array([v % 7, v % 11], float) for v in i],
                "_tl_some0": True, "_tl_order0": i, "_tl_tie": 0,
            })

    tracemalloc.start()
    pools = pa.total_allocated_bytes()
    peak = []

    def watched():
        for part in parts():
            yield part
            peak.append(tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - pools)

    out = list(_advance(solver, 2, 1)(("k",), watched(), State()))
    tracemalloc.stop()
    # What is held grows by less than 150 bytes a row.
    assert (peak[-1] - peak[0]) / (n - each) < 150
    assert held == [n] and out[0]["_tl_c0"].tolist() == [str(i) for i in range(11, n, 12)]
    assert out[0]["_tl_c1"].isna().sum() == sum(i % 5 == 0 for i in range(11, n, 12))


def test_order_by_text_and_gaps(spark, tmp_path):
    """Nulls first, then texts by their code points, across the parts of a feed."""
    df = frame(spark, 120, seed=9).withColumn(
        "word", F.when(F.col("seq") % 9 > 0, F.concat(F.lit("é\U0001f600z".join("ab")), F.lpad("seq", 4, "0")))
    )
    op = KMeansStream(["x0", "x1"], ["word", "seq"], "k", CASES["kmeans"][0].options)
    pieces(df, f"{tmp_path}/in", [0, 120])
    args = (f"{tmp_path}/out", f"{tmp_path}/state")
    run_keyed_stream(op, feed(spark, f"{tmp_path}/in", df.schema), *args).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    same_rows(found, stream_kmeans(df, ["x0", "x1"], ["word", "seq"], "k", op.options), digits=6)
