import hashlib

import numpy as np
import pytest
from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD
from pyspark.sql import functions as F

from brute import linreg, sgd
from tideline.config import LinRegOptions
from tideline.feeds.keyed import drawn
from tideline.functions.vectors import text_unit
from tideline.operators import linreg_models, score, stream_linreg, stream_linreg_call
from tideline.operators.linreg import fit_linreg
from tideline.plans.arrival import RN
from tideline.plans.count_windows import CountWindows
from tideline.plans.draws import drawn_rows
from tideline.plans.gram import gram_stats


def frame(spark, n, p, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(1, 5, (n, p))
    y = x @ np.arange(1, p + 1) + noise * rng.normal(size=n)
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(n)]
    names = ["seq", "y", *[f"x{i}" for i in range(p)]]
    return spark.createDataFrame(rows, names), np.column_stack([y, x])


def check(found, wanted, rel=1e-9):
    assert len(found) == len(wanted)
    for row, (mse, w, taken) in zip(found, wanted):
        assert row.stderr == pytest.approx(mse, rel=rel)
        assert np.allclose(row.weights, w, rtol=rel)
        assert row.iterations == taken
        assert row.intercept == 0.0


@pytest.mark.parametrize("size,shift", [(25, 25), (30, 10), (20, 7), (12, 1)])
def test_windows_match_plain_descent(spark, size, shift):
    df, data = frame(spark, 100, 3)
    options = LinRegOptions(
        learn_type=0 if size == shift else 1, window_shift=shift, batch_size=size,
        num_iterations=15, step_size=0.02,
    )
    models = linreg_models(df.repartition(5), "y", ["x0", "x1", "x2"], "seq", options=options)
    check(models.orderBy("window_id").collect(), linreg(data, size, shift, 15, 0.02))


def test_closing_rows_and_columns(spark):
    df, data = frame(spark, 47, 2)
    options = LinRegOptions(batch_size=10, num_iterations=5, step_size=0.01)
    out = stream_linreg(df.withColumn("tag", F.lit("t")), "y", ["x0", "x1"], "seq", options=options)
    assert out.columns == ["seq", "y", "x0", "x1", "tag", "stderr", "beta0", "beta1", "beta2"]
    assert sorted(r.seq for r in out.collect()) == [9, 19, 29, 39]
    assert stream_linreg_call(df, "y", "x0", order_by="seq").count() == 4


@pytest.mark.parametrize("n,wanted", [(9, 0), (10, 1), (11, 1), (23, 2)])
def test_partial_windows_are_not_emitted(spark, n, wanted):
    df, _ = frame(spark, n, 1)
    assert stream_linreg(df, "y", ["x0"], "seq").count() == wanted


def test_window_of_one_row(spark):
    df, data = frame(spark, 6, 1)
    options = LinRegOptions(batch_size=1, num_iterations=3, step_size=0.01)
    models = linreg_models(df, "y", ["x0"], "seq", options=options)
    check(models.orderBy("window_id").collect(), linreg(data, 1, 1, 3, 0.01), rel=1e-7)


@pytest.mark.parametrize("rate", [1e-8, 1e-3, 3e-2])
def test_matches_the_library_trainer(spark, rate):
    df, data = frame(spark, 90, 2, seed=3)
    options = LinRegOptions(batch_size=30, num_iterations=40, step_size=rate)
    found = linreg_models(df, "y", ["x0", "x1"], "seq", options=options).orderBy("window_id").collect()
    weights = None
    for k, row in enumerate(found):
        part = data[30 * k : 30 * k + 30]
        points = spark.sparkContext.parallelize(
            [LabeledPoint(r[0], r[1:].tolist()) for r in part], 2
        )
        model = LinearRegressionWithSGD.train(
            points, iterations=40, step=rate, miniBatchFraction=1.0, initialWeights=weights,
        )
        weights = model.weights
        assert np.allclose(row.weights, weights.toArray(), rtol=1e-10, atol=0)


@pytest.mark.parametrize("tol,chunk", [(0.001, 4), (0.0, 4), (0.001, 3)])
def test_parallel_chunks_equal_the_sequential_chain(spark, tol, chunk):
    df, data = frame(spark, 300, 2, seed=5)
    keyed = df.withColumn("k", F.when(F.col("seq") % 3 > 0, "hot").otherwise("cold"))
    options = LinRegOptions(batch_size=5, num_iterations=10, step_size=0.01, convergence_tol=tol)
    args = (keyed, "y", ["x0", "x1"], "seq", "k")
    one = fit_linreg(*args, options=options).models
    many = fit_linreg(*args, options=options, chunk=chunk).models
    key = ["k", "window_id"]
    a, b = one.orderBy(*key).collect(), many.orderBy(*key).collect()
    assert len(a) == len(b) == 60
    for r, s in zip(a, b):
        assert (r.k, r.window_id, r.iterations) == (s.k, s.window_id, s.iterations)
        assert np.allclose(r.weights, s.weights, rtol=1e-9)
        assert r.stderr == pytest.approx(s.stderr, rel=1e-9)


def test_many_features(spark):
    df, data = frame(spark, 120, 15, seed=7)
    xs = [f"x{i}" for i in range(15)]
    for size, shift in ((40, 40), (40, 20)):
        options = LinRegOptions(
            learn_type=0 if size == shift else 1, window_shift=shift, batch_size=size,
            num_iterations=10, step_size=1e-3,
        )
        models = linreg_models(df.repartition(3), "y", xs, "seq", options=options)
        check(models.orderBy("window_id").collect(), linreg(data, size, shift, 10, 1e-3), rel=1e-8)


@pytest.mark.parametrize("shift", [20, 10])
def test_nearly_perfect_fit_keeps_its_digits(spark, shift):
    rows = [(i, 3.0 * (1000 + i % 7), 1000.0 + i % 7) for i in range(80)]
    df = spark.createDataFrame(rows, ["seq", "y", "x"])
    options = LinRegOptions(
        learn_type=0 if shift == 20 else 1, window_shift=shift, batch_size=20, num_iterations=60,
        step_size=9e-7, convergence_tol=0.0,
    )
    models = linreg_models(df, "y", ["x"], "seq", options=options)
    found = models.orderBy("window_id").collect()
    wanted = linreg([r[1:] for r in rows], 20, shift, 60, 9e-7, 0.0)
    assert len(found) == len(wanted)
    assert wanted[-1][0] < 1e-15
    for row, (mse, w, _) in zip(found, wanted):
        assert row.weights[0] == pytest.approx(3.0, rel=1e-3)
        assert row.stderr == pytest.approx(mse, rel=1e-6, abs=1e-23)


@pytest.mark.parametrize("size,shift,fraction", [(20, 20, 0.5), (20, 5, 0.3), (6, 1, 0.1)])
def test_sampled_steps(spark, size, shift, fraction):
    df, data = frame(spark, 60, 2, seed=9)
    options = LinRegOptions(
        learn_type=0 if size == shift else 1, window_shift=shift, batch_size=size,
        num_iterations=8, step_size=0.02, mini_batch_fraction=fraction, seed=5,
    )
    found = linreg_models(df, "y", ["x0", "x1"], "seq", options=options)
    def unit(seq, step):
        return int(hashlib.md5(f"{seq}|{step}|5".encode()).hexdigest()[:8], 16) / 2**32

    drawn = np.array([[unit(seq, i) < fraction for i in range(1, 9)] for seq in range(60)])
    w = np.zeros(2)
    for row in found.orderBy("window_id").collect():
        at = slice(row.window_id * shift, row.window_id * shift + size)
        y, x = data[at, 0], data[at, 1:]
        w, taken = sgd(x, y, w, 8, 0.02, drawn=[drawn[at, i] for i in range(8)])
        assert np.allclose(row.weights, w, rtol=1e-9)
        assert row.stderr == pytest.approx(((x @ w - y) ** 2).mean(), rel=1e-9)
    assert abs(drawn.mean() - fraction) < 0.15


def test_null_rules(spark):
    rows = [(i, float(i), None if i == 3 else (float("nan") if i == 5 else 1.0)) for i in range(14)]
    df = spark.createDataFrame(rows, "seq int, y double, x double")
    options = LinRegOptions(batch_size=4, num_iterations=2, step_size=0.01)
    with pytest.raises(Exception, match="null or NaN feature"):
        stream_linreg(df, "y", ["x"], "seq", options=options).collect()
    kept = stream_linreg(df, "y", ["x"], "seq", options=options, on_null="drop").collect()
    assert [r.seq for r in sorted(kept, key=lambda r: r.seq)] == [4, 9, 13]


def test_input_types(spark):
    df = spark.createDataFrame([(i, i, 1.0, "t") for i in range(10)], "seq int, y int, x float, t string")
    assert stream_linreg(df, "y", ["x"], "seq").count() == 1
    with pytest.raises(TypeError):
        stream_linreg(df, "y", ["t"], "seq")
    with pytest.raises(ValueError):
        stream_linreg(df, "y", [], "seq")
    with pytest.raises(ValueError):
        stream_linreg(df, "y", ["x"], "seq", options=LinRegOptions(learn_type=2))


def test_divergence_names_the_window(spark):
    df, _ = frame(spark, 20, 1)
    options = LinRegOptions(batch_size=10, num_iterations=1500, step_size=1e6, on_diverge="error")
    with pytest.raises(Exception, match="diverged in window"):
        stream_linreg(df, "y", ["x0"], "seq", options=options).collect()
    emit = LinRegOptions(batch_size=10, num_iterations=1500, step_size=1e6)
    assert stream_linreg(df, "y", ["x0"], "seq", options=emit).count() == 2


def test_score(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert score(df, ["a", "b"], [3.0, 4.0], 5.0).first().prediction == 16.0
    with pytest.raises(ValueError):
        score(df, ["a"], [1.0, 2.0])
    weighted = df.withColumn("w", F.array(F.lit(2.0), F.lit(1.0)))
    assert score(weighted, ["a", "b"], F.col("w")).first().prediction == 4.0


def test_null_key_is_a_key_of_its_own(spark):
    df, data = frame(spark, 40, 1)
    keyed = df.withColumn("k", F.when(F.col("seq") < 20, "a"))
    options = LinRegOptions(batch_size=10, num_iterations=5, step_size=0.01)
    out = stream_linreg(keyed, "y", ["x0"], "seq", "k", options)
    rows = sorted(out.collect(), key=lambda r: r.seq)
    assert [(r.seq, r.k) for r in rows] == [(9, "a"), (19, "a"), (29, None), (39, None)]
    wanted = [linreg(data[:20], 10, 10, 5, 0.01), linreg(data[20:], 10, 10, 5, 0.01)]
    for row, (mse, w, _) in zip(rows, wanted[0] + wanted[1]):
        assert row.beta1 == pytest.approx(w[0], rel=1e-9)


@pytest.mark.parametrize("fraction", [0.0, 1e-10, 1 / 3, 0.5, 1 - 1e-12])
def test_draws_of_arrays_are_those_of_texts(spark, fraction):
    index = [0, 9, 10, 12345, 999_999_999, 10**12, 10**17 + 3, 9 * 10**18]
    for seed in (42, -7, 1 << 40):
        got = drawn_rows(np.array(index), 11, seed, fraction)
        assert all(np.array_equal(got[:, s - 1], drawn(index, s, seed, fraction)) for s in range(1, 12))
    by_number = text_unit(F.col("id"), F.lit(3), F.lit(42)) < F.lit(fraction)
    rows = spark.range(2000).select("id", by_number.alias("hit")).orderBy("id").collect()
    assert np.array_equal(drawn_rows(np.arange(2000), 3, 42, fraction)[:, 2], [r.hit for r in rows])


@pytest.mark.parametrize("steps", [6, 70])
def test_mini_batches_send_rows_without_their_draws(spark, steps):
    rows = spark.range(64).select(
        F.col("id").alias(RN), (F.col("id") % 7).cast("double").alias("_tl_y"),
        (F.col("id") % 5).cast("double").alias("_tl_x0"),
    )
    stats = gram_stats(rows, [], 1, CountWindows(16, 16), steps, 0.5, 42)
    assert "md5" not in stats._jdf.queryExecution().toString()
    got = {(r.window_id, r._tl_it): (r.n, r.yy, r.b[0], r.g[0]) for r in stats.collect()}
    for w in range(4):
        index = np.arange(16 * w, 16 * w + 16)
        for step in range(1, steps + 2):
            hit = drawn(index, step, 42, 0.5) if step <= steps else np.ones(16, bool)
            y, x = index[hit] % 7, index[hit] % 5
            assert got[w, step] == (hit.sum(), (y * y).sum(), (x * y).sum(), (x * x).sum())
