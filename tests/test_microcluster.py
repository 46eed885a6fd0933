import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.config import MicroClusterOptions
from tideline.operators import (
    micro_clusters,
    microcluster_models,
    stream_microcluster,
    stream_microcluster_call,
)
from tideline.operators.microcluster import fit_microclusters
from tideline.plans.kernels import (
    FewKernels,
    Kernels,
    macro_centers,
    macro_centers_of,
    merge,
    summarise_block,
    width,
)


def frame(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 2)) + 10 * rng.integers(0, 2, (n, 1))
    rows = [(i, "ab"[i % 4 == 0], float(p[0]), float(p[1])) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "seq long, k string, a double, b double"), points


@pytest.mark.parametrize("block_rows", [10**6, 15])
def test_kernels_add_up_to_the_rows(spark, block_rows):
    df, points = frame(spark, 130)
    options = MicroClusterOptions(batch_size=50, max_kernels=7, block_rows=block_rows)
    cf = micro_clusters(df.repartition(3), ["a", "b"], "seq", options=options)
    rows = cf.collect()
    for w in range(3):
        part = points[50 * w : 50 * w + 50]
        mine = [r for r in rows if r.window_id == w]
        assert sum(r.n for r in mine) == len(part)
        assert np.allclose(np.sum([r.ls for r in mine], axis=0), part.sum(axis=0))
        assert np.allclose(np.sum([r.ss for r in mine], axis=0), (part**2).sum(axis=0))
        assert sum(r.lst for r in mine) == sum(range(50 * w, min(130, 50 * w + 50)))
        assert max(r.cf_id for r in mine) < 7
    assert (max(r.block for r in rows) > 0) == (block_rows == 15)


def test_one_cluster_is_the_running_mean(spark):
    df, points = frame(spark, 205)
    options = MicroClusterOptions(
        batch_size=20, num_clusters=1, num_iterations=1, max_kernels=6, horizon=10**9
    )
    models = fit_microclusters(df, ["a", "b"], "seq", options=options).models
    found = models.orderBy("window_id").collect()
    assert [r.window_id for r in found] == list(range(10))
    for r in found:
        seen = points[: 20 * (r.window_id + 1)]
        assert np.allclose(r.centers[0], seen.mean(axis=0))
        assert r.ssq == pytest.approx(((seen - seen.mean(axis=0)) ** 2).sum())
        kernels = np.array(r.kernels).reshape(-1, width(2))
        assert len(kernels) <= 6 and kernels[:, 0].sum() == len(seen)


@pytest.mark.parametrize("periods,size", [(100, 7), (10_000, 1)])
def test_long_chains_equal_the_plain_walk(spark, periods, size):
    df, points = frame(spark, periods * size)
    options = MicroClusterOptions(batch_size=size, num_clusters=2, max_kernels=5, horizon=40)
    found = microcluster_models(df.repartition(5), ["a", "b"], "seq", options=options)
    kernels = {r.window_id: r.kernels for r in found.select("window_id", "kernels").collect()}
    assert len(kernels) == periods
    state = np.empty(0)
    for w in range(periods):
        part = slice(w * size, (w + 1) * size)
        block = summarise_block(points[part], np.arange(part.start, part.stop, dtype=float), 5)
        state = merge(state, block.ravel(), 5, options.radius_factor, 40, 2)
        assert np.allclose(kernels[w], state, rtol=1e-9)


def test_any_learn_type_runs_alike(spark):
    df, _ = frame(spark, 40)
    runs = [
        microcluster_models(
            df, ["a", "b"], "seq", options=MicroClusterOptions(learn_type=t, batch_size=10)
        ).orderBy("window_id").collect()
        for t in (0, 1, 2, 9)
    ]
    assert all(r == runs[0] for r in runs)


def test_two_far_blobs(spark):
    df, points = frame(spark, 200)
    out = stream_microcluster_call(
        df, 0, 0, 100, 10, 2, 1, 0.95, "a", "b", order_by="seq"
    )
    assert out.columns == ["seq", "k", "a", "b", "stderr", "center0", "center1"]
    rows = sorted(out.collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == [99, 199]
    for r in rows:
        assert r.stderr == 0.0
        seen = points[: r.seq + 1]
        centers = sorted([float(v) for v in c.split(",")] for c in (r.center0, r.center1))
        assert np.allclose(centers[0], seen[seen[:, 0] < 5].mean(axis=0), atol=0.5)
        assert np.allclose(centers[1], seen[seen[:, 0] > 5].mean(axis=0), atol=0.5)


def test_row_cap_and_missing_centers(spark):
    df, _ = frame(spark, 100)
    options = MicroClusterOptions(batch_size=20, num_clusters=2, instance_limit=55)
    assert stream_microcluster(df, ["a", "b"], "seq", options=options).count() == 2
    same = df.select("seq", F.lit(1.0).alias("a"))
    options = MicroClusterOptions(batch_size=50, num_clusters=3)
    row = stream_microcluster(same, ["a"], "seq", options=options, with_ssq=True).first()
    assert (row.center0, row.center1, row.center2) == ("1.0", None, None) and row.ssq == 0.0


def test_input_order_does_not_matter(spark):
    df, _ = frame(spark, 150)
    options = MicroClusterOptions(batch_size=25, num_clusters=2, max_kernels=10)
    one = microcluster_models(df, ["a", "b"], "seq", "k", options).orderBy("k", "window_id")
    two = microcluster_models(df.repartition(9), ["a", "b"], "seq", "k", options)
    assert one.collect() == two.orderBy("k", "window_id").collect()


def test_stale_kernels_are_replaced():
    rows = np.array([[1.0, t, t * t, x, x * x] for t, x in ((0, 0.0), (1, 50.0), (500, 300.0))])
    held = Kernels(rows[:2], 2, 2.0, 100, 1)
    held.insert(rows[2])
    kept = sorted(held.used()[:, 3] / held.used()[:, 0])
    assert kept == [50.0, 300.0]
    held = Kernels(rows[:2], 2, 2.0, 10**6, 1)
    held.insert(rows[2])
    assert held.used()[:, 0].sum() == 3


def test_merge_conserves_mass():
    rng = np.random.default_rng(1)
    parts = [
        summarise_block(rng.normal(size=(40, 3)), np.arange(40.0) + 40 * i, 8).ravel() for i in range(4)
    ]
    acc = np.empty(0)
    for part in parts:
        acc = merge(acc, part, 8, 2.0, 10**9, 3)
    assert np.allclose(
        acc.reshape(-1, width(3)).sum(axis=0),
        sum(p.reshape(-1, width(3)).sum(axis=0) for p in parts),
    )
    assert len(acc) <= 8 * width(3)


@pytest.mark.parametrize("limit,dims", [(1, 1), (2, 1), (2, 3), (5, 2)])
def test_a_few_kernels_take_rows_as_many_do(limit, dims):
    rng = np.random.default_rng(limit + dims)
    for horizon in (30, 10**9):
        points = np.round(rng.normal(size=(600, dims)) * 3 + 10 * rng.integers(0, 3, (600, 1)), 1)
        few = FewKernels(np.empty((0, width(dims))), limit, 2.0, horizon, dims)
        many = Kernels(np.empty((0, width(dims))), limit, 2.0, horizon, dims)
        for t, x in enumerate(points):
            row = np.array([1.0, t, t * t, *x, *x * x])
            few.insert(row.tolist())
            many.take(row[None])
            assert np.allclose(np.array(few.flat()).reshape(-1, width(dims)), many.used(), rtol=1e-9)


def test_centres_of_many_sets_equal_those_of_each():
    rng = np.random.default_rng(4)
    sets = []
    for i in range(60):
        n, x = rng.integers(1, 9, 1 + i % 5).astype(float), rng.integers(0, 4, (1 + i % 5, 2))
        sets.append(np.column_stack([n, n, n, n[:, None] * x, n[:, None] * (x * x + 0.5)]).ravel())
    sets.append(np.empty(0))
    for weighted, steps in ((True, 2), (False, 1), (True, 0)):
        found = macro_centers_of(sets, 2, 3, steps, weighted, 7, list(range(61)))
        assert len(found[60][0]) == 0 and found[60][1] == 0.0
        for i in range(60):
            centers, ssq = macro_centers(sets[i].reshape(-1, 7), 2, 3, steps, weighted, [7, i])
            assert np.array_equal(found[i][0], centers) and found[i][1] == pytest.approx(ssq)


def test_blocks_of_one_row_need_no_python(spark):
    """Each row was a block with a Python call and an Arrow batch of its own."""
    df, _ = frame(spark, 40)
    options = MicroClusterOptions(batch_size=1, max_kernels=2, num_clusters=2)
    cf = micro_clusters(df, ["a", "b"], "seq", "k", options)
    assert "MapInArrow" not in cf._jdf.queryExecution().executedPlan().toString()
    rows = {(r.k, r.window_id): r for r in cf.collect()}
    assert len(rows) == 40 and all(r.n == 1 and r.sst == w * w for (_, w), r in rows.items())
    assert sum(r.ls[0] for r in rows.values()) == pytest.approx(df.agg(F.sum("a")).first()[0])
