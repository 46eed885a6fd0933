"""Snapshots, kernels as a tree, scoring by earlier models, held-out rows, histories of feeds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.config import KMeansOptions, LinRegOptions, MicroClusterOptions
from tideline.feeds import LinRegStream, MicroClusterStream, run_stream
from tideline.operators import (
    horizon_clusters,
    kmeans_held_out,
    kmeans_models,
    linreg_models,
    linreg_prequential,
    microcluster_models,
    score_as_of,
)
from tideline.plans import walk
from tideline.plans.as_of import as_of_join
from tideline.plans.gram import drawn_products, gram_stats
from tideline.plans.kernels import Kernels, reduce_kernels
from tideline.plans.pyramid import Pyramid, order_of
from test_feeds import CUTS, feed, frame, pieces


def kernel_sums(kernels, dims=2):
    return np.array(kernels).reshape(-1, 2 * dims + 3).sum(axis=0)


def test_a_pyramid_keeps_few_snapshots_and_near_ones():
    pyramid = Pyramid(2, 2)
    for t in range(1, 1001):
        pyramid.take(t, np.zeros((1, 3)))
        for back in (1, 2, 4, 100, 700):
            if t > back:
                found = pyramid.since(t - back)
                age = t if found is None else t - found[0]
                assert age <= max(2 * back, back + 1)
                assert back > 4 or age == back
    assert len(pyramid.shots) <= 5 * 10
    assert [order_of(t, 3) for t in (1, 3, 18, 27)] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        Pyramid(1)


def test_subtraction_follows_merged_and_dropped_kernels():
    """All rows after the snapshot that are still held, and no others."""
    rng = np.random.default_rng(0)
    pyramid = Pyramid()
    held = Kernels(np.empty((0, 5)), 6, 2.0, 10**9, 1, pyramid.moved)
    rows = [np.array([[1.0, i, i * i, x, x * x]]) for i, x in enumerate(rng.normal(size=300).cumsum())]
    for i, row in enumerate(rows):
        held.take(row)
        if (i + 1) % 20 == 0:
            pyramid.take((i + 1) // 20, held.used())
    for time, _, _ in pyramid.shots:
        after = Pyramid.after(held.used(), pyramid.since(time))
        want = np.concatenate(rows[20 * time :]).sum(axis=0) if 20 * time < 300 else np.zeros(5)
        assert np.allclose(after.sum(axis=0), want, atol=1e-6)


@pytest.mark.parametrize("keys", [None, "k"])
def test_clusters_of_the_last_rows(spark, keys):
    df = frame(spark, 400, seed=2)
    options = MicroClusterOptions(batch_size=20, num_clusters=2, max_kernels=8, horizon=10**9, block_rows=7)
    found = horizon_clusters(df, ["x0", "x1"], "seq", 60, keys, options).collect()
    rows = df.orderBy("seq").collect()
    for r in found:
        own = [x for x in rows if keys is None or x.k == r.k]
        assert r.since <= max(0, (r.window_id + 1) * 20 - 60) and r.n == (r.window_id + 1) * 20 - r.since
        assert r.since == max(0, (r.window_id + 1) * 20 - 60)  # three periods: exact
        part = np.array([[x.x0, x.x1] for x in own[r.since : (r.window_id + 1) * 20]])
        assert np.allclose(kernel_sums(r.kernels)[3:], [*part.sum(axis=0), *(part**2).sum(axis=0)])
        assert len(r.centers) == 2


def test_rows_of_dropped_kernels_are_in_neither(spark):
    df = frame(spark, 300, seed=3)
    options = MicroClusterOptions(batch_size=10, max_kernels=4, horizon=15, num_clusters=1, radius_factor=0.1)
    for r in horizon_clusters(df, ["x0", "x1"], "seq", 50, options=options).collect():
        assert 0 < r.n <= (r.window_id + 1) * 10 - r.since and (np.array(r.kernels).reshape(-1, 7)[:, 0] > 0).all()


def blobs(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, 5, n)
    x = np.array([[0, 0], [9, 0], [0, 9], [9, 9], [4, 4]])[at] + rng.normal(size=(n, 2)) * 0.4
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "seq long, x0 double, x1 double")


def test_a_tree_costs_little_more_than_the_walk(spark):
    """Sums of all rows are exact, and the error is within a quarter of the walk's."""
    df = blobs(spark, 3000)
    common = dict(batch_size=50, num_clusters=5, max_kernels=20, num_iterations=10, horizon=10**9)
    tree = microcluster_models(df, ["x0", "x1"], "seq", options=MicroClusterOptions(mode="tree", block_rows=30, **common))
    walk = microcluster_models(df, ["x0", "x1"], "seq", options=MicroClusterOptions(**common))
    points = np.array([[r.x0, r.x1] for r in df.orderBy("seq").collect()])
    found = {r.window_id: r for r in tree.collect()}
    assert sorted(found) == list(range(60))
    cost = {"tree": 0.0, "walk": 0.0}
    for r in walk.collect():
        end = (r.window_id + 1) * 50
        sums = kernel_sums(found[r.window_id].kernels)
        assert sums[0] == end and np.allclose(sums[3:5], points[:end].sum(axis=0))
        for name, row in (("tree", found[r.window_id]), ("walk", r)):
            kernels = np.array(row.kernels).reshape(-1, 7)
            assert len(kernels) <= 20
            # Squared error of the kernels as a summary: what is lost inside them.
            cost[name] += (kernels[:, 5:].sum(axis=1) - (kernels[:, 3:5] ** 2).sum(axis=1) / kernels[:, 0]).sum()
    assert cost["tree"] <= 1.25 * cost["walk"]


def test_no_task_of_the_tree_walks_a_key(spark, monkeypatch):
    """The rows that one group reads in sequence are bounded, however long the only key."""
    from tideline.operators import microcluster
    from tideline.plans import prefix

    longest = []
    plain = prefix.ordered_map

    def watched(df, groups, order, body, schema, most=None):
        counts = df.groupBy(*[f"`{g}`" for g in groups]).count().agg(F.max("count")).first()[0]
        longest.append(counts)
        return plain(df, groups, order, body, schema, most)

    monkeypatch.setattr(prefix, "ordered_map", watched)
    options = MicroClusterOptions(batch_size=5, max_kernels=4, num_clusters=1, mode="tree")
    found = microcluster_models(blobs(spark, 2000), ["x0", "x1"], "seq", options=options)
    assert found.count() == 400
    assert longest and max(longest) <= microcluster._FAN


def test_reduced_kernels_keep_all_sums():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(1, 5, (9, 7)), rng.uniform(1, 5, (12, 7))
    out = reduce_kernels(a.ravel(), b.ravel(), 6, 2).reshape(-1, 7)
    assert len(out) <= 6 and np.allclose(out.sum(axis=0), a.sum(axis=0) + b.sum(axis=0))
    with pytest.raises(ValueError):
        MicroClusterOptions(mode="other")
    with pytest.raises(ValueError):
        MicroClusterStream(["x"], "seq", options=MicroClusterOptions(mode="tree"))


@pytest.mark.parametrize("shift, keys", [(8, None), (8, "k"), (3, "k")])
def test_rows_are_scored_by_the_model_before_them(spark, shift, keys):
    df = frame(spark, 90, seed=7)
    options = LinRegOptions(learn_type=int(shift != 8), window_shift=shift, batch_size=8, num_iterations=3, step_size=0.05)
    models = {(getattr(m, "k", None), m.window_id): m.weights for m in linreg_models(df, "y", ["x0", "x1"], "seq", keys, options).collect()}
    seen = {}
    rows = {r.seq: r for r in linreg_prequential(df, "y", ["x0", "x1"], "seq", keys, options).collect()}
    assert len(rows) == 90
    for i in range(90):
        r = rows[i]
        key = r.k if keys else None
        n = seen.get(key, 0)
        seen[key] = n + 1
        last = (n - 8) // shift if n >= 8 else None
        assert r.model_window == last
        if last is not None:
            w = models[key, last]
            assert np.isclose(r.prediction, w[0] * r.x0 + w[1] * r.x1)
        else:
            assert r.prediction is None


def test_as_of_join_matches_a_plain_search(spark):
    rng = np.random.default_rng(4)
    rows = [(int(t), ["a", "b", None][i % 3], i) for i, t in enumerate(rng.integers(0, 200, 400))] + [(None, "a", 400)]
    history = [(int(t), ["a", None][i % 2], float(t)) for i, t in enumerate(rng.permutation(220)[:25])]
    left = spark.createDataFrame(rows, "t long, k string, i int").repartition(5)
    right = spark.createDataFrame(history, "since long, k string, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.i: r.v for r in as_of_join(left, right, "t", "since", "k", ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 401
    for t, k, i in rows:
        past = [s for s, key, _ in history if t is not None and key == k and s <= t]
        assert found[i] == (float(max(past)) if past else None)
    none = as_of_join(left, right.limit(0), "t", "since", None, ["v"])
    assert none.count() == 401 and none.where("v is not null").count() == 0


def test_scores_as_of_a_time(spark):
    rows = spark.createDataFrame([(1, 2.0), (5, 3.0), (9, 4.0)], "t long, x double")
    models = spark.createDataFrame([(4, 1.0, 10.0), (9, 0.0, -1.0)], "window_end long, beta0 double, beta1 double")
    found = {r.t: (r.model_since, r.prediction) for r in score_as_of(rows, ["x"], models, "t").collect()}
    assert found == {1: (None, None), 5: (4, 31.0), 9: (9, -4.0)}


@pytest.mark.parametrize("keys", [None, "k"])
def test_held_out_rows_teach_nothing(spark, keys):
    df = frame(spark, 120, seed=8)
    options = KMeansOptions(batch_size=15, num_clusters=2, num_iterations=4, init="first_k", epsilon=0.0)
    found = kmeans_held_out(df, ["x0", "x1"], "seq", 0.4, keys, options).collect()
    assert found and all(r.n_train + r.n_held == 15 for r in found)
    assert 0 < sum(r.n_held for r in found) < 15 * len(found)
    whole = kmeans_held_out(df, ["x0", "x1"], "seq", 0.0, keys, options)
    plain = kmeans_models(df, ["x0", "x1"], "seq", keys, options)
    names = ["window_id", *([keys] if keys else [])]
    pairs = whole.join(plain, names).select("ssq_train", "wssse", "n_held").collect()
    assert pairs and all(np.isclose(a, b) and n == 0 for a, b, n in pairs)
    none = kmeans_held_out(df, ["x0", "x1"], "seq", 1.0, keys, options).collect()
    assert all(r.n_train == 0 and r.centers is None and r.ssq_held is None for r in none) and none


def test_history_of_a_feed_is_written_with_its_rows(spark, tmp_path):
    df = frame(spark, 130, seed=9)
    pieces(df, f"{tmp_path}/in", CUTS)
    op = LinRegStream("y", ["x0", "x1"], "seq", "k", LinRegOptions(batch_size=8, num_iterations=5, step_size=0.05))
    run_stream(
        op, feed(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/state", history_to=f"{tmp_path}/models",
    ).awaitTermination()
    back = spark.read.option("header", True).csv(f"{tmp_path}/models")
    got = {(r.k, int(r.window_id)): [float(v) for v in r.weights.strip("[]").split(",")] for r in back.collect()}
    want = {(r.k, r.window_id): r.weights for r in linreg_models(df, "y", ["x0", "x1"], "seq", "k", op.options).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_drawn_rows_are_not_copied(spark):
    """The plan of a mini-batch descent neither expands nor generates rows."""
    from tideline.plans.arrival import RN
    from tideline.plans.count_windows import CountWindows

    rows = spark.range(64).select(
        F.col("id").alias(RN), F.rand(1).alias("_tl_y"), F.rand(2).alias("_tl_x0"), F.rand(3).alias("_tl_x1")
    )
    stats = gram_stats(rows, [], 2, CountWindows(16, 16), 5, 0.5, 42)
    plan = stats._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan
    assert stats.count() == 4 * 6
    z = np.array([[1.0, 2.0, 3.0], [1.0, 5.0, 7.0]])
    assert drawn_products(z, np.array([[1, 0], [1, 1]])).tolist() == [[2, 29, 41, 58], [1, 25, 35, 49]]


@pytest.mark.parametrize("keys", [None, "k"])
def test_a_walk_in_parts_equals_the_whole(spark, monkeypatch, keys):
    """A task read the kernels of all periods of a key; now it reads a part of them."""
    df = frame(spark, 300, seed=8)
    options = MicroClusterOptions(batch_size=10, num_clusters=2, max_kernels=4, horizon=90, block_rows=7)

    def run():
        recent = horizon_clusters(df, ["x0", "x1"], "seq", 40, keys, options)
        models = microcluster_models(df, ["x0", "x1"], "seq", keys, options)
        order = [*([keys] if keys else []), "window_id"]
        return [f.orderBy(*order).collect() for f in (recent, models)]

    whole, read = run(), []
    ordered_map = walk.ordered_map

    def counted(rows, *args, **more):
        read.append(rows.where("window_id >= 0").count())
        return ordered_map(rows, *args, **more)

    monkeypatch.setattr(walk, "ordered_map", counted)
    monkeypatch.setattr(walk, "PART_DOUBLES", 5 * 2 * 4 * 7)
    assert run() == whole
    # Five periods of two blocks each, for three keys at most.
    assert len(read) >= 6 and max(read) <= 5 * 2 * (3 if keys else 1)


def test_snapshots_survive_a_hand_over():
    rng = np.random.default_rng(2)
    pyramid, other = Pyramid(), Pyramid()
    for t in range(1, 30):
        pyramid.take(t, rng.normal(size=(1 + t % 3, 5)))
    pyramid.moved(1, 0)
    other.restore(pyramid.flat(), 5)
    assert [s[0] for s in other.shots] == [s[0] for s in pyramid.shots]
    for a, b in zip(pyramid.shots, other.shots):
        assert np.array_equal(a[1], b[1]) and np.array_equal(a[2], b[2])
