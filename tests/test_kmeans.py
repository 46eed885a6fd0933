import numpy as np
import pytest
from pyspark.mllib.clustering import KMeans, KMeansModel
from pyspark.sql import functions as F

from brute import kmeans
from tideline.config import KMeansOptions
from tideline.functions import format_center, nearest_center
from tideline.operators import (
    assign_clusters,
    cluster_weights,
    decay_centers,
    eval_split,
    held_out_ssq,
    kmeans_models,
    stream_kmeans,
    stream_kmeans_call,
)
from tideline.operators.kmeans import fit_kmeans
from tideline.plans import lloyd


def frame(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    points = np.round(rng.normal(size=(n, 2)) + 6 * rng.integers(0, 3, (n, 1)), 3)
    rows = [(i, "ab"[i % 3 == 0], float(p[0]), float(p[1])) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "seq long, k string, a double, b double"), points


def as_dict(models):
    return {
        r.window_id: (r.n, round(r.wssse, 7), [c and [round(v, 9) for v in c] for c in r.centers], r.weights)
        for r in models.collect()
    }


@pytest.mark.parametrize("gather", [lloyd.GATHER_DOUBLES, 0])
def test_first_k_matches_plain_lloyd(spark, gather):
    df, points = frame(spark, 130)
    options = KMeansOptions(
        batch_size=40, num_iterations=6, num_clusters=3, init="first_k", epsilon=0.0
    )
    models = fit_kmeans(df.repartition(4), ["a", "b"], "seq", options=options, gather=gather).models
    found = models.orderBy("window_id").collect()
    assert [r.window_id for r in found] == [0, 1, 2]
    for r in found:
        centers, cost = kmeans(points[40 * r.window_id : 40 * r.window_id + 40], 3, 6)
        assert np.allclose(r.centers, centers)
        assert r.wssse == pytest.approx(cost)
        assert sum(r.weights) == r.n == 40


@pytest.mark.parametrize("init", ["random", "parallel"])
def test_both_ways_agree(spark, init):
    df, _ = frame(spark, 120, 1)
    options = KMeansOptions(batch_size=60, num_iterations=5, num_clusters=3, init=init)
    one = as_dict(fit_kmeans(df, ["a", "b"], "seq", options=options).models)
    two = as_dict(fit_kmeans(df, ["a", "b"], "seq", options=options, gather=0).models)
    assert one == two and len(one) == 2
    again = as_dict(fit_kmeans(df.repartition(7), ["a", "b"], "seq", options=options).models)
    assert again == one


def test_matches_the_library_from_the_same_start(spark):
    df, points = frame(spark, 100, 2)
    options = KMeansOptions(batch_size=100, num_iterations=20, num_clusters=3, init="first_k")
    found = kmeans_models(df, ["a", "b"], "seq", options=options).first()
    rdd = spark.sparkContext.parallelize([p for p in points], 2)
    start = KMeansModel([points[i] for i in range(3)])
    model = KMeans.train(rdd, 3, maxIterations=20, initialModel=start, epsilon=1e-4)
    assert np.allclose(found.centers, model.clusterCenters)
    assert found.wssse == pytest.approx(model.computeCost(rdd))


@pytest.mark.parametrize("gather", [lloyd.GATHER_DOUBLES, 0])
@pytest.mark.parametrize("init", ["first_k", "random", "parallel"])
def test_fewer_points_than_clusters(spark, gather, init):
    rows = [(i, 1.0, 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, a double, b double")
    options = KMeansOptions(batch_size=20, num_iterations=3, num_clusters=3, init=init)
    fit = fit_kmeans(df, ["a", "b"], "seq", options=options, gather=gather)
    row = fit.models.first()
    assert row.centers == [[1.0, 2.0], None, None] and row.weights == [20.0, 0.0, 0.0]
    assert row.wssse == 0.0


def test_output_columns_and_text(spark):
    rows = [(i, 0.5 + 100 * (i % 2), 1e-5, "t") for i in range(5)]
    df = spark.createDataFrame(rows, "seq long, a double, b double, tag string")
    options = KMeansOptions(batch_size=4, num_iterations=3, num_clusters=3, init="first_k")
    out = stream_kmeans(df, ["a", "b"], "seq", options=options)
    assert out.columns == ["seq", "a", "b", "tag", "stderr", "center0", "center1", "center2"]
    row = out.first()
    assert (row.seq, row.stderr) == (3, 0.0)
    assert (row.center0, row.center1, row.center2) == ("0.5,1.0E-5", "100.5,1.0E-5", None)
    call = stream_kmeans_call(df, 0, 0, 4, 3, 2, 1, 0.95, "a", "b", order_by="seq")
    assert call.columns[-3:] == ["stderr", "center0", "center1"] and call.count() == 1


@pytest.mark.parametrize("gather", [lloyd.GATHER_DOUBLES, 0])
def test_sliding_windows_per_key(spark, gather):
    df, points = frame(spark, 90, 3)
    options = KMeansOptions(
        learn_type=1, window_shift=10, batch_size=25, num_iterations=3, num_clusters=2,
        init="first_k", epsilon=0.0,
    )
    found = fit_kmeans(df, ["a", "b"], "seq", "k", options, gather=gather).models.collect()
    for key in "ab":
        mine = np.array([p for i, p in enumerate(points) if "ab"[i % 3 == 0] == key])
        windows = {r.window_id: r for r in found if r.k == key}
        assert sorted(windows) == list(range((len(mine) - 25) // 10 + 1))
        for w, r in windows.items():
            centers, cost = kmeans(mine[10 * w : 10 * w + 25], 2, 3)
            assert np.allclose(r.centers, centers) and r.wssse == pytest.approx(cost)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_decay_matches_centres_by_distance(spark, alpha):
    rng = np.random.default_rng(4)
    rows, want, held = [], {}, None
    for w in range(9):
        spots = np.array([[0.0, 0.0], [50.0, 0.0], [0.0, 50.0]]) + rng.normal(size=(3, 2))
        order = rng.permutation(3)
        weights = rng.integers(1, 9, 3).astype(float)
        if w == 4:
            weights[1] = 0.0
        rows.append((w, [spots[i].tolist() if weights[i] else None for i in order], weights[order].tolist()))
        if held is None:
            held, first = [weights.copy(), spots.copy()], order
        else:
            n = held[0] * alpha + weights
            some = weights > 0
            held[1][some] = (
                (held[1] * held[0][:, None] * alpha + spots * weights[:, None])[some] / n[some, None]
            )
            held[0] = n
        want[w] = held[0][first].copy(), held[1][first].copy()
    df = spark.createDataFrame(
        rows, "window_id long, centers array<array<double>>, weights array<double>"
    )
    for part in (df, df.withColumn("k", F.lit("a"))):
        found = decay_centers(part.repartition(3), "k" if "k" in part.columns else None, alpha).collect()
        assert len(found) == 9
        for r in found:
            assert np.allclose(r.weights, want[r.window_id][0])
            assert np.allclose(r.centers, want[r.window_id][1])
    # A continued history gives the same.
    early = decay_centers(df.where("window_id < 5"), None, alpha)
    start = early.where("window_id = 4").select(F.col("history").alias("acc"))
    late = decay_centers(df.where("window_id >= 5"), None, alpha, start).collect()
    assert all(np.allclose(r.centers, want[r.window_id][1]) for r in late)


def test_decay_fills_empty_places(spark):
    rows = [(0, [[1.0], None], [3.0, 0.0]), (1, [[1.0], [9.0]], [2.0, 1.0]), (2, [None, None], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "window_id long, centers array<array<double>>, weights array<double>")
    found = {r.window_id: r for r in decay_centers(df, None, 0.5).collect()}
    assert found[0].centers == [[1.0], None] and found[1].centers == [[1.0], [9.0]]
    assert found[1].weights == [3.5, 1.0] and found[2].weights == [1.75, 0.5]


def test_assign_and_weights(spark):
    df, points = frame(spark, 60, 5)
    centers = [[0.0, 0.0], [6.0, 6.0], [12.0, 12.0]]
    out = assign_clusters(df, ["a", "b"], centers).orderBy("seq").collect()
    dist = ((points[:, None] - np.array(centers)[None]) ** 2).sum(axis=2)
    assert [r.cluster_id for r in out] == dist.argmin(axis=1).tolist()
    weights = {r.cluster_id: r for r in cluster_weights(df, ["a", "b"], centers).collect()}
    assert sum(r.weight for r in weights.values()) == 60
    assert sum(r.wssse for r in weights.values()) == pytest.approx(dist.min(axis=1).sum())


def test_ties_take_the_lowest_id_in_both_forms(spark):
    df = spark.createDataFrame([([0.0, 0.0], [[1.0, 0.0], None, [-1.0, 0.0]])], "x array<double>, c array<array<double>>")
    for k in (3, 1000):
        near = df.select(nearest_center(F.col("x"), F.col("c"), k, 2).alias("s")).first().s
        assert (near.dist, near.cid) == (1.0, 0)


def test_center_text_round_trip(spark):
    values = [[1e-5, 1e8, 0.1], [-1.0, 2.0 / 3.0, 0.0]]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "c array<double>")
    text = [r[0] for r in df.select(format_center(F.col("c"))).collect()]
    assert text[0] == "1.0E-5,1.0E8,0.1" and text[2] is None
    assert [float(v) for v in text[1].split(",")] == values[1]


def test_held_out_rows(spark):
    df, _ = frame(spark, 2000, 6)
    split = eval_split(df, "seq", 0.3)
    share = split.where("held_out").count() / 2000
    assert 0.25 < share < 0.35
    again = eval_split(df.repartition(5), "seq", 0.3)
    assert split.where("held_out").exceptAll(again.where("held_out")).count() == 0
    parts = {r.held_out: r for r in held_out_ssq(df, ["a", "b"], [[0.0, 0.0]], "seq", 0.3).collect()}
    assert parts[True].n + parts[False].n == 2000
    with pytest.raises(ValueError):
        eval_split(df, "seq", 1.5)
