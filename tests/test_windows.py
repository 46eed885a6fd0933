import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.config import LinRegOptions
from tideline.operators import stream_linreg
from tideline.plans.arrival import RN, arrival_index
from tideline.plans.count_windows import PANE, WINDOW_ID, CountWindows, window_sums
from tideline.plans.rows import array_elements, one_row, with_one_row

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def test_index_equals_row_number(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(*KEY)
    found = arrival_index(rows, KEY)
    wanted = rows.withColumn("want", F.row_number().over(Window.orderBy(*KEY)) - 1)
    both = found.rows.join(wanted, KEY)
    assert both.count() == rows.count() == found.longest == found.total
    assert both.where(F.col(RN) != F.col("want")).count() == 0


def test_index_of_a_hot_key_spans_partitions(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
        ).alias("k"),
        ((F.col("id") * 7919) % 6000).alias("seq"),
    ).withColumn("k", F.when(F.col("seq") % 97 > 0, F.col("k")))
    found = arrival_index(rows, "seq", "k")
    want = F.row_number().over(Window.partitionBy("k").orderBy("seq")) - 1
    wrong = found.rows.withColumn("want", want).where(F.col(RN) != F.col("want"))
    assert wrong.count() == 0
    assert found.rows.count() == found.total == 6000
    assert found.longest == rows.groupBy("k").count().agg(F.max("count")).first()[0]


def test_index_continues_from_a_base(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, seq int")
    base = spark.createDataFrame([("a", 10)], "k string, base long")
    found = {(r.k, r.seq): r[RN] for r in arrival_index(rows, "seq", "k", base).rows.collect()}
    assert found == {("a", 1): 10, ("a", 3): 11, ("b", 2): 0}
    base = spark.createDataFrame([(5,)], "base long")
    found = sorted(r[RN] for r in arrival_index(rows, "seq", None, base).rows.collect())
    assert found == [5, 6, 7]


def test_ties_and_partitioning_do_not_change_the_index(spark):
    data = [(i % 5, i, [float(i)], {"m": i}) for i in range(200)]
    random.Random(1).shuffle(data)
    frame = spark.createDataFrame(data, "seq int, v int, a array<double>, m map<string,int>")
    seen = set()
    for parts in (1, 3, 7):
        found = arrival_index(frame.repartition(parts), "seq").rows.collect()
        seen.add(tuple(sorted((r[RN], r.v) for r in found)))
    assert len(seen) == 1
    assert [rn for rn, _ in next(iter(seen))] == list(range(200))


def test_order_is_required_and_empty_input_works(spark):
    rows = spark.createDataFrame([], "k string, seq int")
    with pytest.raises(ValueError):
        arrival_index(rows, [])
    assert arrival_index(rows, "seq").rows.count() == 0
    assert arrival_index(rows, "seq", "k").longest == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 60))
def test_window_sums_equal_direct_sums(spark, size, shift, n):
    if shift > size:
        size, shift = shift, size
    windows = CountWindows(size, shift)
    rows = spark.range(n).select(
        F.explode(F.array(F.lit("a"), F.lit(None))).alias("k"),
        F.col("id").alias(RN),
        (F.col("id") * F.col("id")).cast("double").alias("v"),
    )
    panes = (
        rows.withColumn(PANE, windows.pane_of(F.col(RN)))
        .groupBy("k", PANE)
        .agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    )
    fast = window_sums(panes, ["k"], ["n", "v"], windows).where(F.col("n") == size)
    slow = windows.members(rows).groupBy("k", WINDOW_ID).agg(
        F.count("*").alias("n"), F.sum("v").alias("v")
    ).where(F.col("n") == size)
    a = sorted(map(repr, map(tuple, fast.select("k", WINDOW_ID, "n", "v").collect())))
    b = sorted(map(repr, map(tuple, slow.select("k", WINDOW_ID, "n", "v").collect())))
    assert a == b
    assert len(a) == 2 * windows.count(n)
    closing = rows.where(windows.closes(F.col(RN))).select(windows.closed_by(F.col(RN)))
    assert sorted(r[0] for r in closing.distinct().collect()) == list(range(windows.count(n)))


@pytest.mark.parametrize("name", ["stderr", "weights", "intercept", "window_id", "beta0", "n"])
def test_results_and_clashing_names_can_be_inputs(spark, name):
    rows = [(i, "ab"[i % 2], float(i % 7), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, k string, y double, x double")
    options = LinRegOptions(batch_size=5, num_iterations=3, step_size=0.01)
    plain = stream_linreg(df, "y", ["x"], "seq", "k", options).drop("k")
    as_key = stream_linreg(df.withColumnRenamed("k", name), "y", ["x"], "seq", name, options)
    extra = stream_linreg(df.withColumn(name, F.lit(1)), "y", ["x"], "seq", "k", options)
    made = ["seq", "stderr", "beta0", "beta1"]
    want = sorted(map(tuple, plain.select(*made).collect()))
    assert sorted(map(tuple, as_key.select(*made).collect())) == want
    assert sorted(map(tuple, extra.select(*made).collect())) == want
    again = stream_linreg(plain, "beta1", ["stderr"], "seq", None, options)
    assert again.count() == 1 and again.columns == ["seq", "y", "x", *made[1:]]


def test_arrays_of_another_length_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "seq long, v array<double>")
    assert df.select(*array_elements("v", 2)).collect()[1][0] is None
    with pytest.raises(Exception, match="does not have 3 elements"):
        df.select(*array_elements("v", 3)).collect()


def test_one_row_is_checked(spark):
    assert one_row(spark.range(0)) is None
    assert with_one_row(spark.range(3), spark.range(1).toDF("x")).count() == 3
    assert with_one_row(spark.range(3), spark.range(0).toDF("x")).columns == ["id", "x"]
    with pytest.raises(ValueError):
        one_row(spark.range(2))
