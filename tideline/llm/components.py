"""Connected components of a link table, by alternating star contractions.

Each round hangs the larger neighbours of every node on its smallest neighbour, then
the smaller ones. The number of rounds grows with the logarithm of the longest chain.
Links stay in tables; only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.scratch import materialise


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One contraction over links (a, b) with a > b."""
    around = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    joined = around.join(least, "a").withColumn("m", F.least("a", "m"))
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").union(joined.select("a", "m")).toDF("a", "b")
    return out.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that a link names; the component is its smallest node.

    ``links`` holds any pairs of comparable values in one type; links to itself and
    repeated links do no harm, links with a null are ignored.
    """
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    held = materialise(pairs.where("a != b").distinct(), "links")
    seen = None
    while True:
        held = materialise(_stars(_stars(held, True), False), "links")
        row = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == tuple(row):
            break
        seen = tuple(row)
    own = links.select(F.col(a).alias("node")).union(links.select(F.col(b))).where("node is not null")
    return (
        own.distinct().join(held, F.col("node") == F.col("a"), "left")
        .select("node", F.coalesce("b", "node").alias("component"))
    )
