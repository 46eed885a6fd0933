"""Column expressions over ``array<double>`` values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BUCKETS = 1 << 30


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance between two arrays of equal length."""
    return F.aggregate(
        F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v
    )


def nearest_center(x: Column, centers: Column, k: int, dims: int) -> Column:
    """``struct<dist, cid>`` of the centre closest to ``x``; ties take the lowest id.

    Missing centres (null) never win. Small problems are written out term by
    term, which keeps them inside generated code; larger ones use array lambdas.
    """
    if k * dims <= 48:
        options = []
        for i in range(k):
            center = F.get(centers, i)
            terms = [(x[j] - center[j]) * (x[j] - center[j]) for j in range(dims)]
            dist = reduce(lambda s, t: s + t, terms)
            options.append(
                F.when(center.isNotNull(), F.struct(dist.alias("dist"), F.lit(i).alias("cid")))
            )
        return options[0] if k == 1 else F.least(*options)
    return F.array_min(
        F.filter(
            F.transform(
                centers,
                lambda c, i: F.when(
                    c.isNotNull(),
                    F.struct(squared_distance(x, c).alias("dist"), i.alias("cid")),
                ),
            ),
            lambda s: s.isNotNull(),
        )
    )


def format_center(center: Column) -> Column:
    """Coordinates joined by commas, as one string; null for a missing centre."""
    text = F.concat_ws(",", F.transform(center, lambda v: v.cast("string")))
    return F.when(center.isNotNull(), text)


def text_unit(*parts: Column) -> Column:
    """Uniform value in [0, 1) from the MD5 of the parts' text, as any SQL engine computes it."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def hash_unit(*parts: Column) -> Column:
    """Uniform value in [0, 1) that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(_BUCKETS)) / F.lit(float(_BUCKETS))
