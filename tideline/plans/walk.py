"""Walks over the blocks of a key in their order, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.plans.count_windows import WINDOW_ID, int_div
from tideline.plans.ordered import joined, ordered_map, out_batch
from tideline.scratch import materialise, scratch_path

_DOUBLES = T.ArrayType(T.DoubleType())
# Doubles of one key that a task reads in a part of a walk.
PART_DOUBLES = 16_000_000
# Window of the row that holds where a key stands; it comes before all blocks.
_HELD = -1
_PART = "_tl_part"


def _lists(pieces: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, pieces)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pieces), pa.float64()))


def walk_blocks(
    blocks: DataFrame,
    keys: Sequence[str],
    size: int,
    begin: Callable,
    extras: Sequence[str],
    periods: int,
    doubles: int,
    total: int,
    start: DataFrame | None = None,
) -> DataFrame:
    """Keys, window_id, ``extras`` (long) and kernels after each period of ``size`` rows.

    ``begin(state)`` gives the walker of a key, from null or from the doubles it had reached. It
    has ``take(acc)`` for the kernels of the next block, ``close(window)`` for the extra values and
    kernels of a period, and ``state()``. ``start`` (keys, ``state``) continues a feed.
    A walk is sequential; ``periods`` and ``doubles`` bound the periods of a key and the doubles
    of a period, ``total`` the periods of all keys. Where those of a key make more than
    ``PART_DOUBLES``, the walk goes on part by part: a task reads one part of a key, and what the key
    has reached is handed to the next part as a small table.
    """
    names, groups = [f"`{k}`" for k in keys], [*keys, "_tl_all"]
    schema = T.StructType(
        [blocks.schema[c] for c in keys]
        + [T.StructField(c, T.LongType()) for c in [WINDOW_ID, *extras]]
        + [T.StructField("kernels", _DOUBLES)]
    )
    arrow = to_arrow_schema(schema)

    def body_of(hand_on: bool):
        def reached(head, walker):
            columns = head | {WINDOW_ID: [_HELD]} | {e: [0] for e in extras}
            return out_batch(columns | {"kernels": _lists([walker.state()])}, arrow)

        def body(marked):
            walker = head = window = None
            n = 0
            for batch, flags in marked:
                windows, sizes = batch.column(WINDOW_ID).to_pylist(), batch.column("n").to_pylist()
                accs = batch.column("acc")
                values, ends = accs.flatten().to_numpy(zero_copy_only=False), accs.offsets.to_numpy()
                ends = (ends - ends[0]).tolist()
                at, pieces, given, states = [], [], [], []
                for i, first in enumerate(flags.tolist()):
                    acc = values[ends[i] : ends[i + 1]]
                    if first:
                        if hand_on and walker is not None:
                            states.append(reached(head, walker))
                        head = {k: batch.column(k).slice(i, 1) for k in keys}
                        window, held = None, windows[i] == _HELD
                        walker = begin(acc if held else None)
                        if held:
                            continue
                    if windows[i] != window:
                        window, n = windows[i], 0
                    walker.take(acc)
                    n += sizes[i]
                    if n == size:
                        more, kernels = walker.close(window)
                        at.append(i)
                        given.append(more)
                        pieces.append(kernels)
                yield from joined(states)
                if at:
                    rows = batch.take(pa.array(at, pa.int64()))
                    columns = {c: rows.column(c) for c in [*keys, WINDOW_ID]}
                    columns |= {e: [g[j] for g in given] for j, e in enumerate(extras)}
                    yield out_batch(columns | {"kernels": _lists(pieces)}, arrow)
            if hand_on and walker is not None:
                yield reached(head, walker)

        return body

    def walked(rows: DataFrame, held: DataFrame | None, hand_on: bool) -> DataFrame:
        if held is not None:
            rows = rows.unionByName(held)
        return ordered_map(
            rows.withColumn("_tl_all", F.lit(0)), groups, [WINDOW_ID, "block"], body_of(hand_on), schema,
            most=total if keys else 1,
        )

    def as_held(reached: DataFrame, value: str) -> DataFrame:
        return reached.select(
            *names, F.lit(_HELD).cast("long").alias(WINDOW_ID), F.lit(0).cast("long").alias("block"),
            F.lit(0).cast("long").alias("n"), F.col(value).alias("acc"),
        )

    sent = blocks.select(*names, WINDOW_ID, "block", "n", "acc")
    held = None if start is None else as_held(start, "state")
    each = max(1, PART_DOUBLES // doubles)
    if periods <= each:
        return walked(sent, held, False)
    path, spark = scratch_path(blocks.sparkSession, "parts"), blocks.sparkSession
    sent.withColumn(_PART, int_div(F.col(WINDOW_ID), each)).write.partitionBy(_PART).parquet(path)
    laid = spark.read.schema(sent.withColumn(_PART, F.lit(0).cast("long")).schema).parquet(path)
    parts, made = sorted(r[0] for r in laid.select(_PART).distinct().collect()), []
    for part in parts:
        rows = laid.where(F.col(_PART) == part).drop(_PART)
        done = materialise(walked(rows, held, part != parts[-1]), "walk")
        made.append(done.where(F.col(WINDOW_ID) != _HELD))
        held = as_held(done.where(F.col(WINDOW_ID) == _HELD), "kernels")
    return reduce(DataFrame.unionByName, made) if made else walked(sent, held, False)
