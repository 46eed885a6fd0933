"""Running combination of per-chunk summaries, as a tree of Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.plans.arrival import same_keys
from tideline.plans.count_windows import int_div
from tideline.plans.ordered import double_arrays, ordered_map, out_batch

_DOUBLES = T.ArrayType(T.DoubleType())


def exclusive_prefix(
    parts: DataFrame,
    keys: Sequence[str],
    fold: Callable,
    span: int,
    fan: int = 256,
) -> DataFrame:
    """Combine, for each (keys, ``idx``), the ``acc`` of all smaller ``idx``.

    ``parts`` holds (keys, ``idx``, ``acc array<double>``) with idx in
    [0, span). ``fold(earlier, later)`` combines two accumulators and must be
    associative for the result not to depend on ``fan``. The first row of a key
    gets null. No task walks more than ``fan`` rows of a key: longer chains are
    totalled in groups of ``fan``, the totals are combined the same way, and the
    groups then continue from their totals in parallel.
    """
    if span <= fan:
        return _scan(parts.withColumn("_tl_up", F.lit(0)), keys, fold, None)
    up = parts.withColumn("_tl_up", int_div(F.col("idx"), fan))
    totals = _totals(up, keys, fold)
    above = exclusive_prefix(
        totals.withColumnRenamed("_tl_up", "idx"), keys, fold, -(-span // fan), fan
    )
    return _scan(up, keys, fold, above)


def _totals(up: DataFrame, keys: Sequence[str], fold: Callable) -> DataFrame:
    schema = T.StructType(
        [up.schema[k] for k in keys]
        + [T.StructField("_tl_up", T.LongType()), T.StructField("acc", _DOUBLES)]
    )
    groups = [*keys, "_tl_up"]
    arrow = to_arrow_schema(schema)

    def body(marked):
        held, acc = None, None
        for batch, flags in marked:
            accs = [_vector(v) for v in batch.column("acc")]
            done = []
            for i, first in enumerate(flags):
                if first:
                    if held is not None:
                        done.append((held, acc))
                    held, acc = batch.slice(i, 1).select(groups), accs[i]
                else:
                    acc = fold(acc, accs[i])
            for row, value in done:
                yield _with_acc(row, value, arrow)
        if held is not None:
            yield _with_acc(held, acc, arrow)

    return ordered_map(up, groups, ["idx"], body, schema)


def _with_acc(row, acc, arrow):
    columns = {name: row.column(name) for name in row.schema.names}
    columns["acc"] = double_arrays([acc])
    return out_batch(columns, arrow)


def _vector(scalar):
    return None if not scalar.is_valid else scalar.values.to_numpy(zero_copy_only=False)


def _scan(up: DataFrame, keys: Sequence[str], fold: Callable, above: DataFrame | None) -> DataFrame:
    schema = T.StructType(
        [up.schema[k] for k in keys]
        + [T.StructField("idx", T.LongType()), T.StructField("acc", _DOUBLES)]
    )
    if above is not None:
        renamed = above.select(
            *[F.col(f"`{k}`").alias(f"_tl_a{i}") for i, k in enumerate(keys)],
            F.col("idx").alias("_tl_a_up"),
            F.col("acc").alias("_tl_carry"),
        )
        match = F.col("_tl_up") == F.col("_tl_a_up")
        if keys:
            match = match & same_keys(
                [F.col(f"`{k}`") for k in keys], [F.col(f"_tl_a{i}") for i in range(len(keys))]
            )
        up = up.join(renamed, match, "left")
    else:
        up = up.withColumn("_tl_carry", F.lit(None).cast(_DOUBLES))
    up = up.select(*[f"`{k}`" for k in keys], "_tl_up", "idx", "acc", "_tl_carry")
    arrow = to_arrow_schema(schema)

    def body(marked):
        acc = None
        for batch, flags in marked:
            accs = [_vector(v) for v in batch.column("acc")]
            carries = batch.column("_tl_carry")
            out = []
            for i, first in enumerate(flags):
                if first:
                    acc = _vector(carries[i])
                out.append(acc)
                acc = accs[i] if acc is None else fold(acc, accs[i])
            columns = {name: batch.column(name) for name in [*keys, "idx"]}
            columns["acc"] = double_arrays(out)
            yield out_batch(columns, arrow)

    return ordered_map(up, [*keys, "_tl_up"], ["idx"], body, schema)
