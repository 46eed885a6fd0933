"""Dense arrival index: the position of every row in a caller-given order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.scratch import materialise

RN = "_tl_rn"
# Puts the rows a feed kept before those of its new micro-batch, in their old order.
SEQ = "_tl_seq"
_POS = "_tl_pos"
_TIE = "_tl_tie"
# The position column holds the partition number above its lowest 33 bits.
_PARTITION_SHIFT = 33
# Largest table of per-key offsets that is sent to every executor.
_BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Arrived:
    """Indexed rows, one more than the highest index of any key, and their number."""

    rows: DataFrame
    longest: int
    total: int


def as_names(columns: str | Sequence[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two key lists."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.AtomicType, T.NumericType, T.StringType, T.NullType)) and not (
        isinstance(dtype, T.VariantType)
    )


def arrival_index(
    df: DataFrame,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    base: DataFrame | None = None,
    name: str = RN,
) -> Arrived:
    """Add ``name``: 0, 1, 2 … in ``order_by`` order, separately per key.

    Rows are range-partitioned on (keys, order), so a key that holds most of
    the table is spread over many partitions. They are written out once; each
    partition then needs only the number of rows of its key in the partitions
    before it, which is one small row per (partition, key). Rows that tie on
    ``order_by`` are ordered by a hash of the whole row.

    A column ``SEQ`` goes before ``order_by``. ``base`` (keys, ``base``) shifts the index of a key, for a feed that
    continues earlier rows.
    """
    order = as_names(order_by)
    keys = as_names(partition_by)
    if not order:
        raise ValueError("order_by is required: a table has no arrival order")
    # Maps can not be hashed.
    fields = [f.name for f in df.schema.fields if f.name != SEQ and _hashable(f.dataType)]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in fields])
    lead = [SEQ] if SEQ in df.columns else []
    ranked = [F.col(f"`{c}`") for c in [*keys, *lead, *order]] + [F.col(_TIE)]
    laid = materialise(
        df.withColumn(_TIE, tie)
        .repartitionByRange(*ranked)
        .sortWithinPartitions(*ranked)
        .drop(_TIE)
        .withColumn(_POS, F.monotonically_increasing_id()),
        "arrival",
    )

    counts = _run_counts(laid, keys)
    offsets, longest, total = (
        _keyed_offsets(counts, keys, base) if keys else _plain_offsets(counts, base)
    )
    match = F.shiftright(_POS, _PARTITION_SHIFT) == F.col("_tl_pid")
    if keys:
        match = match & same_keys(
            [F.col(f"`{k}`") for k in keys], [F.col(f"_tl_k{i}") for i in range(len(keys))]
        )
    rows = laid.join(offsets, match).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col(_POS) + F.col("_tl_offset")).alias(name),
    )
    return Arrived(rows, longest, total)


def _run_counts(laid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key in each partition of the sorted table."""
    return laid.groupBy(
        F.shiftright(_POS, _PARTITION_SHIFT).alias("_tl_pid"),
        *[F.col(f"`{k}`").alias(f"_tl_k{i}") for i, k in enumerate(keys)],
    ).agg(F.count("*").alias("_tl_n"), F.min(_POS).alias("_tl_first"))


def _plain_offsets(counts: DataFrame, base: DataFrame | None) -> tuple[DataFrame, int, int]:
    # One small row per partition of the sorted table, whatever the table holds.
    spark = counts.sparkSession
    head = base.first() if base is not None else None
    seen = head["base"] if head is not None else 0
    pids, offsets = [], []
    for pid, n, first in sorted(counts.collect()):
        pids.append(pid)
        offsets.append(seen - first)
        seen += n
    table = pa.table(
        {"_tl_pid": pa.array(pids, pa.int64()), "_tl_offset": pa.array(offsets, pa.int64())}
    )
    total = seen - (head["base"] if head is not None else 0)
    return F.broadcast(spark.createDataFrame(table)), seen, total


def _keyed_offsets(
    counts: DataFrame, keys: Sequence[str], base: DataFrame | None
) -> tuple[DataFrame, int, int]:
    names = [f"_tl_k{i}" for i in range(len(keys))]
    before = F.sum("_tl_n").over(
        Window.partitionBy(*names).orderBy("_tl_pid").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = counts.withColumn("_tl_before", F.coalesce(before, F.lit(0)))
    if base is not None:
        shifts = base.select(
            *[F.col(f"`{k}`").alias(f"_tl_b{i}") for i, k in enumerate(keys)],
            F.col("base").alias("_tl_base"),
        )
        match = same_keys(
            [F.col(n) for n in names], [F.col(f"_tl_b{i}") for i in range(len(keys))]
        )
        runs = runs.join(shifts, match, "left").withColumn(
            "_tl_before", F.col("_tl_before") + F.coalesce(F.col("_tl_base"), F.lit(0))
        )
    runs = materialise(
        runs.select(
            "_tl_pid",
            *names,
            (F.col("_tl_before") - F.col("_tl_first")).alias("_tl_offset"),
            (F.col("_tl_before") + F.col("_tl_n")).alias("_tl_end"),
            "_tl_n",
        ),
        "runs",
    )
    key_bytes = F.sum(F.octet_length(F.to_json(F.struct(*names))))
    longest, total, count, size = runs.agg(
        F.max("_tl_end"), F.sum("_tl_n"), F.count("*"), key_bytes
    ).first()
    offsets = runs.drop("_tl_end", "_tl_n")
    if (size or 0) + 32 * count <= _BROADCAST_BYTES:
        # Joining on the partition and key would move all rows once more.
        offsets = F.broadcast(offsets)
    return offsets, longest or 0, total or 0
