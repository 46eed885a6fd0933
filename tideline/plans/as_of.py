"""As-of join: for each row the last entry of a history at or before it, as a merge of ranges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.plans.arrival import as_names, same_keys
from tideline.plans.ordered import changes, out_batch
from tideline.scratch import materialise

# Entries of a history that are sent to every executor at most, in bytes.
_BROADCAST_BYTES = 64 << 20


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` as a broadcast if its counted size allows it."""
    return F.broadcast(table) if table.count() * row_bytes <= _BROADCAST_BYTES else table


def as_of_join(
    rows: DataFrame,
    history: DataFrame,
    time: str,
    since: str,
    by: str | Sequence[str] | None = None,
    values: Sequence[str] = (),
) -> DataFrame:
    """``rows`` with the ``values`` of the last entry of ``history`` whose ``since`` <= ``time``.

    Rows without such an entry get nulls. ``by`` columns must be equal, null equals null.
    Rows and entries are laid out together by one range shuffle on (by, time), so a key with
    most rows is spread; a partition then needs only the last entry of each of its keys from
    the partitions before it. Of entries with the same time any one is taken. Rows with a
    null time come before all entries.
    """
    keys = as_names(by)
    names = [f"_tl_b{i}" for i in range(len(keys))]
    row_type = T.StructType(rows.schema.fields)
    left = rows.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{time}`").alias("_tl_t"),
        F.lit(1).alias("_tl_kind"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_tl_row"),
    )
    picked = history.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{since}`").alias("_tl_t"),
        *[F.col(f"`{v}`").alias(f"_tl_v{i}") for i, v in enumerate(values)],
    ).where("_tl_t is not null")
    blank = [F.lit(None).cast(picked.schema[f"_tl_v{i}"].dataType).alias(f"_tl_v{i}") for i in range(len(values))]
    both = left.select("*", *blank).unionByName(
        picked.select("*", F.lit(0).alias("_tl_kind"), F.lit(None).cast(row_type).alias("_tl_row"))
    )
    ranked = [*names, "_tl_t", "_tl_kind"]
    laid = both.repartitionByRange(*ranked).sortWithinPartitions(*ranked)
    schema = T.StructType(
        [*laid.schema.fields, T.StructField("_tl_pos", T.LongType()), T.StructField("_tl_src", T.LongType())]
    )
    laid = materialise(laid.mapInArrow(_last_entries(names, to_arrow_schema(schema)), schema), "as_of")
    part = F.shiftright("_tl_pos", 33)
    entry = F.when(F.col("_tl_kind") == 0, F.col("_tl_pos"))
    ends = laid.groupBy(part.alias("_tl_pid"), *names).agg(F.max(entry).alias("_tl_end"))
    before = Window.partitionBy(*names).orderBy("_tl_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = materialise(ends.withColumn("_tl_carry", F.max("_tl_end").over(before)), "ends")
    ends = ends.where("_tl_carry is not null").select(
        "_tl_pid", *[F.col(n).alias(f"{n}r") for n in names], "_tl_carry"
    )
    match = part == F.col("_tl_pid")
    if keys:
        match = match & same_keys([F.col(n) for n in names], [F.col(f"{n}r") for n in names])
    found = laid.where("_tl_kind = 1").select("_tl_row", "_tl_pos", "_tl_src", *names)
    found = found.join(small(ends, 64), match, "left").select(
        "_tl_row", F.coalesce("_tl_src", "_tl_carry").alias("_tl_src")
    )
    entries = laid.where("_tl_kind = 0").select(
        F.col("_tl_pos").alias("_tl_src"), *[F.col(f"_tl_v{i}").alias(v) for i, v in enumerate(values)]
    )
    joined = found.join(small(entries, 16 + 64 * len(values)), "_tl_src", "left")
    return joined.select(*[F.col("_tl_row")[c].alias(c) for c in rows.columns], *[F.col(f"`{v}`") for v in values])


def _last_entries(names: Sequence[str], arrow: pa.Schema):
    """Add the place of each row, and that of the last entry of its key in the partition."""

    def run(batches):
        place, last, key = TaskContext.get().partitionId() << 33, -1, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            own = place + np.arange(n)
            place += n
            first = np.zeros(n, bool)
            for name in names:
                first[1:] |= changes(batch.column(name))
            now = [batch.column(name)[0].as_py() for name in names]
            first[0] = now != key
            key = [batch.column(name)[n - 1].as_py() for name in names]
            entry = batch.column("_tl_kind").to_numpy() == 0
            # Places grow, so the last entry of a key is the largest one since its first row.
            start = np.maximum.accumulate(np.where(first, own, -1))
            seen = np.maximum.accumulate(np.where(entry, own, -1))
            seen = np.maximum(seen, np.where(start < 0, last, -1))
            src = np.where((seen >= start) & (seen >= 0), seen, -1)
            last = int(src[-1])
            columns = {f: batch.column(f) for f in batch.schema.names}
            columns |= {"_tl_pos": own, "_tl_src": pa.array(src, mask=src < 0)}
            yield out_batch(columns, arrow)

    return run
