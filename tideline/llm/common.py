"""Helpers that the text operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the bytes that ``bytes.split()`` cuts at.
SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: texts are long, and a task holds a few batches.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of what goes to Python at once, unless the session sets less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Identifier and text under fixed names, so that other columns cannot clash; null is empty."""
    bounded_batches(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
        *[F.col(f"`{c}`").alias(f"_{c}") for c in more],
    )


def id_type(df: DataFrame, id_col: str) -> str:
    """Type of the identifiers in a schema: operators pass them on as they are."""
    return df.schema[id_col].dataType.simpleString()


def ddl(df: DataFrame, names: tuple[str, ...]) -> str:
    """Further columns of a schema: those of ``df``, under the names that texts() gives them."""
    return "".join(f", `_{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def with_more(b: pa.RecordBatch, source: pa.RecordBatch, names: tuple[str, ...]) -> pa.RecordBatch:
    """``b`` with columns of the batch it came from, row by row."""
    arrays = [*b.columns, *(source.column(f"_{c}") for c in names)]
    return pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, *(f"_{c}" for c in names)])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def per_worker(key: tuple, make: Callable):
    """An object that a Python worker keeps from task to task, made at the first use."""
    kept = sys.modules.setdefault("_tideline_worker", types.ModuleType("_tideline_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def by_size(items: Iterator, weight, most: int) -> Iterator[list]:
    """Lists of consecutive items whose weights add up to ``most``, or single larger items."""
    held, total = [], 0
    for item in items:
        w = weight(item)
        if held and total + w > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += w
    if held:
        yield held


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)],
        schema=schema,
    )


#: Size of the filters below: 2**24 bits are 2 MB, whatever the input.
FILTER_BITS = 24


def key_filter(keys: DataFrame, *columns: str) -> DataFrame:
    """A Bloom filter over rows: at most 2**FILTER_BITS bits, in words of 64.

    It only spares work. A row it lets through may be absent from ``keys``; the more
    keys there are, the less it spares.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("_bits"))
    )


def with_filter(rows: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``_maybe``, false only if their key is not in the filter."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))
    rows = rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
    return (
        rows.join(F.broadcast(words), "_word", "left")
        .withColumn(
            "_maybe",
            F.expr("coalesce((_bits & shiftleft(1L, cast(_slot % 64 as int))) != 0, false)"),
        )
        .drop("_slot", "_word", "_bits")
    )
