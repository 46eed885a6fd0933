"""Row feeds and their static twins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def row_schema(columns: Sequence[str], order: Sequence[str] = ()) -> T.StructType:
    """Long order columns followed by double data columns."""
    return T.StructType(
        [T.StructField(c, T.LongType()) for c in order]
        + [T.StructField(c, T.DoubleType()) for c in columns]
    )


def read_csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless comma-separated rows; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)


def stream_csv_rows(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1
) -> DataFrame:
    """The files of a folder as a feed, oldest first."""
    return (
        spark.readStream.schema(schema)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(path)
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def stream_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a feed; ``pattern`` selects among the files."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Write a result or a model history as Parquet or headerless CSV.

    Arrays have no CSV form and are written as text.
    """
    if fmt == "csv":
        df = df.select(
            *[
                df[f"`{f.name}`"].cast("string").alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
                else df[f"`{f.name}`"]
                for f in df.schema.fields
            ]
        )
    df.write.mode(mode).format(fmt).save(path)
