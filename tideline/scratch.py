"""Tables written once and read several times within one operator call.

Several steps need every later pass to see exactly the same rows in the same
partitions. A table in the shared checkpoint folder gives that, survives the
loss of executors, and keeps column pruning for the passes that read it.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[list | None] = ContextVar("tideline_scratch", default=None)


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tideline-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors share"
        )
    # One machine: beside the tables of the session.
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tideline-{app}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch table and return a reader of it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that owns it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the intermediate tables made inside the block when it ends.

    Frames returned by operators read those tables, so run their actions inside.
    """
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            delete_path(spark, path)


@contextmanager
def scratch_list(made: list[str]):
    """Add the paths of the tables made inside the block to ``made``; nothing is deleted."""
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    Call it when the frames returned by the operators are no longer needed.
    """
    delete_path(spark, scratch_root(spark))
