"""Count-window operators over unbounded feeds.

Rows are numbered in the order of their arrival: by micro-batch, and by ``order_by``
within one. No row is lost. Each micro-batch continues where the last one stopped. What it needs is kept in
a versioned folder: the rows of windows not complete yet, the position of every
key, and the model. Version n is written by micro-batch n from version n-1, so a
micro-batch that is replayed after a failure gives the same result again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.config import KMeansOptions, LinRegOptions, MicroClusterOptions
from tideline.operators.kmeans import center_columns, fit_kmeans
from tideline.operators.linreg import beta_columns, fit_linreg
from tideline.operators.microcluster import fit_microclusters, next_history
from tideline.plans.arrival import RN, SEQ, as_names, same_keys
from tideline.plans.count_windows import WINDOW_ID, CountWindows
from tideline.plans.rows import as_columns, attach_models, with_one_row
from tideline.scratch import delete_path, materialise, scratch_scope


@dataclass
class Step:
    """What one micro-batch produced."""

    rows: DataFrame
    output: DataFrame
    windows: CountWindows
    state: DataFrame | None
    models: DataFrame


@dataclass
class LinRegStream:
    """Regression over a feed."""

    y: str | Column
    xs: Sequence[str | Column]
    order_by: str | Sequence[str]
    partition_by: str | Sequence[str] | None = None
    options: LinRegOptions = field(default_factory=LinRegOptions)
    on_null: str = "error"

    def step(self, rows: DataFrame, base: DataFrame | None, state: DataFrame | None) -> Step:
        fit = fit_linreg(
            rows, self.y, self.xs, self.order_by, self.partition_by,
            self.options, self.on_null, base, state,
        )
        output = attach_models(
            fit.rows, fit.models, fit.keys, fit.windows, beta_columns(len(as_columns(self.xs)))
        )
        last = last_of(fit.models, fit.keys, F.col("weights").alias("w"))
        return Step(fit.rows, output, fit.windows, last, fit.models)


@dataclass
class KMeansStream:
    """Batch-wise k-means over a feed."""

    features: Sequence[str | Column]
    order_by: str | Sequence[str]
    partition_by: str | Sequence[str] | None = None
    options: KMeansOptions = field(default_factory=KMeansOptions)
    on_null: str = "error"

    def step(self, rows: DataFrame, base: DataFrame | None, state: DataFrame | None) -> Step:
        fit = fit_kmeans(
            rows, self.features, self.order_by, self.partition_by,
            self.options, self.on_null, base, state,
        )
        models = materialise(fit.models, "models")
        output = attach_models(
            fit.rows, models, fit.keys, fit.windows, center_columns(self.options.num_clusters)
        )
        last = None
        if self.options.update == "decay" and "history" in models.columns:
            last = last_of(models, fit.keys, F.col("history").alias("acc"))
        return Step(fit.rows, output, fit.windows, last, models)


@dataclass
class MicroClusterStream:
    """Two-level clustering over a feed."""

    features: Sequence[str | Column]
    order_by: str | Sequence[str]
    partition_by: str | Sequence[str] | None = None
    options: MicroClusterOptions = field(default_factory=MicroClusterOptions)
    on_null: str = "error"

    def __post_init__(self):
        if self.options.mode != "walk":
            raise ValueError("a feed continues its kernels in order: use mode='walk'")

    def step(self, rows: DataFrame, base: DataFrame | None, state: DataFrame | None) -> Step:
        fit = fit_microclusters(
            rows, self.features, self.order_by, self.partition_by,
            self.options, self.on_null, base, state,
        )
        models = materialise(fit.models, "models")
        columns = center_columns(self.options.num_clusters, "ssq")
        columns[0] = F.lit(0.0).alias("stderr")
        output = attach_models(fit.rows, models, fit.keys, fit.windows, columns)
        last = next_history(models, fit.keys)
        return Step(fit.rows, output, fit.windows, last, models)


def last_of(models: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """The value of the latest window of each key."""
    names = [f"`{k}`" for k in keys]
    picked = models.select(*names, WINDOW_ID, value)
    name = picked.columns[-1]
    return picked.groupBy(*names).agg(F.max_by(name, WINDOW_ID).alias(name)).where(
        F.col(name).isNotNull()
    )


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join ``right``, whose keys are renamed to ``_tl_r0…``, on the keys."""
    for i, key in enumerate(keys):
        right = right.withColumnRenamed(key, f"_tl_r{i}")
    if not keys:
        return with_one_row(left, right)
    match = same_keys(
        [F.col(f"`{k}`") for k in keys], [F.col(f"_tl_r{i}") for i in range(len(keys))]
    )
    return left.join(right, match, how)


def carried_over(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new``, plus the rows of ``old`` for keys that ``new`` lacks."""
    if not keys:
        return old if new.isEmpty() else new
    kept = _joined(old, new.select(*[f"`{k}`" for k in keys]), keys, "left_anti")
    return new.unionByName(kept)


def _latest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` with the larger of both last order values: late rows do not set it back."""
    before = old.select(*[f"`{k}`" for k in keys], F.col("last").alias("_tl_before"))
    return _joined(new, before, keys, "left").select(
        *[f"`{k}`" for k in keys], "base", F.greatest("last", "_tl_before").alias("last")
    )


def state_version(checkpoint: str, batch_id: int) -> str:
    return f"{checkpoint.rstrip('/')}/state/v={batch_id}"


def read_version(
    spark: SparkSession, checkpoint: str, batch_id: int, part: str
) -> DataFrame | None:
    """A table of the state that a micro-batch left, if it left one."""
    path = f"{state_version(checkpoint, batch_id)}/{part}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.parquet(path) if found else None


def as_text(models: DataFrame) -> DataFrame:
    """Models with arrays as JSON, which CSV can hold; helper columns leave."""
    return models.select(
        *[
            F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`")
            for f in models.schema.fields if not f.name.startswith("_tl_")
        ]
    )


class _Feed:
    """Reads version n-1, runs the operator, writes the output and version n."""

    def __init__(
        self, op, sink: str | Callable, checkpoint: str, fmt: str, late_to: str | None = None,
        history_to: str | None = None,
    ):
        self.op, self.sink, self.checkpoint, self.fmt = op, sink, checkpoint, fmt
        self.late_to, self.history_to = late_to, history_to
        self.keys = as_names(op.partition_by)
        self.order = as_names(op.order_by)

    def _read(self, spark: SparkSession, batch_id: int, part: str) -> DataFrame | None:
        return read_version(spark, self.checkpoint, batch_id, part)

    def _write(self, df: DataFrame, batch_id: int, part: str) -> None:
        df.write.mode("overwrite").parquet(f"{state_version(self.checkpoint, batch_id)}/{part}")

    def __call__(self, micro: DataFrame, batch_id: int) -> None:
        spark = micro.sparkSession
        with scratch_scope(spark):
            self._advance(spark, micro, batch_id)
        if batch_id > 1:
            delete_path(spark, state_version(self.checkpoint, batch_id - 2))

    def _advance(self, spark: SparkSession, micro: DataFrame, batch_id: int) -> None:
        keys, names = self.keys, [f"`{k}`" for k in self.keys]
        columns = micro.columns
        progress = self._read(spark, batch_id - 1, "progress") if batch_id else None
        # New rows come after all rows that were kept.
        rows, late, state = micro.withColumn(SEQ, F.lit(1 << 62).cast("long")), 0, None
        if progress is not None:
            seen = _joined(
                rows, progress.select(*names, F.col("last").alias("_tl_last")), keys, "left"
            ).withColumn(
                "_tl_late",
                F.coalesce(
                    F.struct(*[F.col(f"`{o}`") for o in self.order]) < F.col("_tl_last"),
                    F.lit(False),
                ),
            )
            late = seen.where("_tl_late").count()
            if self.late_to is not None:
                seen.where("_tl_late").select(*columns).write.mode("overwrite").parquet(
                    f"{self.late_to.rstrip('/')}/batch_id={batch_id}"
                )
                rows = seen.where("not _tl_late").select(*columns, SEQ)
            rows = self._read(spark, batch_id - 1, "carry").select(*columns, SEQ).unionByName(rows)
            state = self._read(spark, batch_id - 1, "model")

        step = self.op.step(rows, progress, state)
        if callable(self.sink):
            self.sink(step.output, batch_id)
        else:
            step.output.write.mode("overwrite").format(self.fmt).save(
                f"{self.sink.rstrip('/')}/batch_id={batch_id}"
            )

        if self.history_to is not None:
            # Written before the state of this micro-batch, and again if it is replayed.
            as_text(step.models).write.mode("overwrite").csv(
                f"{self.history_to.rstrip('/')}/batch_id={batch_id}", header=True
            )

        windows = step.windows
        order = F.struct(*[F.col(f"`{o}`") for o in self.order])
        ends = step.rows.groupBy(*names).agg(
            (F.max(RN) + 1).alias("end"), F.max(order).alias("last")
        ).where(F.col("end").isNotNull())
        opened = F.when(F.col("end") < windows.size, F.lit(0).cast("long")).otherwise(
            (windows.closed_by(F.col("end") - 1) + 1) * windows.shift
        )
        now = materialise(ends.select(*names, opened.alias("base"), "last"), "progress")
        carry = _joined(step.rows, now.select(*names, F.col("base").alias("_tl_base")), keys, "left")
        self._write(
            carry.where(F.col(RN) >= F.col("_tl_base")).select(*columns, F.col(RN).alias(SEQ)),
            batch_id, "carry",
        )
        if progress is not None:
            now = carried_over(progress, _latest(progress, now, keys), keys)
        self._write(now, batch_id, "progress")
        model = step.state
        if state is not None:
            model = state if model is None else carried_over(state, model, keys)
        if model is not None:
            self._write(model, batch_id, "model")
        spark.range(1).select(F.lit(late).cast("long").alias("late")).write.mode(
            "overwrite"
        ).parquet(f"{self.checkpoint.rstrip('/')}/metrics/batch_id={batch_id}")


def run_stream(
    op: LinRegStream | KMeansStream | MicroClusterStream,
    stream: DataFrame,
    sink: str | Callable[[DataFrame, int], None],
    checkpoint: str,
    fmt: str = "parquet",
    trigger: dict | None = None,
    late_to: str | None = None,
    history_to: str | None = None,
):
    """Run an operator over the frame of a feed and return the started query.

    The output of micro-batch n goes to ``sink/batch_id=n`` (overwritten when it
    is replayed), or to ``sink(frame, n)``. Rows are numbered by micro-batch, and by
    ``order_by`` within one. So the output equals that of the table operator over all
    rows so far if order values are unique and micro-batches arrive in their order;
    if not, rows out of order count where they arrive, and none is lost. Rows before
    the last one taken for their key are counted (``late_rows``). With ``late_to``
    they are written to that folder and take no part; ties are never late. ``history_to`` is a
    folder for the models of the closed windows, as CSV with a header (arrays as JSON).

    ``checkpoint`` holds the query's own checkpoint and the operator state; both
    survive a restart together.
    """
    feed = _Feed(op, sink, checkpoint, fmt, late_to, history_to)
    writer = (
        stream.writeStream.foreachBatch(feed)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/query")
        .trigger(**(trigger or {"availableNow": True}))
    )
    return writer.start()


def late_rows(spark: SparkSession, checkpoint: str) -> int:
    """Rows that came to a feed after a later one of their key."""
    found = spark.read.parquet(f"{checkpoint.rstrip('/')}/metrics")
    return found.agg(F.sum("late")).first()[0] or 0
