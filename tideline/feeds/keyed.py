"""Count-window operators over keyed feeds, with their state in Spark's state store.

The state of a key (its position, the values of the rows of windows not complete yet,
the model, and the last order value) is one row of the state store. A micro-batch writes
the state of the keys it touches and no other, as a changelog; Spark restores it after a
failure together with the offsets of the feed. Closing rows are the rows of the
micro-batch itself, so rows are never kept, only their features.

``run_stream`` spreads one key over many tasks; here the rows of a key in one micro-batch
are worked on by one task. Bound the micro-batch (files or rows per trigger) accordingly.
"""

from __future__ import annotations

import bisect
import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.config import KMeansOptions, LearnType, LinRegOptions
from tideline.feeds.runner import KMeansStream, LinRegStream, MicroClusterStream
from tideline.operators.kmeans import absorb_centers, center_columns, unpack_history
from tideline.operators.linreg import CANCELLED, beta_columns
from tideline.plans.arrival import as_names
from tideline.plans.count_windows import CountWindows
from tideline.plans.gram import drawn_products, upper
from tideline.plans.kernels import macro_centers, merge, summarise_block, width
from tideline.plans.lloyd import draw_rounds, solve_window
from tideline.plans.rows import as_columns, check_numeric, missing, typed
from tideline.plans.sgd_chain import descend
from tideline.plans.time_stats import as_instant

_DOUBLES = T.ArrayType(T.DoubleType())
_STATE = T.StructType(
    [
        T.StructField("position", T.LongType()), T.StructField("carry", T.BinaryType()),
        T.StructField("model", T.BinaryType()), T.StructField("last", T.StringType()),
    ]
)
_MODEL = [T.StructField("_tl_error", T.DoubleType()), T.StructField("_tl_model", T.ArrayType(_DOUBLES))]
_MASK = (1 << 64) - 1


def window_sums(panes: np.ndarray, span: int, stride: int) -> np.ndarray:
    """Sums over ``span`` panes, from every ``stride``-th pane on, by heads and tails of blocks."""
    if len(panes) < span:
        return panes[:0]
    more = -len(panes) % span
    blocks = np.concatenate([panes, np.zeros((more, *panes.shape[1:]))]).reshape(-1, span, *panes.shape[1:])
    heads = blocks.cumsum(axis=1).reshape(-1, *panes.shape[1:])
    tails = blocks[:, ::-1].cumsum(axis=1)[:, ::-1].reshape(-1, *panes.shape[1:])
    starts = np.arange(0, len(panes) - span + 1, stride)
    out = tails[starts]
    cut = starts % span != 0
    out[cut] += heads[starts[cut] + span - 1]
    return out


class _Regression:
    """Windows of one key, from the values ``[y, x...]`` of its rows."""

    def __init__(self, options: LinRegOptions, width_: int):
        self.options, self.p = options, width_ - 1
        self.windows = CountWindows(options.batch_size, options.shift)

    def solve(self, values: np.ndarray, first: int, model: bytes):
        """(window, error, model columns) of each window, and the model after them.

        ``first`` is the index of the first row, which opens a window.
        """
        o, p, w = self.options, self.p, self.windows
        steps, full = o.num_iterations, o.num_iterations + 1
        sampled = o.mini_batch_fraction < 1 and steps > 0
        z = np.column_stack([np.ones(len(values)), values])
        n_panes = len(z) // w.pane
        hits = np.ones((len(z), 1))
        if sampled:
            at = range(first, first + len(z))
            hits = np.column_stack([drawn(at, i, o.seed, o.mini_batch_fraction) for i in range(1, full)] + [hits])
        parts = (slice(i * w.pane, (i + 1) * w.pane) for i in range(n_panes))
        panes = np.array([drawn_products(z[part], hits[part]) for part in parts])
        panes = panes.reshape(n_panes, hits.shape[1], 2 + p + p * (p + 1) // 2)
        sums = window_sums(panes, w.span, w.stride)
        rows_up, cols_up = (np.array(side) for side in zip(*upper(p)))
        grams = np.empty((*sums.shape[:2], p, p))
        grams[..., rows_up, cols_up] = grams[..., cols_up, rows_up] = sums[..., 2 + p :]
        weights = np.frombuffer(model) if model else np.zeros(p)
        out = []
        with np.errstate(all="ignore"):
            for k in range(len(sums)):
                draws = [
                    (sums[k, i, 0], grams[k, i], sums[k, i, 2 : 2 + p]) if sums[k, i, 0] > 0 else None
                    for i in range(sums.shape[1])
                ]
                n, gram, rhs = draws[-1]
                weights, _ = descend(weights, draws[:-1] if sampled else draws * steps, o)
                if o.on_diverge == "error" and not np.isfinite(weights).all():
                    raise ArithmeticError(f"gradient descent diverged in window {first // w.shift + k}")
                yy = sums[k, -1, 1]
                mse = max(0.0, (yy - 2 * (weights @ rhs) + weights @ gram @ weights) / n)
                if mse < CANCELLED * yy / n:
                    part = values[k * w.shift : k * w.shift + w.size]
                    mse = float(((part[:, 0] - part[:, 1:] @ weights) ** 2).mean())
                out.append((first // w.shift + k, mse, [[0.0], weights.tolist()]))
        return out, weights.tobytes()


def drawn(index, step: int, seed: int, fraction: float) -> np.ndarray:
    """Whether a step draws the row of each index: the rule of ``text_unit`` in Python."""
    heads = [hashlib.md5(f"{i}|{step}|{seed}".encode()).digest()[:4] for i in index]
    return np.frombuffer(b"".join(heads), ">u4") / float(1 << 32) < fraction


def units(index: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """Uniform values of rows: the rule of ``hash_unit`` in Python (XXH64, chained seeds)."""
    out = np.empty(len(index))
    for at, i in enumerate(index.tolist()):
        h = 42
        for part, size in ((i, 8), (draw, 4), (seed, 4)):
            h = xxhash.xxh64_intdigest((part & (1 << 8 * size) - 1).to_bytes(size, "little"), h)
        out[at] = (h & (1 << 30) - 1) / float(1 << 30)
    return out


class _Means:
    """Batch-wise k-means of one key."""

    def __init__(self, options: KMeansOptions, width_: int):
        self.options, self.windows = options, CountWindows(options.batch_size, options.shift)

    def solve(self, values, first: int, model: bytes):
        o, w, out = self.options, self.windows, []
        held = unpack_history(np.frombuffer(model), o.num_clusters) if model else None
        for k in range(w.count(len(values))):
            points = values[k * w.shift : k * w.shift + w.size]
            index = np.arange(first + k * w.shift, first + k * w.shift + w.size)
            draws = [units(index, i, o.seed) for i in range(draw_rounds(o))]
            draws = np.column_stack(draws) if draws else np.empty((len(points), 0))
            error, centers, weights = solve_window(points, draws, first // w.shift + k, o)
            if o.update == "decay":
                held = absorb_centers(held, centers, weights, o.alpha)
                centers = [None if c[0] != c[0] else c for c in held[1].tolist()]
            out.append((first // w.shift + k, error, centers))
        return out, b"" if held is None else np.concatenate([held[0], held[1].ravel()]).tobytes()


class _Kernels:
    """Two-level clustering of one key."""

    def __init__(self, options, width_: int):
        self.options, self.dims = options, width_
        self.windows = CountWindows(options.batch_size, options.batch_size)

    def solve(self, values, first: int, model: bytes):
        o, size, out = self.options, self.options.batch_size, []
        state = np.frombuffer(model) if model else np.empty(0)
        if o.instance_limit >= 0:
            values = values[: max(0, o.instance_limit - first)]
        length = min(size, o.block_rows)
        for k in range(len(values) // size):
            points = values[k * size : (k + 1) * size]
            times = np.arange(first + k * size, first + (k + 1) * size, dtype=float)
            for at in range(0, size, length):
                block = summarise_block(points[at : at + length], times[at : at + length], o.max_kernels)
                state = merge(state, block.ravel(), o.max_kernels, o.radius_factor, o.horizon, self.dims)
            window = first // size + k
            centers, _ = macro_centers(
                state.reshape(-1, width(self.dims)), self.dims, o.num_clusters, o.num_iterations, o.weighted,
                [o.seed, window],
            )
            padded = [c.tolist() for c in centers] + [None] * (o.num_clusters - len(centers))
            out.append((window, 0.0, padded))
        return out, state.tobytes()


def _solver(op, features: int):
    if isinstance(op, LinRegStream):
        return _Regression(op.options, features)
    return (_Means if isinstance(op, KMeansStream) else _Kernels)(op.options, features)


def _model_columns(op, features: int) -> list[Column]:
    """The appended columns, from ``_tl_error`` and ``_tl_model``."""
    if isinstance(op, LinRegStream):
        return beta_columns(features - 1)
    return center_columns(op.options.num_clusters, "stderr")


_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _ordered(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Each order column as (is not null, number or text), which pandas sorts as Spark does."""
    out = []
    for i, name in enumerate(order):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, T.TimestampNTZType):
            c = F.unix_micros(as_instant(c, "timestamp_ntz"))
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.DateType):
            c = F.unix_date(c).cast("long")
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            c = c.cast("double")
        elif not isinstance(kind, T.StringType):
            raise TypeError(f"a keyed feed can not be ordered by {name}, a {kind.simpleString()}")
        empty = F.lit("") if isinstance(kind, T.StringType) else F.lit(0)
        out += [c.isNotNull().alias(f"_tl_some{i}"), F.coalesce(c, empty).alias(f"_tl_order{i}")]
    return out


def run_keyed_stream(
    op: LinRegStream | KMeansStream | MicroClusterStream,
    stream: DataFrame,
    sink: str | Callable[[DataFrame, int], None],
    checkpoint: str,
    fmt: str = "parquet",
    trigger: dict | None = None,
):
    """Run an operator with ``partition_by`` over a feed and return the started query.

    Results are those of ``run_stream``; state is kept per key in Spark's state store, so a
    micro-batch costs what its keys cost, however many keys there are. Rows are numbered by
    micro-batch, and by ``order_by`` within one; rows before the last one taken for their
    key are counted (``late_rows``) and take part where they arrive. Columns other than
    the features must be atomic. Output n goes to ``sink/batch_id=n`` (overwritten when it is
    replayed), or to ``sink(frame, n)``. The first run sets the state store to RocksDB with
    changelogs, unless the session has another provider than the default.
    """
    spark = stream.sparkSession
    keys, order = as_names(op.partition_by), as_names(op.order_by)
    if not keys:
        raise ValueError("a keyed feed needs partition_by; use run_stream without keys")
    if getattr(op.options, "learn_type", None) == LearnType.TIME and not isinstance(op, MicroClusterStream):
        raise ValueError("time windows need a time column: use run_time_windows")
    if op.on_null not in ("error", "drop"):
        raise ValueError(f"on_null must be 'error' or 'drop', got {op.on_null!r}")
    given = as_columns([op.y, *op.xs] if isinstance(op, LinRegStream) else op.features)
    check_numeric(stream, given)
    for f in stream.schema.fields:
        if not isinstance(f.dataType, _PLAIN):
            raise TypeError(f"select atomic columns first: {f.name} is {f.dataType.simpleString()}")
        if f.name.startswith("_tl_"):
            raise ValueError(f"column names starting with _tl_ are reserved, got {f.name}")
    if op.on_null == "drop":
        stream = stream.where(~missing(given))
    _use_state_store(spark)
    solver, names = _solver(op, len(given)), stream.columns
    # Values travel as text: it keeps large integers, nulls and fractions as they are.
    sent = stream.select(
        *[F.col(f"`{k}`").cast("string").alias(f"_tl_key{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`").cast("string").alias(f"_tl_c{i}") for i, c in enumerate(names)],
        F.array(*typed(given, op.on_null)).alias("_tl_values"),
        F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("_tl_tie"),
        *_ordered(stream, order),
    )
    schema = T.StructType(
        [T.StructField(f"_tl_c{i}", T.StringType()) for i in range(len(names))]
        + _MODEL + [T.StructField("_tl_late", T.LongType())]
    )
    advance = _advance(solver, len(names), len(order))
    groups = [f"_tl_key{i}" for i in range(len(keys))]
    found = sent.groupBy(*groups).applyInPandasWithState(advance, schema, _STATE, "append", "NoTimeout")
    appended = _model_columns(op, len(given))
    kinds = [f.dataType for f in stream.schema.fields]
    regression = isinstance(op, LinRegStream)

    def write(micro: DataFrame, batch_id: int) -> None:
        micro = micro.persist()
        try:
            model = {"stderr": F.col("_tl_error")}
            if regression:
                model |= {"intercept": F.lit(0.0), "weights": F.get("_tl_model", F.lit(1))}
            else:
                model |= {"centers": F.col("_tl_model")}
            closing = micro.where("_tl_error is not null")
            made = closing.select("*", *[v.alias(k) for k, v in model.items()])
            names_out = made.select(*appended).columns
            output = made.select(
                *[
                    F.col(f"_tl_c{i}").cast(t).alias(c)
                    for i, (c, t) in enumerate(zip(names, kinds)) if c not in names_out
                ],
                *appended,
            )
            if callable(sink):
                sink(output, batch_id)
            else:
                output.write.mode("overwrite").format(fmt).save(f"{sink.rstrip('/')}/batch_id={batch_id}")
            micro.agg(F.coalesce(F.sum("_tl_late"), F.lit(0)).cast("long").alias("late")).write.mode(
                "overwrite"
            ).parquet(f"{checkpoint.rstrip('/')}/metrics/batch_id={batch_id}")
        finally:
            micro.unpersist()

    return (
        found.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/query")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _use_state_store(spark: SparkSession) -> None:
    name = "spark.sql.streaming.stateStore."
    if spark.conf.get(f"{name}providerClass").endswith("HDFSBackedStateStoreProvider"):
        provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        spark.conf.set(f"{name}providerClass", provider)
        spark.conf.set(f"{name}rocksdb.changelogCheckpointing.enabled", "true")


def _compact(part: pd.DataFrame, kept: Sequence[str], order: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows of a part as Arrow columns, whose texts take their bytes and no objects, and their values."""
    columns = {c: pa.array(part[c], pa.large_string(), from_pandas=True) for c in kept}
    # NaN stays a number, and sorts last.
    columns |= {c: pa.array(part[c].to_numpy()) for c in order}
    for c, column in columns.items():
        if pa.types.is_string(column.type):
            columns[c] = column.cast(pa.large_string())
    return pa.table(columns), np.array(part["_tl_values"].tolist(), float).reshape(len(part), -1)


def _advance(solver, columns: int, orders: int):
    """Advance one key by its rows of a micro-batch."""
    windows: CountWindows = solver.windows
    rank = [c for i in range(orders) for c in (f"_tl_some{i}", f"_tl_order{i}")]
    kept = [f"_tl_c{i}" for i in range(columns)]
    sorting = [(c, "ascending") for c in [*rank, "_tl_tie"]]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tables, pieces = [], []
        for part in parts:
            table, matrix = _compact(part, kept, [*rank, "_tl_tie"])
            tables.append(table)
            pieces.append(matrix)
        rows = pa.concat_tables(tables)
        at = pc.sort_indices(rows, sort_keys=sorting).to_numpy()
        position, carry, model, last = state.get if state.exists else (0, b"", b"", None)
        values = np.concatenate(pieces)[at]
        del tables, pieces

        def rank_of(i: int) -> tuple:
            return tuple(rows.column(c)[int(at[i])].as_py() for c in rank)

        late, top = 0, rank_of(-1)
        if last is not None:
            before = tuple(json.loads(last))
            # Rows are sorted, so the late ones are the first.
            late = bisect.bisect_left(range(len(at)), True, key=lambda i: not rank_of(i) < before)
            top = max(before, top)
        held = np.frombuffer(carry).reshape(-1, values.shape[1])
        first = position - len(held)
        every = np.concatenate([held, values])
        found, model = solver.solve(every, first, model)
        # Rows from the start of the first window that is still open.
        base = windows.count(len(every)) * windows.shift
        state.update((position + len(at), every[base:].tobytes(), model, json.dumps(list(top))))
        if found:
            closing = [w * windows.shift + windows.size - 1 - position for w, *_ in found]
            out = rows.select(kept).take(pa.array(at[closing])).to_pandas()
            out["_tl_error"] = [e for _, e, _ in found]
            out["_tl_model"] = [m for *_, m in found]
            out["_tl_late"] = pd.Series([None] * len(out), dtype="Int64")
            yield out
        if late:
            blank = {c: [None] for c in kept} | {"_tl_error": [None], "_tl_model": [None], "_tl_late": [late]}
            yield pd.DataFrame(blank)

    return run
