"""Two-level clustering: many small kernels, and centres over them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.config import MicroClusterOptions
from tideline.operators.kmeans import ClusterFit, center_columns
from tideline.plans.arrival import RN, as_names, same_keys
from tideline.plans.count_windows import WINDOW_ID, CountWindows, int_div
from tideline.plans.gram import feature
from tideline.plans.kernels import (
    FEW,
    FewKernels,
    Kernels,
    macro_centers,
    macro_centers_of,
    reduce_kernels,
    summarise_block,
    width,
)
from tideline.plans.ordered import double_arrays, joined, ordered_map, out_batch
from tideline.plans.prefix import exclusive_prefix
from tideline.plans.rows import as_columns, attach_models, index_rows, safe_keys, typed
from tideline.plans.walk import walk_blocks
from tideline.scratch import materialise

_DOUBLES = T.ArrayType(T.DoubleType())


def _blocks(
    rows: DataFrame,
    keys: Sequence[str],
    dims: int,
    options: MicroClusterOptions,
    total: int,
) -> DataFrame:
    """Kernels of every block of rows: keys, window_id, block, n, acc.

    A block is a period, or ``block_rows`` rows of it where a period is longer.
    """
    size = options.batch_size
    length = block_length(options)
    rn = F.col(RN)
    sent = rows.select(
        *[f"`{k}`" for k in keys],
        int_div(rn, size).alias(WINDOW_ID),
        int_div(rn % F.lit(size), length).alias("block"),
        RN,
        *[feature(i) for i in range(dims)],
    )
    groups = [*keys, WINDOW_ID, "block"]
    if length == 1:
        t, xs = F.col(RN).cast("double"), [F.col(feature(i)) for i in range(dims)]
        acc = F.array(F.lit(1.0), t, t * t, *xs, *[x * x for x in xs])
        return sent.select(*[f"`{g}`" for g in groups], F.lit(1).cast("long").alias("n"), acc.alias("acc"))
    schema = T.StructType(
        [sent.schema[g] for g in groups]
        + [T.StructField("n", T.LongType()), T.StructField("acc", _DOUBLES)]
    )
    arrow = to_arrow_schema(schema)
    limit = options.max_kernels

    def finish(head, pieces):
        points = np.concatenate([p for p, _ in pieces])
        times = np.concatenate([t for _, t in pieces]).astype(float)
        columns = {g: head.column(g) for g in groups}
        columns["n"] = [len(points)]
        columns["acc"] = double_arrays([summarise_block(points, times, limit)])
        return out_batch(columns, arrow)

    def body(marked):
        head, pieces = None, []
        for batch, flags in marked:
            points = np.column_stack(
                [batch.column(feature(i)).to_numpy(zero_copy_only=False) for i in range(dims)]
            )
            times = batch.column(RN).to_numpy(zero_copy_only=False)
            at, done = 0, []
            for edge in [*np.flatnonzero(flags).tolist(), batch.num_rows]:
                if edge > at:
                    pieces.append((points[at:edge], times[at:edge]))
                if edge < batch.num_rows:
                    if pieces:
                        done.append(finish(head, pieces))
                    head, pieces = batch.slice(edge, 1).select(groups), []
                at = edge
            yield from joined(done)
        if pieces:
            yield finish(head, pieces)

    return ordered_map(sent, groups, [RN], body, schema, most=total // length + 1)


class _Walk:
    """Kernels of a key as its blocks come."""

    def __init__(self, state, options: MicroClusterOptions, dims: int):
        rows = np.empty((0, width(dims))) if state is None else state.reshape(-1, width(dims))
        given = (rows, options.max_kernels, options.radius_factor, options.horizon, dims)
        self.wide = width(dims)
        self.few = block_length(options) == 1 and options.max_kernels * dims <= FEW
        self.held = FewKernels(*given) if self.few else Kernels(*given)

    def take(self, acc: np.ndarray) -> None:
        if self.few:
            self.held.insert(acc.tolist())
        else:
            self.held.take(acc.reshape(-1, self.wide))

    def state(self):
        return self.held.flat() if self.few else self.held.used().ravel().copy()

    def close(self, window: int):
        return (), self.state()


def block_length(options: MicroClusterOptions) -> int:
    """Rows that are summarised at once."""
    return min(options.batch_size, options.block_rows)


def period_doubles(options: MicroClusterOptions, dims: int) -> int:
    """Most doubles in the kernels of the blocks of a period."""
    length = block_length(options)
    return -(-options.batch_size // length) * min(length, options.max_kernels) * width(dims)


def _period_schema(blocks: DataFrame, keys: Sequence[str], extras: Sequence[str] = ()) -> T.StructType:
    return T.StructType(
        [blocks.schema[c] for c in keys]
        + [T.StructField(c, T.LongType()) for c in [WINDOW_ID, *extras, "n"]]
        + [
            T.StructField("ssq", T.DoubleType()),
            T.StructField("centers", T.ArrayType(_DOUBLES)),
            T.StructField("kernels", _DOUBLES),
        ]
    )


def with_centers(
    walked: DataFrame,
    keys: Sequence[str],
    dims: int,
    options: MicroClusterOptions,
    extras: Sequence[str] = (),
) -> DataFrame:
    """Row counts, centres and errors beside the kernels of each period.

    They need no order, so the periods of a key are spread over all tasks.
    """
    schema = _period_schema(walked, keys, extras)
    arrow = to_arrow_schema(schema)
    kept, k = [*keys, WINDOW_ID, *extras], options.num_clusters
    wide = width(dims)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("kernels")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            states = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            found = macro_centers_of(
                states, dims, k, options.num_iterations, options.weighted, options.seed,
                batch.column(WINDOW_ID).to_pylist(),
            )
            columns = {c: batch.column(c) for c in kept}
            columns |= {
                "n": [int(round(s[::wide].sum())) for s in states],
                "ssq": [ssq for _, ssq in found],
                "centers": [[c.tolist() for c in cs] + [None] * (k - len(cs)) for cs, _ in found],
                "kernels": lists,
            }
            yield out_batch(columns, arrow)

    names = [f"`{k}`" for k in keys]
    return walked.repartition(*names, WINDOW_ID).mapInArrow(run, schema)


def _walk_periods(
    blocks: DataFrame,
    keys: Sequence[str],
    dims: int,
    options: MicroClusterOptions,
    periods: int,
    total: int,
    start: DataFrame | None,
) -> DataFrame:
    """Fold the blocks of each key in order; one row per full period.

    The rows are summarised already, so a key's walk reads at most ``max_kernels``
    kernels a block, and gives kernels alone.
    """
    walked = walk_blocks(
        blocks, keys, options.batch_size, lambda state: _Walk(state, options, dims), [],
        periods, period_doubles(options, dims), total, start,
    )
    size = F.lit(options.batch_size).cast("long")
    return with_centers(walked, keys, dims, options).withColumn("n", size)


#: Kernels of so many periods are combined in one sequence; the shape of the tree is
#: given by the numbers of the periods, so it does not depend on the size of the input.
_FAN = 16


def _tree_periods(
    blocks: DataFrame,
    keys: Sequence[str],
    dims: int,
    options: MicroClusterOptions,
    longest: int,
    start: DataFrame | None,
) -> DataFrame:
    """Kernels after each full period, as a tree over the periods of a key (merge and reduce).

    Blocks of a period are combined first, then groups of ``_FAN`` periods, groups of groups
    and so on; each period is then combined with the totals before it. No task reads more
    than ``_FAN`` sets of kernels in sequence, however long the key.
    """
    names, limit, size = [f"`{k}`" for k in keys], options.max_kernels, options.batch_size
    if start is not None:
        raise ValueError("a feed continues its kernels in order: use mode='walk'")

    def fold(earlier, later):
        return reduce_kernels(earlier, later, limit, dims)

    # Periods of several blocks: the blocks are the lowest groups of the tree.
    per = -(-size // min(size, options.block_rows))
    nodes = materialise(blocks.withColumn("idx", F.col(WINDOW_ID) * F.lit(per) + F.col("block")), "nodes")
    span = (longest // size + 1) * per
    before = exclusive_prefix(nodes.select(*names, "idx", "acc"), keys, fold, span, _FAN)
    full = nodes.groupBy(*names, WINDOW_ID).agg(F.sum("n").alias("n"), F.max("idx").alias("idx"))
    full = full.where(F.col("n") == size)
    renamed = [F.col(n).alias(f"_tl_b{i}") for i, n in enumerate(names)]
    right = [F.col(f"_tl_b{i}") for i in range(len(keys))]
    left = [F.col(n) for n in names]

    def attached(frame, other, value):
        other = other.select(*renamed, F.col("idx").alias("_tl_bi"), F.col("acc").alias(value))
        match = F.col("idx") == F.col("_tl_bi")
        if keys:
            match = match & same_keys(left, right)
        return frame.join(other, match).drop("_tl_bi", *[f"_tl_b{i}" for i in range(len(keys))])

    both = attached(attached(full, nodes, "own"), before, "before")
    k, seed = options.num_clusters, options.seed
    schema = _period_schema(blocks, keys)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            states = []
            for own, earlier in zip(batch.column("own"), batch.column("before")):
                mine = own.values.to_numpy(zero_copy_only=False)
                states.append(
                    fold(earlier.values.to_numpy(zero_copy_only=False), mine) if earlier.is_valid else mine
                )
            found = [
                macro_centers(
                    state.reshape(-1, width(dims)), dims, k, options.num_iterations, options.weighted, [seed, w]
                )
                for state, w in zip(states, batch.column(WINDOW_ID).to_pylist())
            ]
            columns = {c: batch.column(c) for c in [*keys, WINDOW_ID, "n"]}
            columns |= {
                "ssq": [ssq for _, ssq in found],
                "centers": [[c.tolist() for c in cs] + [None] * (k - len(cs)) for cs, _ in found],
                "kernels": double_arrays(states),
            }
            yield out_batch(columns, arrow)

    return both.select(*names, WINDOW_ID, "n", "own", "before").mapInArrow(run, schema)


def fit_microclusters(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: MicroClusterOptions = MicroClusterOptions(),
    on_null: str = "error",
    base: DataFrame | None = None,
    start: DataFrame | None = None,
) -> ClusterFit:
    """Kernels and centres after each period of ``batch_size`` rows.

    Rows are summarised block by block in parallel; the kernels of a key are then
    carried from block to block in order, in one walk over the small summaries.
    ``start`` (keys, ``state``) continues a feed. With ``mode="tree"`` there is no such walk.
    """
    keys = as_names(partition_by)
    given = as_columns(features)
    dims = len(given)
    windows = CountWindows(options.batch_size, options.batch_size)
    arrived = index_rows(df, given, order_by, partition_by, on_null, base)
    numeric = limit_rows(arrived.rows, options.instance_limit).select(
        *[F.col(f"`{k}`") for k in keys],
        RN,
        *[v.alias(feature(i)) for i, v in enumerate(typed(given, on_null))],
    )
    blocks = _blocks(numeric, keys, dims, options, arrived.total)
    if options.mode == "tree":
        models = _tree_periods(blocks, keys, dims, options, arrived.longest, start)
        return ClusterFit(arrived.rows, models, keys, windows)
    periods = min(arrived.longest, arrived.total) // options.batch_size + 2
    every = arrived.total // options.batch_size + 2
    models = _walk_periods(blocks, keys, dims, options, periods, every, start)
    return ClusterFit(arrived.rows, models, keys, windows)


def next_history(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where a feed stands after ``models``: keys and ``state``."""
    names = [f"`{k}`" for k in keys]
    last = models.groupBy(*names).agg(F.max_by("kernels", WINDOW_ID).alias("state"))
    return last.where("state is not null")


def limit_rows(rows: DataFrame, instance_limit: int, index: str = RN) -> DataFrame:
    """The first ``instance_limit`` rows of each key; -1 takes all."""
    return rows if instance_limit < 0 else rows.where(F.col(index) < instance_limit)


def stream_microcluster(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: MicroClusterOptions = MicroClusterOptions(),
    on_null: str = "error",
    with_ssq: bool = False,
) -> DataFrame:
    """Closing row of each period with ``stderr, center0 … center{k-1}`` appended.

    ``stderr`` is 0.0 by definition of the operator; ``with_ssq`` adds the
    squared error of the rows behind the kernels as ``ssq``. Centres are strings,
    null where there are fewer kernels than clusters.
    """
    df, partition_by, helpers = safe_keys(df, partition_by)
    fit = fit_microclusters(df, features, order_by, partition_by, options, on_null)
    columns = center_columns(options.num_clusters, "ssq")
    columns[0] = F.lit(0.0).alias("stderr")
    if with_ssq:
        columns.append(F.col("ssq"))
    return attach_models(fit.rows, fit.models, fit.keys, fit.windows, columns).drop(*helpers)


def microcluster_models(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: MicroClusterOptions = MicroClusterOptions(),
    on_null: str = "error",
) -> DataFrame:
    """Model history: keys, window_id, n, ssq, centers, kernels."""
    fit = fit_microclusters(df, features, order_by, partition_by, options, on_null)
    return fit.models


def micro_clusters(
    df: DataFrame,
    features: Sequence[str | Column],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    options: MicroClusterOptions = MicroClusterOptions(),
    on_null: str = "error",
) -> DataFrame:
    """Kernels of every block of rows, one row each.

    Columns: keys, window_id, block, cf_id, n, lst, sst, ls, ss. They are
    additive: their sums are the sums over the rows.
    """
    keys = as_names(partition_by)
    given = as_columns(features)
    dims = len(given)
    arrived = index_rows(df, given, order_by, partition_by, on_null)
    numeric = limit_rows(arrived.rows, options.instance_limit).select(
        *[F.col(f"`{k}`") for k in keys],
        RN,
        *[v.alias(feature(i)) for i, v in enumerate(typed(given, on_null))],
    )
    blocks = _blocks(numeric, keys, dims, options, arrived.total)
    w = width(dims)
    names = [f"`{k}`" for k in keys]
    cut = F.transform(
        F.sequence(F.lit(0), (int_div(F.size("acc"), w) - 1).cast("int")),
        lambda i: F.slice("acc", i * w + 1, F.lit(w)),
    )
    one = F.col("cf")
    return blocks.select(*names, WINDOW_ID, "block", F.posexplode(cut).alias("cf_id", "cf")).select(
        *names, WINDOW_ID, "block", "cf_id",
        one[0].alias("n"), one[1].alias("lst"), one[2].alias("sst"),
        F.slice(one, 4, dims).alias("ls"), F.slice(one, 4 + dims, dims).alias("ss"),
    )


def stream_microcluster_call(
    df: DataFrame,
    *arguments,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    on_null: str = "error",
) -> DataFrame:
    """Positional form: seven constants (or none), then the features."""
    options, columns = MicroClusterOptions.from_arguments(arguments)
    return stream_microcluster(df, columns, order_by, partition_by, options, on_null)
