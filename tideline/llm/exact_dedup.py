"""Exact duplicates by progressive refinement.

Rows are grouped by length, then by a hash of their first bytes, then by a hash of
the whole text. A row that is alone in its group leaves at once, so the whole text
is hashed only for rows that still have a partner (and the few that a filter of
fixed size cannot rule out). Groups are only counted: one that a third of all rows
fall into meets as one row from each task. No text moves for rows without a partner, and
none at all while the groups are few enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import key_filter, texts, with_filter
from tideline.scratch import materialise

PREFIX = 64


#: Groups that are broadcast, about 150 bytes each; beyond it texts are joined by a shuffle.
BROADCAST_GROUPS = 1 << 18


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX,
    keep: tuple[str, ...] = (), with_text: bool = False,
) -> DataFrame:
    """One row per input row: ``_id, keep_id, group_size, kept``.

    Texts are equal if they are identical; null is the empty text. Of equal texts
    the row with the largest identifier stays (null is the smallest). Of rows that
    repeat both text and identifier one stays. ``keep`` names columns to pass on, as
    ``_<name>``; ``with_text`` adds ``_text``.
    """
    rows = texts(df, id_col, text_col, *keep).withColumns(
        {
            "_length": F.octet_length("_text"),
            "_head": F.xxhash64(F.substring(F.encode("_text", "UTF-8"), 1, prefix)),
        }
    )
    # Counted once by both digits, with partial sums in each task: no row is shuffled by its
    # length. Lengths that only one row has have no head that repeats.
    counted = materialise(rows.groupBy("_length", "_head").agg(F.count("*").alias("rows")), "counts")
    lengths = counted.groupBy("_length").agg(F.sum("rows").alias("of_length")).where("of_length > 1")
    heads = counted.where("rows > 1").join(lengths, "_length", "left_semi").select("_length", "_head")
    words = materialise(key_filter(heads, "_length", "_head"), "filter")

    rows = with_filter(rows, words, "_length", "_head")
    alone, open_rows = rows.where("not _maybe"), rows.where("_maybe").withColumn(
        "_full", F.sha2("_text", 256)
    )
    copies = open_rows.groupBy("_length", "_full", "_id").agg(F.count("*").alias("rows"))
    groups = copies.groupBy("_length", "_full").agg(
        F.sum("rows").alias("group_size"), F.max(F.struct("_id", "rows")).alias("top")
    )
    groups = materialise(
        groups.where("group_size > 1").select(
            "_length", "_full", "group_size", F.col("top._id").alias("keep_id"),
            (F.col("top.rows") > 1).alias("_again"),
        ),
        "groups",
    )
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    passed = [*(["_text"] if with_text else []), *[f"_{c}" for c in keep]]

    def shape(frame: DataFrame, keep_id, size, kept) -> DataFrame:
        return frame.select(
            "_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"),
            kept.alias("kept"), *passed,
        )

    joined = open_rows.join(groups, ["_length", "_full"], "left")
    top = F.col("_id").eqNullSafe(F.col("keep_id"))
    repeated = F.coalesce(F.col("_again") & top, F.lit(False))
    first = F.row_number().over(Window.partitionBy("_full", "_id").orderBy(F.lit(0)))
    ids = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1))
    return (
        shape(alone, F.col("_id"), F.lit(1), F.lit(True))
        .union(shape(joined.where(~repeated), ids, size, F.col("group_size").isNull() | top))
        .union(
            shape(joined.where(repeated).withColumn("_nth", first), ids, size, F.col("_nth") == 1)
        )
    )
