"""Removal of lines that many documents share, decided on hashes of lines.

Every line has a key: the line without white space at its ends, lower-cased (A-Z). A
row for each key of a document holds the key's 128-bit hash, the document, and the places
of its lines. These rows are range-partitioned by hash, document and so position, and
sorted. A task then streams its part and sees the first occurrence of a key, then the
others. The document is part of the range, so a key that a third of all documents
hold is spread over many tasks.

A task knows all rows of a key, except of its first and its last one, which may go on in
the neighbouring tasks. Of these two it returns how many documents it saw, and at most as
many rows as leave the key undecided; these are added up in a second, small step.

What comes back are places. They become a compressed bitmap for each document,
in which a bit says that the line stays; texts never move by the lines they hold.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SPACE, as_bytes, ddl, id_type, texts, with_more
from tideline.scratch import materialise

MIN_DOCS, MIN_LENGTH = 10, 1
_ORDER = ("h1", "h2", "_id", "t1")
_PLACES = pa.list_(pa.int32())


def line_places(text: bytes, min_length: int = MIN_LENGTH) -> dict[bytes, list[int]]:
    """Places of the lines of each key with ``min_length`` characters or more."""
    places: dict[bytes, list[int]] = {}
    for n, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE).lower()
        if len(key) >= min_length and (min_length <= 1 or len(key.decode()) >= min_length):
            places.setdefault(key, []).append(n)
    return places


def _entry_rows(min_length: int):
    """One row for each key of each document."""

    def run(batches):
        for b in batches:
            digests, rows, ends, flat = [], [], [0], []
            for row, text in enumerate(as_bytes(b.column("_text"))):
                for key, at in line_places(text, max(min_length, 1)).items():
                    digests.append(xxhash.xxh3_128_digest(key))
                    rows.append(row)
                    flat.extend(at)
                    ends.append(len(flat))
            if not rows:
                continue
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            take = pa.array(rows, pa.int32())
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                    b.column("_id").take(take), b.column("t1").take(take), places,
                ],
                names=[*_ORDER, "places"],
            )

    return run


def _decided_rows(min_docs: int):
    """Rows of keys that ``min_docs`` documents hold, from rows sorted by key and document.

    ``pending`` marks rows of a key at an edge of the partition that other partitions may
    decide; ``lead`` the first row of a key in the partition. On a pending leader ``n`` is the
    number of the key's rows here. At most ``min_docs`` rows are held.
    """

    def marked(rows: pa.RecordBatch, pending, lead, n) -> pa.RecordBatch:
        size = rows.num_rows
        full = lambda v, t: pa.array(v if isinstance(v, np.ndarray) else np.full(size, v), t)
        more = [full(pending, pa.bool_()), full(lead, pa.bool_()), full(n, pa.int64())]
        return pa.RecordBatch.from_arrays(
            [*rows.columns, *more], names=[*rows.schema.names, "pending", "lead", "n"]
        )

    def run(batches):
        key, edge = None, True  # the open key, and whether it is the first of the partition
        lead, held, n = None, [], 0

        def feed(rows):
            """Add rows to the open key; gives those that are decided, but the leader."""
            nonlocal lead, held, n
            out = []
            if lead is None:
                lead, rows, n = rows.slice(0, 1), rows.slice(1), 1
            n += rows.num_rows
            if rows.num_rows:
                held.append(rows)
            if n >= min_docs:
                out, held = [marked(r, False, False, 0) for r in held], []
            return out

        def close(last):
            nonlocal edge, lead, held, n
            out = []
            if lead is not None and (edge or last):
                out = [marked(lead, True, True, n), *(marked(r, True, False, 0) for r in held)]
            elif lead is not None and n >= min_docs:
                out = [marked(lead, False, True, 0)]
            if lead is not None:
                edge = False
            lead, held, n = None, [], 0
            return out

        for b in batches:
            if b.num_rows == 0:
                continue
            h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
            cuts = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            cuts = np.append(cuts, len(h1))
            if (h1[0], h2[0]) != key:
                yield from close(False)
            yield from feed(b.slice(0, cuts[1]))
            if len(cuts) > 2:
                yield from close(False)
                sizes = np.diff(cuts)
                sizes[[0, -1]] = 0
                large = np.repeat(sizes >= min_docs, np.diff(cuts))
                if large.any():
                    first = np.zeros(len(h1), bool)
                    first[cuts[:-1]] = True
                    yield marked(b.filter(pa.array(large)), False, first[large], 0)
                yield from feed(b.slice(cuts[-2]))
            key = h1[-1], h2[-1]
        yield from close(True)

    return run


def repeated_lines(
    rows: DataFrame, kind: str, min_docs: int, min_length: int, keep_first: bool
) -> DataFrame:
    """(_id, t1, places): the lines that go, for each document that loses any.

    ``rows`` has ``_id`` of type ``kind``, ``_text`` and ``t1``, a hash of the text.
    """
    columns = f"h1 long, h2 long, _id {kind}, t1 long, places array<int>"
    entries = materialise(rows.select("_id", "_text", "t1").mapInArrow(_entry_rows(min_length), columns), "lines")
    laid = entries.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    found = laid.mapInArrow(_decided_rows(min_docs), columns + ", pending boolean, lead boolean, n long")
    found = materialise(found, "decided")
    # Two keys for each task of the stage before, whatever the input.
    pending = found.where("pending")
    least = F.min(F.when(F.col("lead"), F.struct("_id", "t1")))
    totals = pending.groupBy("h1", "h2").agg(F.sum("n").alias("total"), least.alias("least"))
    late = pending.join(totals.where(F.col("total") >= min_docs), ["h1", "h2"]).withColumn(
        "lead", F.col("lead") & F.struct("_id", "t1").eqNullSafe(F.col("least"))
    )
    columns = ["_id", "t1", "lead", "places"]
    gone = found.where("not pending").select(*columns).union(late.select(*columns))
    if keep_first:
        rest = F.when(F.col("lead"), F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))))
        gone = gone.withColumn("places", rest.otherwise(F.col("places"))).where(F.size("places") > 0)
    # A set: rows that repeat a document name the same places.
    return gone.groupBy("_id", "t1").agg(F.flatten(F.collect_set("places")).alias("places"))


def _bitmap_rows(with_text: bool, keep: tuple[str, ...]):
    def run(batches):
        for b in batches:
            n_lines, n_dropped, bitmaps, digests, kept = [], [], [], [], []
            flat, places = b.column("places").flatten().to_numpy(), b.column("places")
            sizes = np.array([0 if x is None else x for x in places.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            for text, size, end in zip(as_bytes(b.column("_text")), sizes, ends):
                n = text.count(b"\n") + 1
                stay = np.ones(n, bool)
                if size:
                    stay[flat[end - size : end]] = False
                    lines = text.split(b"\n")
                    text = b"\n".join([lines[i] for i in np.flatnonzero(stay)])
                n_lines.append(n)
                n_dropped.append(n - int(stay.sum()))
                bitmaps.append(zlib.compress(np.packbits(stay).tobytes()))
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text)
            arrays = [
                b.column("_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                pa.array(bitmaps, pa.binary()), pa.array(digests, pa.string()),
            ]
            names = ["_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("_kept")
            yield with_more(pa.RecordBatch.from_arrays(arrays, names=names), b, keep)

    return run


def line_bitmaps(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH, keep_first: bool = False, with_text: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``_id, n_lines, n_dropped, keep_bitmap, kept_sha256``.

    Keys of ``min_length`` characters or more that ``min_docs`` documents hold lose all
    their lines, or with ``keep_first`` all but the first by identifier and position (null
    first). ``keep_bitmap`` has one bit for each line, highest bit first, 1 if it stays, and is
    compressed by zlib. ``with_text`` adds what stays as ``_kept``, ``keep`` names columns to
    pass on, as ``_<name>``.

    Null is the empty text, which is one empty line; empty lines have no key and stay.
    Every row counts as a document, so rows repeated ``min_docs`` times lose all their
    lines; with ``keep_first``, rows that repeat both identifier and text keep the same ones.
    Identifiers may be null or repeated and keep their type; they must be sortable.
    """
    if min_docs < 1:
        raise ValueError("min_docs must be at least 1")
    rows = texts(df, id_col, text_col, *keep).withColumn("t1", F.xxhash64("_text"))
    kind = id_type(df, id_col)
    gone = repeated_lines(rows, kind, min_docs, min_length, keep_first)
    gone = gone.select(F.col("_id").alias("gone_id"), F.col("t1").alias("gone_t1"), "places")
    same = F.col("_id").eqNullSafe(F.col("gone_id")) & (F.col("t1") == F.col("gone_t1"))
    joined = rows.join(gone, same, "left").drop("gone_id", "gone_t1", "t1")
    schema = f"_id {kind}, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string"
    schema += (", _kept string" if with_text else "") + ddl(df, keep)
    return joined.mapInArrow(_bitmap_rows(with_text, keep), schema)


def kept_lines(bitmap: bytes, n_lines: int) -> list[int]:
    """Places of the lines that stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)
    return np.flatnonzero(bits).tolist()
