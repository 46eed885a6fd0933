"""Exact removal of repeated passages by a depth-limited radix sort of suffixes.

Two suffixes matter to each other only through their first ``threshold`` bytes.
They are put into groups by most-significant-digit passes; a group of one is
finished and leaves, and the groups after the last pass are the repeated windows:

1. The leading digit is ``digit`` bytes at an *anchor*: of all the digits inside a
   window, the one with the smallest hash. Equal windows have equal anchors at
   equal places, so a window repeats only if its anchor's digit repeats, and one
   suffix stands for the hundred or more windows that share an anchor.
2. The second digit is everything those windows cover. A group of two or more is
   finished: all windows of the anchor repeat.
3. What is left (the edges of passages, and copies with changes) goes on with one
   anchor for each group of pass 2, in chunks of neighbouring windows. The digit is
   the text that all windows of the chunk share, then everything they cover.
4. Chunks whose shared text repeats, but not as a whole, are expanded into single
   windows, grouped by all ``threshold`` bytes.

Digits after the first are compared by 128-bit hashes. Each pass counts with
partial aggregates, so a passage that a third of all texts holds meets as one
row from each task. Texts move only if a filter of fixed size cannot rule out that
they take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, batch, ddl, id_type, key_filter, texts, with_filter, with_more
from tideline.scratch import materialise

THRESHOLD = 400
DIGIT = 64
#: Chunks that the windows of an anchor are put in.
CHUNKS = 8
#: Windows of a text that are looked at together; longer texts are walked in such steps.
STRIDE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


def digit_hashes(data: np.ndarray, digit: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of every ``digit`` bytes, from prefix sums of a polynomial modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    h = (sums[digit:] - sums[:-digit]) * inverse[: len(data) - digit + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of every ``w`` hashes, the leftmost of equal ones."""
    n = len(h)
    place = np.arange(n, dtype=np.uint64)
    key = (h >> np.uint64(24) << np.uint64(24)) | place
    blocks = -(-n // w)
    padded = np.full(blocks * w, _MASK, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[: n - w + 1], head[w - 1 : n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


class Anchors:
    """Anchors of a text: place, first and last window, hash of the leading digit."""

    def __init__(self, threshold: int, digit: int):
        self.threshold, self.digit = threshold, digit
        n = STRIDE + threshold
        self.powers, self.inverse = _powers(_BASE, n), _powers(_INVERSE, n)

    def of(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        n, t, d = len(data), self.threshold, self.digit
        for start in range(0, n - t + 1, STRIDE):
            part = data[start : start + STRIDE + t - 1]
            h = digit_hashes(part, d, self.powers, self.inverse)
            least = sliding_argmin(h, t - d + 1)
            first = np.flatnonzero(np.diff(least, prepend=-1))
            last = np.append(first[1:], len(least)) - 1
            place = least[first]
            yield place + start, first + start, last + start, h[place]


def _anchor_digits(threshold: int, digit: int):
    """The leading digits of all anchors, for counting."""

    def run(batches):
        schema = pa.schema([("d1", pa.int64())])
        anchors = Anchors(threshold, digit)
        for b in batches:
            for text in as_bytes(b.column("_text")):
                if len(text) >= threshold:
                    for *_, h in anchors.of(text):
                        yield batch(schema, h.view(np.int64))

    return run


def _anchor_rows(threshold: int, digit: int):
    """One row per anchor, with the hash of all that its windows cover.

    ``spot`` packs the place of the anchor and how far before it its first and its
    last window start.
    """

    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("d1", "n1", "n2", "s1", "s2", "spot")])
        anchors = Anchors(threshold, digit)
        for b in batches:
            s1, s2 = b.column("s1").to_numpy(), b.column("s2").to_numpy()
            for i, text in enumerate(as_bytes(b.column("_text"))):
                if len(text) < threshold:
                    continue
                for place, first, last, h in anchors.of(text):
                    whole = b"".join(
                        xxhash.xxh3_128_digest(text[p : q + threshold], seed=a - p)
                        for a, p, q in zip(place.tolist(), first.tolist(), last.tolist())
                    )
                    n = np.frombuffer(whole, np.int64).reshape(-1, 2)
                    same = np.ones(len(h), np.int64)
                    spot = (place << 32) | ((place - first) << 16) | (place - last)
                    yield batch(
                        schema, h.view(np.int64), n[:, 0].copy(), n[:, 1].copy(),
                        same * s1[i], same * s2[i], spot,
                    )

    return run


def _chunk_rows(threshold: int, digit: int, chunks: int):
    """The windows of the given anchors in chunks of neighbours.

    ``core`` is the hash of what all windows of a chunk share, ``f1, f2`` of all they cover.
    """
    width = -(-(threshold - digit + 1) // chunks)

    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("core", "f1", "f2", "s1", "s2", "first", "last")])
        for b in batches:
            s1, s2 = b.column("s1").to_numpy(), b.column("s2").to_numpy()
            spots, out, whole = b.column("spots").to_pylist(), [], []
            for i, text in enumerate(as_bytes(b.column("_text"))):
                for spot in spots[i]:
                    a, far, near = spot >> 32, spot >> 16 & 0xFFFF, spot & 0xFFFF
                    for g in range(near // width, far // width + 1):
                        least, most = g * width, g * width + width - 1
                        core = text[a - least : a - most + threshold]
                        least, most = max(near, least), min(far, most)
                        whole.append(
                            xxhash.xxh3_64_digest(core, seed=g)
                            + xxhash.xxh3_128_digest(
                                text[a - most : a - least + threshold], seed=most << 16 | least
                            )
                        )
                        out.append((s1[i], s2[i], a - most, a - least))
            if out:
                h = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 3)
                rest = np.array(out, np.int64)
                yield batch(schema, *np.ascontiguousarray(h.T), *np.ascontiguousarray(rest.T))

    return run


def _window_rows(threshold: int):
    """The single windows of the given ranges, with the hash of all their bytes."""

    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "s1", "s2", "at")])
        for b in batches:
            s1, s2 = b.column("s1").to_numpy(), b.column("s2").to_numpy()
            ranges = b.column("ranges").to_pylist()
            for i, text in enumerate(as_bytes(b.column("_text"))):
                for r in ranges[i]:
                    p, q = r["first"], r["last"]
                    whole = b"".join(
                        xxhash.xxh3_128_digest(text[x : x + threshold]) for x in range(p, q + 1)
                    )
                    w = np.frombuffer(whole, np.int64).reshape(-1, 2)
                    same = np.ones(q + 1 - p, np.int64)
                    yield batch(
                        schema, w[:, 0].copy(), w[:, 1].copy(), same * s1[i], same * s2[i],
                        np.arange(p, q + 1, dtype=np.int64),
                    )

    return run


def covered(first: np.ndarray, last: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes (start, end) that windows from first to last cover."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + threshold)
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return start[new], end[np.append(new[1:], len(start)) - 1]


def _cut(threshold: int, with_text: str | None, keep: tuple[str, ...]):
    fields = [
        ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]

    def run(batches):
        kept_type = pa.string() if with_text == "text" else pa.binary()
        for b in batches:
            own = [("_id", b.column("_id").type)]
            schema = pa.schema(own + fields + [("_kept", kept_type)] * bool(with_text))
            ranges, n = b.column("ranges").to_pylist(), b.num_rows
            out = [[] for _ in schema.names]
            for i, text in enumerate(as_bytes(b.column("_text"))):
                kept, spans = text, []
                if ranges[i]:
                    flat = np.array([(r["first"], r["last"]) for r in ranges[i]], np.int64)
                    start, end = covered(flat[:, 0], flat[:, 1], threshold)
                    spans = np.stack([start, end], 1).tolist()
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                row = (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans)
                if with_text:
                    row += (kept.decode("utf-8", "replace") if with_text == "text" else kept,)
                for column, x in zip(out[1:], row):
                    column.append(x)
            out[0] = b.column("_id")
            if n:
                yield with_more(batch(schema, *out), b, keep)

    return run


def settle(alive: DataFrame, digit: str, whole: list[str], spot: list[str]):
    """One pass: (rows whose group is finished, one row of each group that goes on).

    Rows alike in ``digit`` and ``whole`` are a finished group if there are two or
    more. A group goes on if another one has the same digit.
    """
    groups = alive.groupBy(digit, *whole).agg(
        F.count("*").alias("members"), F.min(F.struct("s1", "s2", *spot)).alias("one")
    )
    groups = materialise(groups, "groups")
    many = groups.where("members > 1").select(digit, *whole)
    finished = alive.join(many, [digit, *whole], "left_semi").select("s1", "s2", *spot)
    shared = materialise(groups.groupBy(digit).count().where("count > 1").select(digit), "shared")
    return finished, groups.join(shared, digit, "left_semi").select("one.*")


def _named_in(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows whose text may be in ``named``."""
    words = materialise(key_filter(named, "s1", "s2"), "filter")
    return with_filter(rows, words, "s1", "s2").where("_maybe").drop("_maybe")


def repeated_ranges(
    rows: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, chunks: int = CHUNKS
) -> DataFrame:
    """(s1, s2, first, last): windows of each text that start elsewhere too, as ranges of places.

    ``rows`` has ``_text`` and its hashes ``s1, s2``. Equal texts share their ranges.
    """
    narrow = rows.select("_text", "s1", "s2")

    def longs(names: str) -> str:
        return ", ".join(f"{c} long" for c in names.split())

    every = rows.select("_text").mapInArrow(_anchor_digits(threshold, digit), "d1 long")
    # Written first, so that both sides of the join are shuffled and a hot digit is split.
    repeated = materialise(every.groupBy("d1").count().where("count > 1").select("d1"), "repeated")
    anchors = narrow.mapInArrow(_anchor_rows(threshold, digit), longs("d1 n1 n2 s1 s2 spot"))
    alive = materialise(anchors.join(repeated, "d1", "left_semi"), "anchors")
    finished, going = settle(alive, "d1", ["n1", "n2"], ["spot"])
    spot = F.col("spot")
    first = F.shiftright(spot, 32) - F.shiftright(spot, 16).bitwiseAND(0xFFFF)
    done = [
        materialise(
            finished.distinct().select(
                "s1", "s2", first.alias("first"),
                (F.shiftright(spot, 32) - spot.bitwiseAND(0xFFFF)).alias("last"),
            ),
            "finished",
        )
    ]
    going = materialise(going.groupBy("s1", "s2").agg(F.collect_set("spot").alias("spots")), "going")

    taking_part = _named_in(narrow, going)
    pieces = taking_part.join(going, ["s1", "s2"]).select("_text", "s1", "s2", "spots").mapInArrow(
        _chunk_rows(threshold, digit, chunks), longs("core f1 f2 s1 s2 first last")
    )
    finished, going = settle(materialise(pieces, "chunks"), "core", ["f1", "f2"], ["first", "last"])
    done.append(finished.distinct())
    going = materialise(
        going.groupBy("s1", "s2").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "going"
    )
    taking_part = _named_in(narrow, going)
    windows = taking_part.join(going, ["s1", "s2"]).select("_text", "s1", "s2", "ranges").mapInArrow(
        _window_rows(threshold), longs("w1 w2 s1 s2 at")
    )
    windows = materialise(windows, "windows")
    again = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    at = F.col("at")
    done.append(
        windows.join(again, ["w1", "w2"], "left_semi")
        .select("s1", "s2", at.alias("first"), at.alias("last")).distinct()
    )
    return materialise(done[0].union(done[1]).union(done[2]), "ranges")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: int = THRESHOLD, digit: int = DIGIT, with_text: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: what stays after repeated passages have been cut out.

    A byte goes if a string of ``threshold`` bytes that covers it also starts at
    another place, in the same or in another text; overlapping places count. Texts
    are compared as UTF-8 bytes, null as empty, and matches never cross texts.
    Repeated rows count as other texts, so both lose everything; texts shorter than
    the threshold stay whole. Identifiers of any type, null and repeated ones too, are passed on. Columns:
    ``_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (start and end of each
    cut), ``keep`` as ``_<name>`` and what stays as ``_kept``: with ``with_text="bytes"`` its
    bytes, with ``"text"`` a string, where a character that was cut apart becomes a mark.
    """
    if not 0 < digit <= threshold:
        raise ValueError("digit must lie between 1 and threshold")
    if threshold > 0xFFFF:
        raise ValueError("threshold must be below 65,536")
    if with_text not in (None, "bytes", "text"):
        raise ValueError("with_text must be None, bytes or text")
    rows = texts(df, id_col, text_col, *keep).withColumns(
        {"s1": F.xxhash64("_text"), "s2": F.xxhash64(F.lit("second"), "_text")}
    )
    ranges = repeated_ranges(rows, threshold, digit)
    rows = with_filter(rows, materialise(key_filter(ranges, "s1", "s2"), "filter"), "s1", "s2")
    per_text = ranges.groupBy("s1", "s2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    more = [f"_{c}" for c in keep]
    whole = rows.where("not _maybe").select(
        "_id", "_text", *more, F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("ranges")
    )
    cut = rows.where("_maybe").join(per_text, ["s1", "s2"], "left").select("_id", "_text", *more, "ranges")
    kind = "string" if with_text == "text" else "binary"
    schema = (
        f"_id {id_type(df, id_col)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<array<long>>" + (f", _kept {kind}" if with_text else "") + ddl(df, keep)
    )
    return whole.union(cut).mapInArrow(_cut(threshold, with_text, keep), schema)
