"""Chat formatting by columnar byte assembly.

A batch of conversations becomes one buffer: segment lengths of headers, contents and
ends are computed for all turns, their cumulative sums are the offsets, and the bytes
of each kind of segment are scattered into one preallocated Arrow buffer by index
arrays. No string of a single turn is ever built.

The template of a turn is ``<s>[INST]role[/INST]`` + text + ``</s>``. Control strings
inside roles and texts are broken up by a backslash after their first character; one
more is put in where such a backslash is already there, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])"
_UNESCAPE = re.compile(rb"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(rb"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
#: Bytes of text that are assembled at once, beyond which a single conversation may go.
MOST = 1 << 24


def escape(column: pa.Array) -> pa.Array:
    """Texts without any control string, as UTF-8 bytes."""
    safe = pc.replace_substring_regex(pc.fill_null(column, ""), _ESCAPE, r"\1\\\2\3")
    return safe.cast(pa.large_string()).cast(pa.large_binary())


def unescape(data: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2\3", data)


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _parts(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and the offsets of its rows in them."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy row i of ``data`` to ``starts[i]`` on."""
    out[np.repeat(starts - offsets[:-1], np.diff(offsets)) + np.arange(len(data))] = data


def _stamp(out: np.ndarray, starts: np.ndarray, word: bytes) -> None:
    out[starts[:, None] + np.arange(len(word))] = np.frombuffer(word, np.uint8)


def assemble(roles: pa.Array, contents: pa.Array, firsts: np.ndarray, loss_role: str = "assistant"):
    """(formatted conversations, mask) of turns in order; ``firsts`` are the first turns.

    The mask lists start and end bytes, in its conversation, of each text of ``loss_role``.
    """
    counts = np.asarray(pc.equal(pc.fill_null(roles, ""), loss_role))
    role, role_at = _parts(escape(roles))
    text, text_at = _parts(escape(contents))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    fixed = len(OPEN) + len(MIDDLE) + len(CLOSE)
    ends = np.cumsum(role_n + text_n + fixed)
    begin = ends - (role_n + text_n + fixed)
    buffer = pa.allocate_buffer(int(ends[-1]) if len(ends) else 0)
    out = np.frombuffer(buffer, np.uint8)
    out.flags.writeable = True
    at = begin
    _stamp(out, at, OPEN)
    at = at + len(OPEN)
    _scatter(out, at, role, role_at)
    at = at + role_n
    _stamp(out, at, MIDDLE)
    at = at + len(MIDDLE)
    _scatter(out, at, text, text_at)
    _stamp(out, at + text_n, CLOSE)
    cuts = np.append(begin[firsts], ends[-1:]).astype(np.int64)
    formatted = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(firsts), [None, pa.py_buffer(cuts), buffer]
    )
    base = np.repeat(begin[firsts], np.diff(np.append(firsts, len(begin))))
    spans = np.stack([at - base, at - base + text_n], 1)[counts]
    per = np.add.reduceat(counts.astype(np.int64), firsts) if len(firsts) else np.zeros(0, np.int64)
    pairs = pa.FixedSizeListArray.from_arrays(pa.array(spans.ravel()), 2)
    offsets = np.concatenate([[0], np.cumsum(per)])
    mask = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs.cast(pa.list_(pa.int64())))
    return formatted, mask


def _rows_to_conversations(loss_role: str):
    schema = pa.schema(
        [("_id", pa.int64()), ("formatted", pa.binary()), ("mask", pa.list_(pa.list_(pa.int64())))]
    )

    def emit(t: pa.Table):
        ids = t.column("_id").combine_chunks()
        keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        null = np.asarray(ids.is_null())
        new = np.append(True, (keys[1:] != keys[:-1]) | (null[1:] != null[:-1]))
        firsts = np.flatnonzero(new)
        formatted, mask = assemble(
            t.column("_role").combine_chunks(), t.column("_text").combine_chunks(), firsts, loss_role
        )
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(firsts)), formatted.cast(pa.binary()), mask.cast(schema.types[2])],
            schema=schema,
        )

    def run(batches):
        held = None  # rows of conversations that are not over, in order
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.nbytes < MOST:
                continue
            ids = held.column("_id").to_pylist()
            cut = len(ids)
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut:
                yield emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield emit(held)

    return run


def format_chats(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``_id, formatted`` (UTF-8 bytes) and ``mask``.

    ``mask`` holds (start, end) byte places in ``formatted`` of the texts of
    ``loss_role``. Turns are ordered by ``turn_col`` (nulls first), then role and text,
    so ties have one result. Null roles and texts are empty; rows without an identifier
    are one conversation; repeated rows are repeated turns.
    """
    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{turn_col}`").alias("_turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
    )
    return (
        rows.repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text")
        .mapInArrow(
            _rows_to_conversations(loss_role),
            "_id long, formatted binary, mask array<array<long>>",
        )
    )


def _read_rows():
    names = ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    chars = lambda data: len(data.decode("utf-8", "replace"))

    def run(batches):
        schema = pa.schema(list(zip(names, kinds)))
        for b in batches:
            out = [[] for _ in names]
            rows = zip(b.column("_id").to_pylist(), b.column("formatted"), b.column("mask").to_pylist())
            for i, data, mask in rows:
                data = data.as_py()
                turns = read_turns(data)
                whole = hashlib.sha256()
                for role, text in turns:
                    whole.update(role + b"\n" + text + b"\n")
                loss = b"".join(unescape(data[a:z]) for a, z in mask)
                row = (
                    i, len(turns), whole.hexdigest(), chars(loss),
                    hashlib.sha256(loss).hexdigest(), chars(data),
                )
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], schema=schema
            )

    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from their bytes and masks alone."""
    return formatted.mapInArrow(
        _read_rows(),
        "_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
