"""Packing of tokenised texts into sequences of a fixed length.

Texts are cut into full windows and a tail. The tails of a block of texts are packed
by non-negative least squares: shallow combinations of lengths that fill a window are
enumerated, their repeat counts are solved against the histogram of tail lengths,
rounded down, and what is left over is packed greedily, cutting where a window is
full. The last, partly filled window of a block is cut into powers of two, which
need no padding.

Blocks are consecutive texts of one task, bounded in number and in tokens, so nothing
is shuffled and no group depends on the size of the input.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from tideline.llm.bpe import byte_letters
from tideline.llm.common import by_size, id_type, per_worker, texts

WINDOW = 2048
#: Texts and tokens of a block.
BLOCK_TEXTS, BLOCK_TOKENS = 8192, 1 << 23
#: Steps between the third lengths of combinations of three.
THIRD = 64
ROUNDS = 300
END = 1
# The pieces of the byte-level pre-tokenizer.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\x00-\u0527\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, for a byte-level BPE file.

    If ids follow the order of the merges, a pair's rank is the id of what it makes, so
    the vocabulary can be given to the faster of the two libraries. It gets texts whose
    characters every version of Unicode classifies alike; all other texts, and those with
    special tokens, are encoded by the library of the file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        vocab, n = model["vocab"], len(model["merges"])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = (
            before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and not spec["normalizer"] and not model.get("ignore_merges") and len(vocab) == 256 + n
            and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs))
        )
        if not plain:
            return None
        byte = {c: i for i, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        found = tiktoken.Encoding("file", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        return found.encode_to_numpy

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self.fast and not _OTHER.search(t) and not any(s in t for s in self.special):
                out.append(self.fast(t, disallowed_special=()).astype("<u4", copy=False).tobytes())
            else:
                found = self.tokenizer.encode(t, add_special_tokens=False)
                out.append(np.array(found.ids, "<u4").tobytes())
        return out


def combinations(window: int = WINDOW, third: int = THIRD) -> np.ndarray:
    """Rows of up to three lengths (0 for none) that fill a window: all pairs, and
    triples whose smallest length is a multiple of ``third``."""
    a = np.arange(1, window // 2 + 1)
    rows = [np.stack([np.zeros_like(a), a, window - a], 1)]
    for c in range(third, window // 3 + 1, third):
        a = np.arange(c, (window - c) // 2 + 1)
        rows.append(np.stack([np.full_like(a, c), a, window - c - a], 1))
    return np.concatenate(rows)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x with A x near the histogram, by accelerated projected gradients.

    A has a column for each combination and counts each of its lengths. Weights of
    1/sqrt(n) make rare lengths matter as much as frequent ones.
    """
    used = combos.astype(np.int64)
    have = histogram > 0
    have[0] = True
    fits = np.flatnonzero(have[used].all(axis=1))
    out = np.zeros(len(combos))
    if len(fits) == 0:
        return out
    used = used[fits]
    target = histogram.astype(float)
    target[0] = 0
    load = np.bincount(used.ravel(), minlength=len(histogram)).astype(float)
    load[0] = 0
    step = 1 / (3 * max(load.max(), 1))
    x = np.zeros(len(used))
    y, t = x, 1.0
    for _ in range(rounds):
        made = np.bincount(used.ravel(), np.repeat(y, 3), minlength=len(histogram))
        made[0] = 0
        after = np.maximum(y - step * (made - target)[used].sum(axis=1), 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = after + (before - 1) / t * (after - x)
        x = after
    out[fits] = x
    return out


def pack_tails(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (tail, start, length, sequence, offset) that pack tails shorter than a window."""
    histogram = np.bincount(lengths, minlength=window)
    combos = combinations(window)
    counts = np.floor(repeat_counts(histogram, combos) + 1e-6).astype(np.int64)
    order = np.argsort(lengths, kind="stable")
    place = np.concatenate([[0], np.cumsum(histogram)])
    taken = np.zeros(window + 1, np.int64)
    pieces, sequence = [], 0
    for i in np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].tolist():
        parts = [p for p in combos[i].tolist() if p]
        kinds, need = np.unique(parts, return_counts=True)
        n = min(counts[i], ((histogram[kinds] - taken[kinds]) // need).min())
        for _ in range(n):
            offset = 0
            for p in parts:
                pieces.append((int(order[place[p] + taken[p]]), 0, p, sequence, offset))
                taken[p] += 1
                offset += p
            sequence += 1
    # Greedy: the longest first, cut where a window is full.
    offset = 0
    last = len(pieces)
    for length in range(window - 1, 0, -1):
        for k in range(taken[length], histogram[length]):
            tail, start = int(order[place[length] + k]), 0
            while start < length:
                part = min(length - start, window - offset)
                pieces.append((tail, start, part, sequence, offset))
                start, offset = start + part, offset + part
                if offset == window:
                    sequence, offset, last = sequence + 1, 0, len(pieces)
    # The window that stays open is cut into powers of two.
    rest, pieces, total = pieces[last:], pieces[:last], offset
    size = 1 << max(total.bit_length() - 1, 0)
    offset = 0
    for tail, start, length, *_ in rest:
        while length:
            part = min(length, size - offset)
            pieces.append((tail, start, part, sequence, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == size:
                total -= size
                sequence, offset, size = sequence + 1, 0, 1 << max(total.bit_length() - 1, 0)
    return pieces


_FIELDS = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
]


def _pack_rows(path: str, window: int, end: int, with_ids: bool, kind: pa.DataType):
    fields = [("_id", kind), *_FIELDS]

    def run(batches):
        schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
        encoder = per_worker(("packing", path), lambda: Encoder(path))
        tail_end = np.array([end], "<u4").tobytes()
        base, used = TaskContext.get().partitionId() << 33, 0

        def encoded():
            for b in batches:
                ids, column = b.column("_id").to_pylist(), b.column("_text")
                for at in range(0, len(ids), 512):
                    part = encoder(column.slice(at, 512).to_pylist())
                    for i, x in zip(ids[at : at + 512], part):
                        yield i, x + tail_end

        def emit(rows):
            columns = list(zip(*rows))
            ids = columns.pop() if with_ids else None
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields)]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def row(i, data, start, length, sequence, offset):
            part = data[4 * start : 4 * (start + length)]
            out = (i, start, length, zlib.crc32(part), len(data) // 4, base + sequence, offset)
            return out + (part,) * with_ids

        share = max(1, BLOCK_TOKENS // BLOCK_TEXTS)
        weight = lambda x: max(share, len(x[1]) // 4)
        for block in by_size(encoded(), weight, BLOCK_TOKENS):
            rows = []
            for i, data in block:
                for start in range(0, len(data) // 4 - window + 1, window):
                    rows.append(row(i, data, start, window, used, 0))
                    used += 1
                if with_ids and len(rows) > 4096:
                    yield emit(rows)
                    rows = []
            cut = [len(data) // 4 // window * window for _, data in block]
            tails = np.array([len(data) // 4 - c for (_, data), c in zip(block, cut)], np.int64)
            pieces = pack_tails(tails, window)
            for k, start, length, sequence, offset in pieces:
                i, data = block[k]
                rows.append(row(i, data, cut[k] + start, length, used + sequence, offset))
            used += max((p[3] for p in pieces), default=-1) + 1
            for at in range(0, len(rows), 4096):
                yield emit(rows[at : at + 4096])

    return run


def pack(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A text is its ids followed by the id ``end``; null and empty texts have that one id.
    Each id lies in one piece, and pieces fill a sequence from offset 0 without gaps.
    A sequence is full or a power of two long. Null identifiers and repeated rows are
    passed on, each row as a text of its own. ``with_ids`` adds the ids. ``tokenizer``
    is the path of a tokenizer file that every executor can read.
    """
    if window < 2 or window & window - 1:
        raise ValueError("window must be a power of two")
    kind = to_arrow_type(df.schema[id_col].dataType)
    schema = (
        f"_id {id_type(df, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long" + ", ids array<int>" * with_ids
    )
    return texts(df, id_col, text_col).mapInArrow(_pack_rows(tokenizer, window, end, with_ids, kind), schema)
