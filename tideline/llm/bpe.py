"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the ranks of the pairs of neighbouring symbols of a word.
Each inner node holds the smallest rank below it and the leftmost leaf that has it, so
the root is the next merge. A merge changes its own leaf and the pairs on both sides:
three point updates of logarithmic length. It is over when no leaf has a rank.

Many words are worked on together: their trees are rows of one array, and each round
merges at the root of every word that is not done. Words are encoded once for each
task and remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tideline.llm.common import id_type, per_worker, texts

_NONE = np.int64(1 << 62)
_LATIN = 0x250
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_KNOWN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones stand
    for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merger:
    """Merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        letters = byte_letters()
        self.base = max(vocab.values()) + 1
        self.plain = np.array([vocab.get(x, -1) for x in letters], np.int64)
        self.last = np.array([vocab.get(x + (suffix or ""), -1) for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Places of the pairs by hash, in tables of sparse slots: a pair that finds its
        # slot taken goes to the next table.
        self.tables, rest = [], np.arange(len(pairs))
        while len(rest):
            table = np.zeros(1 << 20, np.int32)
            slots, first = np.unique(self._slot(self.keys[rest], len(self.tables)), return_index=True)
            table[slots] = rest[first]
            self.tables.append(table)
            rest = np.delete(rest, first)

    @staticmethod
    def _slot(key: np.ndarray, turn: int) -> np.ndarray:
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
        return (mixed >> np.uint64(44)).view(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, or a large number."""
        key = a * self.base + b
        out = np.full(len(key), _NONE)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        for turn, table in enumerate(self.tables):
            k = key[open_]
            at = table[self._slot(k, turn)]
            hit = self.keys[at] == k
            out[open_[hit]] = at[hit]
            open_ = open_[~hit]
        return out

    def __call__(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, in the order given."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64)
        for w in np.unique(width).tolist():
            same = np.flatnonzero(width == w)
            most = max(1, (1 << 17) // w)
            for at in range(0, len(same), most):
                part = same[at : at + most]
                for k, ids in zip(part.tolist(), self._merge([words[k] for k in part], w)):
                    out[k] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        raw = np.zeros((n, width + 1), np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = np.arange(width + 1) < sizes[:, None]
        raw[inside] = flat
        symbols = np.where(inside, self.plain[raw], -1)
        ends = sizes > 0
        symbols[np.flatnonzero(ends), sizes[ends] - 1] = self.last[raw[np.flatnonzero(ends), sizes[ends] - 1]]
        # A leaf is rank * width + place, so the smallest is the leftmost of the lowest rank.
        place = np.arange(width)
        rank = self.ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:] = np.where(rank < _NONE, rank * width + place, _NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(
                tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2]
            )
        after = np.where(place[None, :] + 1 < sizes[:, None], place[None, :] + 1, -1)
        after = np.concatenate([after, np.full((n, 1), -1)], 1)
        before = np.concatenate([np.full((n, 1), -1), np.repeat(place[None, :], n, 0)], 1)
        alive = inside.copy()

        flat_tree = tree.reshape(-1)

        def update(rows, leaf, value):
            """Set leaves of the trees in ``rows`` and the nodes above them."""
            base, node = rows * (2 * width), leaf + width
            flat_tree[base + node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                below = base + 2 * node
                flat_tree[base + node] = np.minimum(flat_tree[below], flat_tree[below + 1])

        def pair(rows, a, b):
            rank = self.ranks(symbols[rows, a], symbols[rows, b])
            return np.where(rank < _NONE, rank * width + a, _NONE)

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            a = root % width
            b = after[rows, a]
            symbols[rows, a] = self.made[root // width]
            alive[rows, b] = False
            c = after[rows, b]
            after[rows, a] = c
            has = c >= 0
            before[rows[has], c[has]] = a[has]
            new = np.full(len(rows), _NONE)
            new[has] = pair(rows[has], a[has], c[has])
            p = before[rows, a]
            left, gone = p >= 0, b < width
            update(
                np.concatenate([rows, rows[gone], rows[left]]),
                np.concatenate([a, b[gone], p[left]]),
                np.concatenate([new, np.full(gone.sum(), _NONE), pair(rows[left], p[left], a[left])]),
            )
            rows = rows[tree[rows, 1] < _NONE]
        return [symbols[i, alive[i]] for i in range(n)]


class WordEncoder:
    """Encodes and decodes texts as the tokenizer file says: normalizer, split, merges."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.merger = Merger(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.names, self.unknown = names, model.get("unk_token")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.ids: dict = {}
        self.text: dict = {}
        self.silent: set = set()
        self.most = most
        # Up to _LATIN nothing composes, and lower case has no special rules, so texts of
        # such characters need neither the normalizer nor Unicode classes.
        self.latin = None
        if spec["normalizer"] == _KNOWN_NORMALIZER and r"[\p{L}]" in pattern:
            letters, digits, space = (
                "".join(f"\\u{ord(c):04x}" for c in map(chr, range(_LATIN)) if test(c))
                for test in (
                    lambda c: unicodedata.category(c)[0] == "L",
                    lambda c: unicodedata.category(c)[0] == "N",
                    lambda c: c in _WHITE,
                )
            )
            own = pattern.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", space)
            self.latin = re.compile(own).findall
            self.other = re.compile(f"[^\x00-{chr(_LATIN - 1)}]").search

    def pieces(self, text: str) -> list[str]:
        if self.latin and not self.other(text):
            return self.latin(text.lower())
        return self.split(self.normalize(text))

    def words(self, text: str) -> list:
        """Words of a text; special tokens stand for themselves as one-element tuples."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append((part,))
            elif part:
                out.extend(self.pieces(part))
        return out

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.ids]
        for w in [w for w in new if isinstance(w, tuple)]:
            self.ids[w], self.text[w] = str(self.special[w[0]]), w[0]
        new = [w for w in new if not isinstance(w, tuple)]
        names = self.names
        for w, ids in zip(new, self.merger([w.encode("utf-8") for w in new])):
            ids = ids[ids >= 0].tolist()
            self.ids[w], self.text[w] = " ".join(map(str, ids)), " ".join([names[i] for i in ids])
            if not ids:
                self.silent.add(w)

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids in decimal with single spaces, decoded text, number of ids) of each text."""
        if len(self.ids) > self.most:
            self.ids.clear()
            self.text.clear()
        cut = [self.words(t) for t in texts]
        self.learn({w for c in cut for w in c})
        out = []
        for c in cut:
            if self.silent:
                c = [w for w in c if w not in self.silent]
            ids = " ".join([self.ids[w] for w in c])
            out.append((ids, " ".join([self.text[w] for w in c]), ids.count(" ") + 1 if c else 0))
        return out


def _encode_rows(path: str, with_ids: bool):
    def run(batches):
        fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        more = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        encoder = per_worker(("bpe", path), lambda: WordEncoder(path))
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            schema = pa.schema([("_id", b.column("_id").type)] + fields + more * with_ids)
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = encoder.encode_batch(part.column("_text").to_pylist())
                columns = [
                    part.column("_id"), pa.array([n for *_, n in found], pa.int64()),
                    pa.array([sha(i) for i, *_ in found]), pa.array([sha(d) for _, d, _ in found]),
                ]
                if with_ids:
                    columns.append(pa.array([list(map(int, i.split())) for i, *_ in found], pa.list_(pa.int32())))
                    columns.append(pa.array([d for _, d, _ in found]))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per input row: ``_id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty texts have no ids. Identifiers of any type, null ones and repeated rows
    are passed on. ``with_ids`` adds ``ids`` and ``decoded``. ``tokenizer`` is the path of a
    tokenizer file that every executor can read.
    """
    schema = f"_id {id_type(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" * with_ids
    return texts(df, id_col, text_col).mapInArrow(_encode_rows(tokenizer, with_ids), schema)
