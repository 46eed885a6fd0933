"""A hidden Markov language model, trained by Baum-Welch over all training texts.

A latent state emits the class of the next word (a hash of its first and last
letters), and the class emits the word by its share of the class. States, transitions
and emissions are learned from expected counts that every partition sums up and Spark
adds. The size of the model (states x classes) does not depend on the corpus. Counts
of words do, so they stay in tables: each block of texts gets the counts of its own
words by a join.

The likelihood of a text is the sum over all state sequences, by the scaled forward
recursion over its whole length. Segments of a text are worked on at the same time, as
products of matrices, which are then multiplied in order. Training carries the state across
the cuts of a long text in the same way, forward and backward, so it learns what it would
from the uncut text.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, bounded_batches
from tideline.scratch import materialise, scratch_path

STATES, ROUNDS, CLASSES = 4, 4, 1 << 15
#: Text bytes of a block, and tokens of a segment.
BLOCK_BYTES, SEGMENT = 16 << 20, 512
#: Counts of words that go back to their blocks in one go.
RETURNED = 1 << 20
#: Segments that are trained or scored at once.
TOGETHER = 1024
#: Steps whose expected counts are added up at once.
FOLDED = 32
#: Steps after which products of matrices are scaled: probabilities of 1e-12 a step stay in range.
SCALED = 16
ALPHA = 0.1
END = b""
SEED = 1


def word_class(word: bytes, classes: int = CLASSES) -> int:
    """Class of a word; the end of a text has a class of its own."""
    if word == END:
        return classes
    return xxhash.xxh3_64_intdigest(word[:2] + b"\0" + word[-3:]) % classes


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("hashes", pa.binary()),
        ("kinds", pa.binary()), ("counts", pa.binary()),
    ]
)
_BLOCK_DDL = (
    "block long, ids array<long>, held array<boolean>, sizes array<long>, tokens binary, "
    "hashes binary, kinds binary, counts binary"
)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes: blocks are read and shuffled more often than they are made.

    Bytes of equal weight are stored together; the upper ones are mostly alike.
    """
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def _block_rows(classes: int):
    """Texts as numbers of words in the dictionary of their block, one row per block."""

    def run(batches):
        base, nth = TaskContext.get().partitionId() << 32, 0
        number = None

        def emit():
            nonlocal nth
            words = list(number)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
            kinds = np.fromiter((word_class(w, classes) for w in words), np.int32, len(words))
            trained = [x for x, h in zip(tokens, held) if not h]
            flat = np.concatenate(trained) if trained else np.zeros(0, np.uint32)
            counts = np.bincount(flat, minlength=len(words)).astype(np.int64)
            row = (
                base + nth, ids, held, [len(x) for x in tokens], packed(np.concatenate(tokens)),
                hashes.tobytes(), packed(kinds), packed(counts),
            )
            nth += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, _BLOCK.types)], schema=_BLOCK
            )

        size = 0
        for b in batches:
            columns = zip(b.column("_id").to_pylist(), b.column("held").to_pylist(), as_bytes(b.column("_text")))
            for i, h, text in columns:
                if number is None:
                    number, size = defaultdict(), 0
                    number.default_factory = number.__len__
                    ids, held, tokens = [], [], []
                words = text.lower().split()
                words.append(END)
                ids.append(i)
                held.append(h)
                tokens.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                size += len(text) + 64
                if size >= BLOCK_BYTES:
                    yield emit()
                    number = None
        if number is not None:
            yield emit()

    return run


def _dictionary_rows():
    schema = pa.schema([("hash", pa.int64()), ("block", pa.int64()), ("nth", pa.int32()), ("n", pa.int64()), ("kind", pa.int32())])

    def run(batches):
        for b in batches:
            for block, hashes, kinds, counts in zip(*(b.column(c).to_pylist() for c in ("block", "hashes", "kinds", "counts"))):
                h, n = np.frombuffer(hashes, np.int64), unpacked(counts, np.int64)
                k = unpacked(kinds, np.int32)
                for at in range(0, len(h), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    m = len(h[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[part]), pa.array(np.full(m, block)),
                            pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array(n[part]), pa.array(k[part]),
                        ],
                        schema=schema,
                    )

    return run


def _returned_rows():
    """Counts of words as one compressed row for each block, out of (block, nth, c)."""
    schema = pa.schema([("block", pa.int64()), ("nths", pa.binary()), ("cs", pa.binary())])

    def run(batches):
        held, size = [], 0

        def out():
            block, nth, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((nth, block))
            block, nth, c = block[order], nth[order], c[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                row = block[at], packed(np.diff(nth[at:to], prepend=nth.dtype.type(0))), packed(c[at:to])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for b in batches:
            if b.num_rows:
                held.append([b.column(x).to_numpy() for x in ("block", "nth", "c")])
                size += b.num_rows
            if size >= RETURNED:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


class Segments:
    """Sequences cut into segments, in steps over all of them, the longest first.

    ``flat`` holds class numbers. ``steps`` yields for each step the number of
    segments that are that long, and ``columns[t]`` their classes.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT):
        pieces = -(-sizes // segment)
        self.text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * segment
        length = np.minimum(np.repeat(sizes, pieces) - nth * segment, segment)
        self.nth, self.start, self.length, self.flat = nth, start, length, flat

    def parts(self, together: int = TOGETHER):
        """(numbers of segments, list of classes for each step) of groups of segments."""
        order = np.argsort(-self.length, kind="stable")
        for at in range(0, len(order), together):
            part = order[at : at + together]
            length, start = self.length[part], self.start[part]
            alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
            yield part, [self.flat[start[:n] + t] for t, n in enumerate(alive.tolist())]


class Model:
    """Start, transition and emission probabilities; the emissions include the end's class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, kinds: np.ndarray, states: int, seed: int = SEED) -> Model:
        """From the counts of classes, with a deterministic disturbance of each state."""
        share = (kinds + ALPHA) / (kinds + ALPHA).sum()
        noise = np.random.default_rng(seed).uniform(0.5, 1.5, (states, len(kinds)))
        emit = share * noise
        move = np.full((states, states), 0.05 / max(states - 1, 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def from_counts(cls, start, move, emit, share) -> Model:
        """Re-estimated from expected counts; ``share`` smooths classes that a state never saw."""
        emit = emit + ALPHA * len(share) * share / 100 + 1e-12
        return cls(
            (start + ALPHA) / (start + ALPHA).sum(),
            (move + ALPHA) / (move + ALPHA).sum(axis=1, keepdims=True),
            emit / emit.sum(axis=1, keepdims=True),
        )

    def expected(self, segments: Segments, n: int):
        """Expected counts (start, move, emit) over ``n`` texts, and their log likelihood."""
        k, classes = self.emit.shape
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
        total, table = 0.0, np.ascontiguousarray(self.emit.T)
        before, after = self._carried(segments, n)
        for part, steps in segments.parts():
            first = segments.nth[part] == 0
            alphas, scales = [], []
            for t, kinds in enumerate(steps):
                b = table[kinds]
                if t == 0:
                    # The first state of a text has no move before it; others come over a cut.
                    coming = np.where(first[:, None], self.start, before[part] @ self.move)
                else:
                    coming = alphas[-1][: len(b)] @ self.move
                a = coming * b
                s = a.sum(axis=1, keepdims=True)
                alphas.append(a / s)
                scales.append(s)
            if scales:
                total += np.log10(np.concatenate(scales)).sum()
            behind, ahead, held = after[part], np.zeros((0, k)), []
            for t in range(len(steps) - 1, -1, -1):
                c, m = len(steps[t]), len(ahead)
                beta = np.empty((c, k))
                if m:
                    move += self.move * (alphas[t][:m].T @ ahead)
                    beta[:m] = ahead @ self.move.T
                # Segments that end here, scaled so that their states sum to one.
                ends = behind[m:c]
                beta[m:] = ends / (alphas[t][m:] * ends).sum(axis=1, keepdims=True)
                gamma = alphas[t] * beta
                # Folded into the counts every few steps: only the forward states are held.
                held.append((steps[t], gamma))
                if len(held) == FOLDED or t == 0:
                    kinds, shares = (np.concatenate(x) for x in zip(*held))
                    for i in range(k):
                        emit[:, i] += np.bincount(kinds, shares[:, i], minlength=classes)
                    held = []
                ahead = table[steps[t]] * beta / scales[t]
            if steps:
                start += gamma[first].sum(axis=0)
                # Moves over the cuts, from the state before a segment to its first one.
                move += self.move * (before[part][~first].T @ ahead[~first])
        return start, move, emit, total

    def _carried(self, segments: Segments, n: int):
        """State before each segment, and the backward vector after it, both scaled."""
        k, count = len(self.start), len(segments.text)
        before, after = np.tile(self.start, (count, 1)), np.ones((count, k))
        pieces = np.bincount(segments.text, minlength=n)
        cut = np.flatnonzero(pieces[segments.text] > 1)
        if len(cut) == 0:
            return before, after
        # Only texts of several segments need the products.
        some = Segments.__new__(Segments)
        some.flat, some.text = segments.flat, segments.text[cut]
        some.nth, some.start, some.length = segments.nth[cut], segments.start[cut], segments.length[cut]
        products, _ = self._products(some)
        state, back = np.tile(self.start, (n, 1)), np.ones((n, k))
        last = int(some.nth.max())
        for nth in range(last + 1):
            here = np.flatnonzero(some.nth == nth)
            before[cut[here]] = state[some.text[here]]
            state[some.text[here]] = _scaled(np.einsum("ni,nij->nj", state[some.text[here]], products[here]))
        for nth in range(last, -1, -1):
            here = np.flatnonzero(some.nth == nth)
            after[cut[here]] = back[some.text[here]]
            back[some.text[here]] = _scaled(np.einsum("nij,nj->ni", products[here], back[some.text[here]]))
        return before, after

    def _products(self, segments: Segments):
        """Scaled product of the matrices of each segment, and the log10 of its scale.

        The first segment of a text begins with its first state, others with a move.
        """
        k = len(self.start)
        table = np.ascontiguousarray(self.emit.T)
        products = np.empty((len(segments.text), k, k))
        logs = np.zeros(len(segments.text))
        for part, steps in segments.parts():
            m = np.tile(np.eye(k), (len(part), 1, 1))
            log = np.zeros(len(part))
            first = segments.nth[part] == 0
            for t, kinds in enumerate(steps):
                c = len(kinds)
                # All rows of all matrices at once: one product, not one for each matrix.
                ahead = (m[:c].reshape(-1, k) @ self.move).reshape(c, k, k)
                if t == 0:
                    ahead[first[:c]] = m[:c][first[:c]]  # a text's first state has no move before it
                ahead *= table[kinds][:, None, :]
                ended = len(steps[t + 1]) if t + 1 < len(steps) else 0
                if t % SCALED == SCALED - 1:
                    ended = 0
                # Scaled now and then, and where a segment ends.
                s = ahead[ended:].reshape(c - ended, k * k).max(axis=1)
                ahead[ended:] /= s[:, None, None]
                log[ended:c] += np.log10(s)
                m[:c] = ahead
            products[part], logs[part] = m, log
        return products, logs

    def log10(self, segments: Segments, n: int) -> np.ndarray:
        """Exact log10 likelihood of the classes of each of ``n`` texts."""
        products, logs = self._products(segments)
        out = np.zeros(n)
        state = np.tile(self.start, (n, 1))
        for nth in range(int(segments.nth.max()) + 1 if len(segments.nth) else 0):
            here = np.flatnonzero(segments.nth == nth)
            text = segments.text[here]
            after = np.einsum("ni,nij->nj", state[text], products[here])
            s = after.sum(axis=1, keepdims=True)
            state[text] = after / s
            out[text] += logs[here] + np.log10(s[:, 0])
        return out


def _scaled(rows: np.ndarray) -> np.ndarray:
    return rows / rows.sum(axis=1, keepdims=True)


def _unpacked(row: dict):
    """(flat token numbers, sizes, held out, classes of the dictionary) of a block."""
    return (
        unpacked(row["tokens"], np.uint32).astype(np.int64), np.array(row["sizes"], np.int64),
        np.array(row["held"], bool), unpacked(row["kinds"], np.int32).astype(np.int64),
    )


def _expected_rows(model: Model):
    """Expected counts of a partition: one row per class, and rows for moves and starts."""
    k, classes = model.emit.shape
    schema = pa.schema([("nth", pa.int32()), *((f"v{i}", pa.float64()) for i in range(k))])

    def run(batches):
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)), 0.0
        for b in batches:
            for at in range(b.num_rows):
                flat, sizes, held, kinds = _unpacked(b.slice(at, 1).to_pylist()[0])
                flat, sizes = kinds[flat[np.repeat(~held, sizes)]], sizes[~held]
                found = model.expected(Segments(flat, sizes), len(sizes))
                start, move, emit = start + found[0], move + found[1], emit + found[2]
                total += found[3]
        some = np.flatnonzero(emit.any(axis=1))
        rows = np.concatenate([emit[some], move, start[None], np.full((1, k), total)])
        nth = np.concatenate([some, classes + np.arange(k + 2)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nth), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(k))], schema=schema
        )

    return run


def train(blocks: DataFrame, kinds: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts of ``blocks`` that are not held out."""
    model, classes = Model.first(kinds, states), len(kinds)
    share = (kinds + ALPHA) / (kinds + ALPHA).sum()
    ddl = "nth int" + "".join(f", v{i} double" for i in range(states))
    for _ in range(rounds):
        sums = (
            blocks.select("tokens", "sizes", "held", "kinds").mapInArrow(_expected_rows(model), ddl)
            .groupBy("nth").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(states)])
        )
        found = sums.toArrow()  # one row per class and state: a fixed number
        table = np.zeros((classes + states + 2, states))
        table[found["nth"].to_numpy()] = np.stack([found[f"v{i}"].to_numpy() for i in range(states)], 1)
        model = Model.from_counts(
            table[classes + states], table[classes : classes + states], table[:classes].T, share
        )
    return model


_SCORES = pa.schema(
    [
        ("_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def _score(model: Model, n: int, v: int, kind_n: np.ndarray, kind_v: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        count = np.zeros(0, np.int64)
        if right.num_rows:
            nth, c = (
                [unpacked(x, kind) for x in right[name].to_pylist()] for name, kind in (("nths", np.int32), ("cs", np.int64))
            )
            count = np.zeros(sum(map(len, nth)), np.int64)
            count[np.concatenate([np.cumsum(x) for x in nth])] = np.concatenate(c)
        out = []
        for at in range(left.num_rows):
            row = left.slice(at, 1).to_pylist()[0]
            flat, sizes, held, kinds = _unpacked(row)
            base = np.log10((count + ALPHA) / (n + ALPHA * (v + 1)))
            share = np.log10((count + ALPHA) / (kind_n[kinds] + ALPHA * (kind_v[kinds] + 1)))
            firsts = np.cumsum(sizes) - sizes  # every text has its end, so no text is empty
            per_text = lambda values: np.add.reduceat(values[flat], firsts)  # noqa: B023, E731
            score = model.log10(Segments(kinds[flat], sizes), len(sizes)) + per_text(share)
            columns = [
                pa.array(row["ids"], pa.int64()), pa.array(held), pa.array(sizes),
                pa.array(per_text((count > 0).astype(np.int64))), pa.array(np.full(len(sizes), n)),
                pa.array(per_text(base)), pa.array(score),
            ]
            out.append(pa.Table.from_arrays(columns, schema=_SCORES))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    return run


def score_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None,
    states: int = STATES, rounds: int = ROUNDS, classes: int = CLASSES,
) -> DataFrame:
    """One row per input row: the model's log10 probability of its text, and a unigram base.

    Columns: ``_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens
    are the words of the text, lower-cased (A-Z), and one end; null is the empty text,
    which is its end alone. ``held_out`` is a boolean column of ``df`` or an expression
    over it; rows where it is true or null teach nothing. Repeated rows count as often
    as they occur. Without any training text all words are unknown. A very long text is cut
    into segments, which changes no result; further columns of ``df`` are not read.
    """
    bounded_batches(df.sparkSession)
    held = F.lit(False) if held_out is None else held_out
    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
        F.coalesce(held, F.lit(True)).alias("held"),
    )
    spark = df.sparkSession
    path = scratch_path(spark, f"blocks-{uuid.uuid4().hex[:4]}")
    rows.mapInArrow(_block_rows(classes), _BLOCK_DDL).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)

    entries = blocks.select("block", "hashes", "kinds", "counts").mapInArrow(
        _dictionary_rows(), "hash long, block long, nth int, n long, kind int"
    )
    # A common word has an entry in every block, so counts are summed before they are shuffled,
    # and go back to the entries by a join that splits hot words.
    words = materialise(entries.groupBy("hash", "kind").agg(F.sum("n").alias("c")), "words")
    counted = entries.join(words.select("hash", "c"), "hash").select("block", "nth", "c")
    counted = counted.mapInArrow(_returned_rows(), "block long, nths binary, cs binary")
    known = (F.col("c") > 0).cast("long")
    sums = words.groupBy("kind").agg(F.sum("c").alias("n"), F.sum(known).alias("v")).toArrow()
    kind_n, kind_v = np.zeros(classes + 1), np.zeros(classes + 1)
    at = sums["kind"].to_numpy()
    kind_n[at], kind_v[at] = sums["n"].to_numpy(), sums["v"].to_numpy()
    n, v = int(kind_n.sum()), int(kind_v.sum())

    model = train(blocks, kind_n, states, rounds)
    score = _score(model, n, v, kind_n, kind_v)
    return (
        blocks.select("block", "ids", "held", "sizes", "tokens", "kinds").groupBy("block")
        .cogroup(counted.groupBy("block"))
        .applyInArrow(
            score,
            "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
    )
