"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits meet at a value that is within r/2
bits of both. So each fingerprint emits all values within half the radius, the
values are shuffled, and fingerprints that meet are verified.

The ball of a whole 64-bit fingerprint with radius 2 has 2,081 values. Fingerprints
are therefore cut into blocks of 32 bits first: at 4 bits of difference one of two
blocks differs by at most 2, and its ball of radius 1 has 33 values. Whoever meets
in such a block is compared in full. If so many meet at one value that comparing
them would grow with the square, they are sent on instead to the ball of the whole
fingerprint, where all that meet are linked by construction, as a star.

Equal fingerprints are one node. Links are never expanded into all pairs of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, batch, ddl, id_type, texts, with_more
from tideline.llm.components import components
from tideline.scratch import materialise

SEED = 42
BLOCK = 32
#: More fingerprints than this at one value of a block go on to the whole ball.
COMPARED = 256


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words of a lower-cased text; of all words if fewer."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    span = min(words, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(parts) - span].tolist(), ends[span:].tolist())
    return np.fromiter((digest(joined[a:z], SEED) for a, z in pairs), np.uint64)


def simhash(hashes: np.ndarray) -> np.uint64:
    """64 bits, each 1 if set in over half of the hashes."""
    if len(hashes) == 0:
        return np.uint64(0)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).view(">u8")[0]


def _fingerprint_rows(words: int, keep: tuple[str, ...]):
    def run(batches):
        for b in batches:
            found = [simhash(shingle_hashes(t, words)) for t in as_bytes(b.column("_text"))]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            ids = b.column("_id")
            schema = pa.schema([("_id", ids.type), ("f0", pa.int64())])
            yield with_more(batch(schema, ids, prints), b, keep)

    return run


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(_id, f0) of every row, and ``keep`` as ``_<name>``; texts without a word get zero."""
    kinds = f"_id {id_type(df, id_col)}, f0 long" + ddl(df, keep)
    return texts(df, id_col, text_col, *keep).mapInArrow(_fingerprint_rows(words, keep), kinds)


def ball(bits: int, radius: int) -> np.ndarray:
    """All patterns of ``bits`` bits with at most ``radius`` ones."""
    return np.array(
        [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)],
        np.uint64,
    )


def _block_rows(radius: int):
    """Every value within the radius of both blocks, tagged with the number of the block."""

    def run(batches):
        schema = pa.schema([("meet", pa.int64()), ("node", pa.int64())])
        flips = ball(BLOCK, radius)
        for b in batches:
            prints = b.column("node").to_numpy().view(np.uint64)
            node = np.repeat(prints.view(np.int64), len(flips))
            for block in range(2):
                half = prints >> np.uint64(BLOCK * block) & np.uint64(0xFFFFFFFF)
                meet = (half[:, None] ^ flips[None, :]) | np.uint64(block << BLOCK)
                yield batch(schema, meet.ravel().view(np.int64), node)

    return run


def _ball_rows(radius: int):
    """Every value within the radius of each whole fingerprint."""

    def run(batches):
        schema = pa.schema([("meet", pa.int64()), ("node", pa.int64())])
        flips = ball(64, radius)
        for b in batches:
            prints = b.column("node").to_numpy().view(np.uint64)
            for at in range(0, len(prints), 256):
                part = prints[at : at + 256]
                yield batch(
                    schema, (part[:, None] ^ flips).ravel().view(np.int64),
                    np.repeat(part, len(flips)).view(np.int64),
                )

    return run


def spanning(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between fingerprints at most ``radius`` bits apart that span their groups."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(prints) - 1):
        near = np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius
        for j in (np.flatnonzero(near) + i + 1).tolist():
            x, y = top(i), top(j)
            if x != y:
                root[y] = x
                out.append((prints[i], prints[j]))
    return out


_FOUND = pa.schema([("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _found(kind: int, a, b) -> pa.RecordBatch:
    a, b = (np.asarray(x, np.uint64).view(np.int64) for x in (a, b))
    return batch(_FOUND, np.full(len(a), kind, np.int64), a, b)


def _compared(radius: int, compared: int):
    """Links of the fingerprints of one word that meet, from rows sorted by value.

    Yields links (kind 0) and, for values where too many meet, their members (kind 1).
    At most ``compared`` rows of a value are held.
    """

    def run(batches):
        value, held, large = None, [], False  # rows of the value that is not over yet

        def close(links):
            if held and not large:
                group = np.concatenate(held)
                links.extend(spanning(group, radius) if len(group) > 1 else ())

        for b in batches:
            meet = b.column("meet").to_numpy()
            if len(meet) == 0:
                continue
            prints = b.column("node").to_numpy().view(np.uint64)
            cuts = np.append(np.flatnonzero(np.append(True, meet[1:] != meet[:-1])), len(meet))
            sizes = np.diff(cuts)
            links, many = [], []
            # A value alone in this batch matters only at the edges of the batch.
            inner = np.ones(len(sizes), bool)
            inner[[0, -1]] = False
            two = cuts[:-1][inner & (sizes == 2)]
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
            if len(near):
                yield _found(0, prints[near], prints[near + 1])
            for k in np.flatnonzero(~inner | (sizes > 2)):
                rows = prints[cuts[k] : cuts[k + 1]]
                if meet[cuts[k]] != value:
                    close(links)
                    value, held, large = meet[cuts[k]], [], False
                if not large and sum(map(len, held)) + len(rows) > compared:
                    large = True
                    many.extend(held)
                    held = []
                (many if large else held).append(rows)
            if links:
                yield _found(0, *zip(*links))
            if many:
                rows = np.concatenate(many)
                yield _found(1, rows, rows)
        links = []
        close(links)
        if links:
            yield _found(0, *zip(*links))

    return run


def _by_run(meet: np.ndarray, node: np.ndarray, value, first) -> np.ndarray:
    """The first node at the value of each row; ``first`` is that of a value begun before."""
    new = np.flatnonzero(np.append(meet[0] != value, meet[1:] != meet[:-1]))
    lead = np.full(len(meet), -1)
    lead[new] = new
    lead = np.maximum.accumulate(lead)
    return np.where(lead >= 0, node[lead], node[0] if first is None else first)


def _stars():
    """Pairs of every node with the first one at the same value, from rows sorted by value."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        value = first = None
        for b in batches:
            meet, node = b.column("meet").to_numpy(), b.column("node").to_numpy()
            if len(meet) == 0:
                continue
            heads = _by_run(meet, node, value, first)
            value, first = meet[-1], heads[-1]
            found = np.unique(np.stack([heads, node], 1)[heads != node], axis=0)
            if len(found):
                yield batch(schema, *np.ascontiguousarray(found.T))

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("meet").sortWithinPartitions("meet", "node")


def fingerprint_links(prints: DataFrame, radius: int = 4, compared: int = COMPARED) -> DataFrame:
    """Links (a, b) between fingerprints that span all groups within the radius.

    ``prints`` has ``node``, the fingerprint. No link that joins two groups is missed.
    """
    distinct = materialise(prints.select("node").distinct(), "distinct")
    met = _sorted(distinct.mapInArrow(_block_rows(1), "meet long, node long"))
    found = met.mapInArrow(_compared(radius, compared), "kind long, a long, b long")
    found = materialise(found.distinct(), "meetings")
    crowded = found.where("kind = 1").select(F.col("a").alias("node")).distinct()
    whole = _sorted(crowded.mapInArrow(_ball_rows(radius // 2), "meet long, node long"))
    return found.where("kind = 0").select("a", "b").union(whole.mapInArrow(_stars(), "a long, b long"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
    radius: int = 4, compared: int = COMPARED, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``_id, f0, component_id``, the smallest identifier reachable.

    ``keep`` names columns to pass on, as ``_<name>``; identifiers keep their type.

    Texts are lower-cased (A-Z) and cut into shingles of ``words`` words; null counts
    as empty, and texts without a word share the fingerprint zero. Two fingerprints
    link if they differ in at most ``radius`` of 64 bits. Repeated rows
    and equal texts have one fingerprint; rows without an identifier count for the
    smallest one only if their component has no other.
    """
    if radius not in (0, 2, 4):
        raise ValueError("the radius must be 0, 2 or 4")
    prints = materialise(fingerprints(df, id_col, text_col, words, keep), "prints")
    prints = prints.withColumn("node", F.col("f0"))
    found = components(materialise(fingerprint_links(prints, radius, compared).distinct(), "links"))
    found = materialise(found, "components")
    named = prints.groupBy("node").agg(F.min("_id").alias("_least"))
    roots = named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = roots.groupBy("component").agg(F.min("_least").alias("component_id"))
    roots = roots.join(least, "component").select("node", "component_id")
    return prints.join(roots, "node").drop("node")
