"""The trie of conversation prefixes, from sorted neighbours and union-find.

Conversations become sequences of turn digests and are sorted. Neighbours share a longest
common prefix (LCP). Going through these LCPs in descending depth, union-find joins the
neighbours' components, and every join makes a branching node; between two joins a
component climbs, which makes the nodes with one child.

Sorted sequences are range-partitioned, with the identifier last, so that copies of one
conversation spread too. A partition is worked on in blocks of bounded size. A block knows
all about its nodes, except of those that are prefixes of its first or its last sequence
and may go on in a neighbour. So it contracts its forest to these two *strands*, with
the sums of what hangs off them at each depth. Strands are sequences again, and are merged
by the same step, block by block, until few are left for one task.

A sequence longer than ``band`` is cut into bands, each with a hash of all before it as its
root. Bands whose root several conversations share are solved from the deepest up, and pass
the sums of a root on to the node where the band above ends; a band that one conversation
has for itself is a plain path.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import bounded_batches
from tideline.scratch import materialise

#: Turns of a band: what one row holds at most.
BAND = 256
#: Turns of a block, and bytes of strands that one task merges to the end.
BLOCK, LAST = 1 << 17, 8 << 20
_DIGEST = 16
_NO_ID = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()

_NODE, _STRAND, _ENDS, _BELOW = range(4)
_KINDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
_OUT = pa.schema(
    [
        ("kind", pa.int32()), ("conv", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()),
        ("over", pa.binary()), ("name", pa.binary()), ("n", pa.int64()), ("children", pa.int64()),
        ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("seq", pa.int64()),
        ("root", pa.binary()), ("key", pa.binary()), ("sizes", pa.binary()), ("nxt", pa.binary()),
        ("events", pa.binary()),
    ]
)
_OUT_DDL = ", ".join(f"`{f.name}` {_KINDS[f.type]}" for f in _OUT)


class Strand:
    """A sequence with what hangs off it: events ``[depth, n, conv, children, leaves, saved, ids]``.

    Its deepest event is at its full length. ``nxt`` is the root of the band that follows a
    full one.
    """

    __slots__ = ("root", "key", "sizes", "nxt", "events", "length", "_names")

    def __init__(self, root: bytes, key: bytes, sizes: bytes, nxt: bytes, events: list):
        self.root, self.key, self.nxt, self.events = root, key, nxt, events
        self.sizes, self.length, self._names = sizes, len(key) // _DIGEST, None

    def name(self, depth: int, band: int) -> bytes:
        """Name of the node at a depth; the end of a full band is the root of the next."""
        if depth == 0:
            return hashlib.md5(b"r" + self.root).digest()
        if depth == band:
            return hashlib.md5(b"r" + self.nxt).digest()
        if self._names is None:
            h, self._names = hashlib.md5(b"n" + self.root), []
            for at in range(0, len(self.key), _DIGEST):
                h.update(self.key[at : at + _DIGEST])
                self._names.append(h.digest())
        return self._names[depth - 1]

    def size(self, depth: int) -> int:
        return int.from_bytes(self.sizes[8 * depth - 8 : 8 * depth], "little")


def lcp(a: Strand, b: Strand) -> int:
    """Turns that two sequences share from their start, -1 if their roots differ."""
    if a.root != b.root:
        return -1
    n = min(len(a.key), len(b.key))
    if a.key[:n] == b.key[:n]:
        return n // _DIGEST
    differ = np.frombuffer(a.key, np.uint8, n) != np.frombuffer(b.key, np.uint8, n)
    return int(np.argmax(differ)) // _DIGEST


class _Part:
    """A component: its topmost node, not finished yet, and the sums of what is below it."""

    __slots__ = ("at", "n", "conv", "children", "leaves", "saved", "ids", "kids", "strand", "spine")

    def __init__(self, at: int, strand: Strand, spine: int | None):
        self.at, self.strand, self.spine = at, strand, spine
        self.clear()

    def clear(self) -> None:
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ids, self.kids = _NO_ID, [], []

    def add(self, n, conv, children, leaves, saved, ids) -> None:
        self.n += n
        self.conv = min(self.conv, conv)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if ids:
            self.ids = self.ids + ids


class Block:
    """Nodes of a run of sorted strands, and the strands it is contracted to.

    ``open_ends`` tells that neighbours may continue the first and the last strand. ``lookup``
    names all nodes and leaves the members that end at them to the rows of ``_ENDS``.
    """

    def __init__(self, strands: list[Strand], band: int, offset: int, open_ends: bool, lookup: bool):
        self.strands, self.band, self.offset = strands, band, offset
        self.open_ends, self.lookup = open_ends, lookup
        self.nodes: list[list] = []
        self.ends: list[tuple] = []
        self.below: list[tuple] = []
        self.spines: list[list] = [[], []]
        self._solve()

    def contracted(self) -> list[Strand]:
        first, last = self.strands[0], self.strands[-1]
        both = ((first, self.spines[0]), (last, self.spines[1]))
        return [Strand(s.root, s.key, s.sizes, s.nxt, events) for s, events in both if events]

    def _solve(self) -> None:
        strands, last = self.strands, len(self.strands) - 1
        up, parts = list(range(len(strands))), [None] * len(strands)

        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        work = [(e[0], 1, i, e) for i, s in enumerate(strands) for e in s.events]
        for i in range(1, len(strands)):
            depth = lcp(strands[i - 1], strands[i])
            if depth >= 0:
                work.append((depth, 0, i, None))
        work.sort(key=lambda w: (-w[0], -w[1], w[2]))
        for depth, event, i, e in work:
            b = top(i)
            if event:
                if parts[b] is None:
                    spine = None
                    if self.open_ends and i in (0, last):
                        spine = 0 if i == 0 else 1
                    parts[b] = _Part(depth, strands[i], spine)
                self._climb(parts[b], depth)
                parts[b].add(*e[1:])
                continue
            a = top(i - 1)
            x, y = parts[a], parts[b]
            self._climb(x, depth)
            self._climb(y, depth)
            x.add(y.n, y.conv, y.children, y.leaves, y.saved, y.ids)
            x.kids = x.kids + y.kids if len(x.kids) >= len(y.kids) else y.kids + x.kids
            if y.spine is not None:
                x.spine = y.spine if x.spine is None else min(x.spine, y.spine)
            up[b], parts[b] = a, None
        for part in parts:
            if part is not None:
                self._climb(part, 0)
                self._finish_root(part)

    def _climb(self, part: _Part, depth: int) -> None:
        """Finish the nodes of a component above ``depth``, so that its top is there."""
        while part.at > depth:
            if part.spine is not None:
                self._hang(part)
                part.at = depth
                return
            node = self._node(part)
            part.at -= 1
            part.children, part.ids, part.kids = 1, [], [node]
            part.leaves, part.saved = node[7], node[8]

    def _node(self, part: _Part) -> list:
        depth, own = part.at, 0
        if depth:
            own = (part.n - 1) * part.strand.size(depth)
        named = self.lookup or depth in (0, self.band)
        ends = None
        if not self.lookup:
            ids = ",".join(map(str, part.ids)).encode()
            ends = hashlib.sha256(ids).hexdigest() if ids else _EMPTY
        node = [
            part.conv, self.offset + depth, None, None, part.strand.name(depth, self.band) if named else None,
            part.n, part.children, part.leaves + (part.children == 0), part.saved + own, ends,
        ]
        for kid in part.kids:
            kid[2] = part.conv
        self.nodes.append(node)
        return node

    def _hang(self, part: _Part) -> None:
        """Leave a node that neighbours may share to its strand, with what is known of it."""
        if part.n or part.children:
            strand = self.strands[0 if part.spine == 0 else -1]
            name = strand.name(part.at, self.band)
            self.spines[part.spine].append([part.at, part.n, part.conv, part.children, part.leaves, part.saved, []])
            for kid in part.kids:
                kid[3] = name
            if part.ids:
                self.ends.append((name, part.ids[0], ",".join(map(str, part.ids))))
        part.clear()

    def _finish_root(self, part: _Part) -> None:
        if part.spine is not None:
            self._hang(part)
        elif self.offset == 0:
            self._node(part)
        else:
            # The node itself is the last one of the band above; only the sums go there.
            name = part.strand.name(0, self.band)
            for kid in part.kids:
                kid[3] = name
            self.below.append((part.strand.root, part.children, part.leaves, part.saved, part.conv))


def _table(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in _OUT]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _node_table(nodes: list[list]) -> pa.RecordBatch:
    names = ("conv", "depth", "parent", "over", "name", "n", "children", "leaves", "saved", "ends")
    held = dict(zip(names, zip(*nodes))) | {"kind": [_NODE] * len(nodes)}
    columns = [
        pa.array(held[f.name], f.type) if f.name in held else pa.nulls(len(nodes), f.type) for f in _OUT
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _results(block: Block, seq: int):
    for at in range(0, len(block.nodes), 1 << 14):
        yield _node_table(block.nodes[at : at + (1 << 14)])
    rows = [
        {
            "kind": _STRAND, "seq": seq + i, "root": s.root, "key": s.key, "sizes": s.sizes, "nxt": s.nxt,
            "events": np.array([e[:6] for e in s.events], np.int64).tobytes(),
        }
        for i, s in enumerate(block.contracted())
    ]
    rows += [{"kind": _ENDS, "name": name, "conv": first, "ends": ids} for name, first, ids in block.ends]
    rows += [
        {"kind": _BELOW, "root": root, "children": c, "leaves": x, "saved": s, "conv": conv}
        for root, c, x, s, conv in block.below
    ]
    if rows:
        yield _table(rows)


def _block_rows(strands_of, band: int, offset: int, open_ends: bool, lookup: bool, block: int):
    """Solve the sorted strands of a partition, in blocks of about ``block`` turns."""

    def run(batches):
        seq, held, weight = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, [], 0
        for b in batches:
            for strand in strands_of(b):
                held.append(strand)
                weight += strand.length + 1
                if open_ends and weight >= block and len(held) >= 8:
                    yield from _results(Block(held, band, offset, open_ends, lookup), seq)
                    seq, held, weight = seq + 2, [], 0
        if held:
            yield from _results(Block(held, band, offset, open_ends, lookup), seq)

    return run


def _sequences(b: pa.RecordBatch):
    """A strand for each conversation of a band."""
    names = ("_id", "root", "key", "sizes", "nxt", "more", "children", "leaves", "saved")
    for i, root, key, sizes, nxt, more, children, leaves, saved in zip(*(b.column(c).to_pylist() for c in names)):
        event = [len(key) // _DIGEST, 1, i, children or 0, leaves or 0, saved or 0, [] if more else [i]]
        yield Strand(root, key, sizes, nxt, [event])


def _strands(b: pa.RecordBatch):
    for root, key, sizes, nxt, events in zip(*(b.column(c).to_pylist() for c in ("root", "key", "sizes", "nxt", "events"))):
        rows = np.frombuffer(events, np.int64).reshape(-1, 6).tolist()
        yield Strand(root, key, sizes, nxt, [[*e, []] for e in rows])


def _key_rows():
    """(_id, band, key, sizes) from lists of digests and sizes."""
    schema = pa.schema([("_id", pa.int64()), ("band", pa.int64()), ("key", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        for b in batches:
            keys = [b"".join(d) for d in b.column("digests").to_pylist()]
            sizes = [np.array(s, np.int64).tobytes() for s in b.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("band"), pa.array(keys, pa.binary()), pa.array(sizes, pa.binary())], schema=schema)

    return run


def _lonely_rows(band: int):
    """Nodes of bands that one conversation has for itself."""

    def run(batches):
        for b in batches:
            nodes = []
            names = ("_id", "band", "root", "key", "nxt", "more")
            for i, nth, root, key, nxt, more in zip(*(b.column(c).to_pylist() for c in names)):
                strand = Strand(root, key, b"", nxt, [])
                for d in range(1, strand.length + 1):
                    end = d == strand.length
                    ends = hashlib.sha256(str(i).encode()).hexdigest() if end and not more else _EMPTY
                    nodes.append([
                        i, nth * band + d, None if d == 1 else i, strand.name(0, band) if d == 1 else None,
                        strand.name(d, band) if end and more else None, 1, int(more or not end), 1, 0, ends,
                    ])
            if nodes:
                yield _node_table(nodes)

    return run


def _end_rows():
    """SHA-256 of the identifiers that end at each node, from chunks sorted by node and identifier."""
    schema = pa.schema([("name", pa.binary()), ("sha", pa.string())])

    def run(batches):
        name = digest = None
        for b in batches:
            done = []
            for own, ids in zip(b.column("name").to_pylist(), b.column("ends").to_pylist()):
                if own != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], schema=schema)

    return run


def _hex16(column: str):
    return F.lpad(F.hex(column), 16, "0")


def sequences(turns: DataFrame, ids: DataFrame, band: int) -> DataFrame:
    """Bands of all sequences: ``_id, band, root, key, sizes, nxt, more``.

    ``turns`` has ``_id, at`` (0, 1, 2 ...), ``digest`` and ``bytes``; ``ids`` has ``_id``, and may
    name sequences without a turn.
    """
    turn = F.sort_array(F.collect_list(F.struct("at", "digest", "bytes")))
    lists = turns.groupBy("_id", F.floor(F.col("at") / band).alias("band")).agg(turn.alias("turns"))
    lists = lists.select("_id", "band", F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("bytes"))
    keys = lists.mapInArrow(_key_rows(), "_id long, band long, key binary, sizes binary")
    none = ids.select("_id").distinct().join(turns.select("_id").distinct(), "_id", "left_anti")
    none = none.select("_id", F.lit(0).cast("long"), F.lit(b""), F.lit(b""))
    keys = materialise(keys.union(none).toDF("_id", "band", "key", "sizes"), "keys")

    # Roots: a row for each band of a conversation; most have one.
    hashed = keys.withColumns({"h1": F.xxhash64("band", "key"), "h2": F.xxhash64(F.lit("second"), "band", "key")})
    long_ones = materialise(keys.where(F.col("band") > 0).select("_id").distinct(), "long")
    one = hashed.join(long_ones, "_id", "left_anti").select(
        "_id", "band", F.unhex(F.lit("00" * 16)).alias("root"), "key", "sizes",
        F.unhex(F.concat(_hex16("h1"), _hex16("h2"))).alias("nxt"), F.lit(False).alias("more"),
    )
    several = hashed.join(long_ones, "_id", "left_semi")
    up_to = Window.partitionBy("_id").orderBy("band")

    def root(last):
        over = up_to.rowsBetween(Window.unboundedPreceding, last)
        return F.unhex(F.concat(*[_hex16(F.coalesce(F.bit_xor(h).over(over), F.lit(0))) for h in ("h1", "h2")]))

    narrow = several.select("_id", "band", "h1", "h2").select(
        "_id", "band", root(-1).alias("root"), root(0).alias("nxt"), F.lead("band").over(up_to).isNotNull().alias("more")
    )
    several = several.drop("h1", "h2").join(narrow, ["_id", "band"])
    return materialise(one.union(several.select(*one.columns)), "sequences")


def prefix_nodes(turns: DataFrame, ids: DataFrame, band: int = BAND, block: int = BLOCK, last: int = LAST) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    ``turns`` has ``_id`` (long, not null), ``at`` (its place, 0, 1, 2 ...), ``digest`` (16 bytes)
    and ``bytes``; ``ids`` names all sequences, also those without a turn, which are members
    of the root alone. ``conv_id`` is a node's smallest member; ``saved_tokens`` sums ``(n_convs -
    1) * bytes`` of the last turn over the subtree. No sequence gives no node.
    """
    bounded_batches(turns.sparkSession)
    items = sequences(turns, ids, band)
    roots = items.where("band > 0").groupBy("band", "root").count().where("count > 1")
    roots = materialise(roots.select("band", "root"), "roots")
    deepest = roots.agg(F.max("band")).first()[0] or 0
    lonely = items.where("band > 0").join(roots, ["band", "root"], "left_anti")
    lonely = materialise(lonely, "lonely")
    found = [materialise(lonely.mapInArrow(_lonely_rows(band), _OUT_DDL), "nodes")]
    passed = ["root", "conv", "children", "leaves", "saved"]
    below = None
    for nth in range(deepest, -1, -1):
        own = items.where(F.col("band") == nth)
        own = own.join(roots.where(F.col("band") == nth), ["band", "root"], "left_semi") if nth else own
        sums = lonely.where(F.col("band") == nth + 1).select(
            "root", F.col("_id").alias("conv"), *[F.lit(v).cast("long").alias(c) for c, v in zip(passed[2:], (1, 1, 0))]
        )
        sums = sums if below is None else sums.union(below)
        sums = sums.withColumnsRenamed({"root": "nxt", "conv": "_id"})
        rows = own.join(sums, ["nxt", "_id"], "left")
        order = ["root", "key", "_id"]
        rows = materialise(rows, "band").repartitionByRange(*order).sortWithinPartitions(*order)
        out = materialise(rows.mapInArrow(_block_rows(_sequences, band, nth * band, True, False, block), _OUT_DDL), "blocks")
        tables = [out]
        while True:
            strands = out.where(F.col("kind") == _STRAND).select("seq", "root", "key", "sizes", "nxt", "events")
            bytes_of = F.octet_length("key") + F.octet_length("sizes") + F.octet_length("events") + 64
            size, held = strands.agg(F.sum(bytes_of), F.count("*")).first()
            # A block merges 8 strands or more to two, so this ends.
            final = held <= 8 or size <= last
            strands = strands.repartition(1) if final else strands.repartitionByRange("seq")
            merged = strands.sortWithinPartitions("seq").mapInArrow(
                _block_rows(_strands, band, nth * band, not final, True, block), _OUT_DDL
            )
            out = materialise(merged, "merged")
            tables.append(out)
            if final:
                break
        found += tables
        below = tables[0]
        for more in tables[1:]:
            below = below.union(more)
        below = below.where(F.col("kind") == _BELOW).select(*passed)
    return _resolved(found)


def _resolved(tables: list[DataFrame]) -> DataFrame:
    """Nodes with their parents, and the members that end at nodes which several blocks share."""
    every = tables[0]
    for more in tables[1:]:
        every = every.union(more)
    nodes = every.where(F.col("kind") == _NODE)
    chunks = every.where(F.col("kind") == _ENDS).select("name", "conv", "ends")
    # The digest of a list is sequential; a chunk has up to a block of identifiers.
    ends = chunks.repartition("name").sortWithinPartitions("name", "conv").mapInArrow(_end_rows(), "name binary, sha string")
    named = nodes.where("name is not null").join(materialise(ends, "ends"), "name", "left")
    named = materialise(named.withColumn("ends", F.coalesce("ends", "sha", F.lit(_EMPTY))).drop("sha"), "named")
    every = nodes.where("name is null").unionByName(named)
    parents = named.select(F.col("name").alias("over"), F.col("conv").alias("found"))
    joined = every.where("over is not null").join(parents, "over", "left").withColumn("parent", F.col("found")).drop("found")
    every = every.where("over is null").unionByName(joined.select(*every.columns))
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def numbered(df: DataFrame, id_col: str, order_col: str, item_cols: tuple[str, ...], size_col: str) -> DataFrame:
    """(_id, at, digest, bytes) of every row with an identifier, ``at`` by ``order_col`` within it.

    Null items are empty texts; ties are ordered by a digest of the items. Rows without an identifier
    take no part. Identifiers are integers.
    """
    from tideline.plans.arrival import arrival_index

    items = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in item_cols]
    # Each item with its length before it, so that no two lists of items look alike.
    joined = F.concat(*[x for i in items for x in (F.octet_length(i).cast("string"), F.lit(":"), i)])
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{order_col}`").alias("turn"),
        F.unhex(F.md5(joined)).alias("digest"),
        F.octet_length(F.coalesce(F.col(f"`{size_col}`").cast("string"), F.lit(""))).cast("long").alias("bytes"),
    )
    indexed = arrival_index(rows, ["turn", "digest"], "_id", name="at").rows
    return indexed.select("_id", "at", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation c starts with up to h turns of conversation c - c % 5.

    h is ``crc32(c) % 9``; the conversation's own turns after its first h follow.
    """
    turns = materialise(turns, "turns")
    c = F.col("_id")
    shared = (F.crc32(c.cast("string").cast("binary")) % 9).alias("h")
    counts = turns.groupBy("_id").agg((F.max("at") + 1).alias("own"))
    members = counts.select("_id", (c - c % 5).alias("base"), shared)
    bases = counts.select(F.col("_id").alias("base"), F.col("own").alias("given"))
    members = members.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0))))
    members = materialise(members, "members")
    lent = turns.where(F.col("at") < 8).withColumnRenamed("_id", "base").join(
        members.select("_id", "base", "h"), "base"
    ).where(F.col("at") < F.col("h"))
    own = turns.join(members.select("_id", "h", "given"), "_id").where(F.col("at") >= F.col("h"))
    own = own.withColumn("at", F.col("at") - F.col("h") + F.col("given"))
    columns = ["_id", "at", "digest", "bytes"]
    return materialise(lent.select(*columns).union(own.select(*columns)), "rebuilt"), members.select("_id")
