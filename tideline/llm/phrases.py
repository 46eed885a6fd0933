"""Phrase collocations from a weighted de Bruijn graph.

Nodes are grams of ``longest - 1`` words, edges the grams of ``longest`` words that join two
overlapping nodes, weighted by how often they occur. Only edges are counted over the texts. A
node's count is what flows out of it, plus a correction for the pieces that end there;
shorter grams follow from longer ones in the same way:

    f(g) = sum over words x of f(g x) + pieces whose last words are g

Most edges are light: they occur less than ``min_count`` times, and no phrase needs them
one by one. A filter over pairs of words (counted first, by hash) tells which pairs are surely
light; an occurrence is then counted at the longest start of it that may be heavy, so the sum
above stays exact. The filter has a bounded size and decides about work only.

In the graph of heavy edges, a node whose whole flow enters by one edge and leaves by one edge
is interior to a unary path. Paths are compacted by pointer doubling: all edges of a path have
one weight, which is the count of its interior nodes too. These are no phrases of their own,
as the edge around each occurs as often. Counts of other nodes are looked up.

Words are 64-bit hashes, salted by language, until the end; then the words of the phrases are
read from the texts. Two words with one hash would be an error, not a wrong count.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, bounded_batches, per_worker
from tideline.scratch import materialise

SHORTEST, LONGEST, MIN_COUNT, COVER, TOP = 2, 3, 10, 50, 2000
#: Bytes of text that are cut into words at once; a piece without a mark may be longer.
CHUNK = 1 << 20
#: Bits of a filter: 32 for each key, within these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 16, 27
#: Words of phrases that are broadcast, in rows; beyond it they are joined by a shuffle.
BROADCAST_WORDS = 1 << 18
_UPPER = bytes(range(65, 91))
#: Letters A-Z are lowered; marks that end a piece become a line feed, a tab a space.
_PLAIN = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 9 + b" ")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, mixed one to one."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of the base, and of its inverse."""
    def make(size):
        one = np.ones(1, np.uint64)
        return tuple(
            np.concatenate([one, np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_BASE, _INVERSE)
        )

    if n > 2 * CHUNK:
        return make(n)
    return per_worker(("phrase powers", CHUNK), lambda: make(2 * CHUNK))


def cut_words(data: bytes, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, piece, start, end) of the words of a translated text."""
    raw = np.frombuffer(data, np.uint8)
    mark = raw == 10
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~(mark | (raw == 32))
    steps = np.diff(inside)
    start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    powers, inverse = _powers(len(raw) + 1)
    table = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers[: len(raw)], out=sums[1:])
    h = _mixed((sums[end] - sums[start]) * inverse[start] ^ np.uint64(salt))
    h[h == 0] = 1
    return h, np.cumsum(mark)[start], start, end


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, with the low bits cleared: the slots that are counted."""
    mixed = _mixed(h[:-1] * np.uint64(_BASE) ^ h[1:])
    return mixed & np.uint64((1 << 64) - (1 << 24))


def _chunks(batches):
    """(language, salt, translated text) in chunks that end with a piece."""
    for b in batches:
        by_lang = defaultdict(list)
        for lang, text in zip(b.column("_lang").to_pylist(), as_bytes(b.column("_text"))):
            by_lang[lang].append(text)
        for lang, parts in by_lang.items():
            data = b"\n".join(parts).translate(_PLAIN)
            salt, at = xxhash.xxh3_64_intdigest(lang), 0
            while at < len(data):
                end = at + CHUNK
                if end < len(data):
                    cut = data.rfind(b"\n", at, end)
                    cut = data.find(b"\n", end) if cut < 0 else cut
                    end = len(data) if cut < 0 else cut + 1
                yield lang, salt, data[at:end]
                at = end


def _pair_rows():
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, salt, data in _chunks(batches):
            h, piece, *_ = cut_words(data, salt)
            if len(h) > 1:
                slots, n = np.unique(_pairs(h)[piece[1:] == piece[:-1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(n)], schema=schema)

    return run


def _grams(h: np.ndarray, piece: np.ndarray, longest: int, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of a chunk: for each word the longest start of its gram that may be heavy.

    Missing words are 0. ``maybe`` tells for each neighbouring pair whether it may be heavy.
    """
    ids, number = np.unique(h, return_inverse=True)
    number = number.astype(np.int64) + 1
    going = np.append(maybe & (piece[1:] == piece[:-1]), np.zeros(longest, bool))
    code, live = number.copy(), np.ones(len(h), bool)
    base, columns = len(ids) + 1, [number]
    for j in range(1, longest):
        live = live & going[j - 1 : j - 1 + len(h)]
        nth = np.zeros(len(h), np.int64)
        nth[: len(h) - j] = number[j:]
        columns.append(np.where(live, nth, 0))
    at = None
    for column in columns[1:]:
        if int(code.max()) >= (1 << 62) // base:
            _, code = np.unique(code, return_inverse=True)
        code = code * base + column
    _, at, n = np.unique(code, return_index=True, return_counts=True)
    words = np.append(np.uint64(0), ids)
    return np.stack([words[c[at]] for c in columns]), n


def _gram_rows(longest: int, heavy):
    schema = pa.schema([*((f"g{i + 1}", pa.int64()) for i in range(longest)), ("n", pa.int64())])

    def run(batches):
        bits, size = heavy.value
        for _, salt, data in _chunks(batches):
            h, piece, *_ = cut_words(data, salt)
            if len(h):
                grams, n = _grams(h, piece, longest, _in_filter(_pairs(h), bits, size))
                columns = [pa.array(g.view(np.int64)) for g in grams]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], schema=schema)

    return run


def _word_rows(needed):
    """(lang, g, word, n): words that the filter lets pass, and a row with all words of a chunk."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        bits, size = needed.value
        for lang, salt, data in _chunks(batches):
            h, _, start, end = cut_words(data, salt)
            some = np.flatnonzero(_in_filter(h, bits, size))
            ids, first = np.unique(h[some], return_index=True)
            words = [data[start[i] : end[i]].decode() for i in some[first]] + [None]
            g = pa.array(np.append(ids.view(np.int64), 0))
            n = pa.array(np.append(np.zeros(len(ids), np.int64), len(h)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), g, pa.array(words, pa.string()), n], schema=schema)

    return run


def _in_filter(hashes: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - size)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _filter(keys: DataFrame, column: str):
    """A broadcast bit set over the top bits of 64-bit hashes; what it lets pass may be absent."""
    spark = keys.sparkSession
    size = min(max(LEAST_BITS, (32 * keys.count()).bit_length()), MOST_BITS)
    at = F.shiftrightunsigned(column, 64 - size)
    found = (
        keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("nth"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        .toArrow()  # at most 2 ** (MOST_BITS - 6) rows
    )
    words = np.zeros(1 << size - 6, np.uint64)
    words[found["nth"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast((words, size))


def _g(first: int, last: int) -> list[str]:
    return [f"g{i}" for i in range(first, last + 1)]


def compact_paths(edges: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``edges`` with ``path`` (its first edge), ``place`` in it, and ``ends``, true on its last edge.

    ``edges`` has ``g1 ...`` and ``n``, ``nodes`` their flows ``g1 ... f``; both hold the heavy
    ones. An edge goes on with the next one if it is all that enters the node between them,
    and the next one is all that leaves it. Such paths end: a piece must enter them somewhere.
    """
    tail, head = _g(1, longest - 1), _g(2, longest)
    flow = lambda name, to: nodes.select(*[F.col(a).alias(b) for a, b in zip(tail, to)], F.col("f").alias(name))
    full = edges.join(flow("out", tail), tail).join(flow("in", head), head)
    one = F.struct(*_g(1, longest))
    full = materialise(
        full.select(
            one.alias("id"), F.struct(*tail).alias("tail"), F.struct(*[F.col(c).alias(t) for c, t in zip(head, tail)]).alias("head"),
            "n", (F.col("n") == F.col("out")).alias("leaves"), (F.col("n") == F.col("in")).alias("enters"),
        ),
        "edges",
    )
    before = full.where("enters").select(F.col("id").alias("ptr"), F.col("head").alias("tail"))
    links = materialise(full.where("leaves").join(before, "tail").select("id", "ptr"), "links")
    held = links.withColumn("place", F.lit(1).cast("long"))
    while True:
        # Each round doubles how far a pointer looks back; pointers at a first edge are done.
        on = held.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("place").alias("more"))
        held = materialise(
            held.join(on, "ptr", "left").select(
                "id", F.coalesce("far", "ptr").alias("ptr"),
                (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("far").isNotNull().alias("moved"),
            ),
            "pointers",
        )
        if held.where("moved").isEmpty():
            break
        held = held.drop("moved")
    followed = links.select(F.col("ptr").alias("id"), F.lit(False).alias("ends"))
    return (
        full.select("id", "n").join(held.drop("moved"), "id", "left").join(followed, "id", "left")
        .select("id.*", "n", F.coalesce("ptr", "id").alias("path"), F.coalesce("place", F.lit(0)).alias("place"),
                F.coalesce("ends", F.lit(True)).alias("ends"))
    )


def phrase_counts(rows: DataFrame, longest: int, min_count: int) -> tuple[DataFrame, list[DataFrame]]:
    """The compacted graph, and the counts ``f`` of grams of 1, 2 ... ``longest - 1`` words.

    Counts below ``min_count`` are left out, and of the longest of these grams, the nodes,
    those interior to a path, which have the path's weight.
    """
    pairs = rows.mapInArrow(_pair_rows(), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    heavy = materialise(pairs.where(F.col("n") >= min_count).select("slot"), "pairs")
    columns = _g(1, longest)
    grams = rows.mapInArrow(_gram_rows(longest, _filter(heavy, "slot")), ", ".join(f"{c} long" for c in [*columns, "n"]))
    grams = materialise(grams.groupBy(*columns).agg(F.sum("n").alias("n")), "grams")
    edges = materialise(grams.where((F.col(columns[-1]) != 0) & (F.col("n") >= min_count)), "edges")

    counts, longer = [], grams.where(F.col(columns[-1]) != 0)
    for m in range(longest - 1, 0, -1):
        own = grams.where((F.col(f"g{m}") != 0) & (F.col(f"g{m + 1}") == 0))
        both = longer.select(*_g(1, m), "n").union(own.select(*_g(1, m), "n"))
        longer = materialise(both.groupBy(*_g(1, m)).agg(F.sum("n").alias("n")), "flows")
        counts.append(longer.where(F.col("n") >= min_count).withColumnRenamed("n", "f"))
    counts.reverse()
    paths = materialise(compact_paths(edges, counts[-1], longest), "paths")
    interior = paths.where("place > 0").select(*_g(1, longest - 1))
    counts[-1] = materialise(counts[-1].join(interior, _g(1, longest - 1), "left_anti"), "junctions")
    return paths, counts


def phrases(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", shortest: int = SHORTEST,
    longest: int = LONGEST, min_count: int = MIN_COUNT, cover: int = COVER, top: int | None = TOP,
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces
    into words at blanks and tabs. Phrases have ``shortest`` to ``longest`` words and occur
    ``a >= min_count`` times within pieces. ``score`` is ``floor(10**6 a**2 / (l r))`` for the cut
    into two parts (counts ``l`` and ``r``) where it is lowest, the earliest of several. A phrase
    goes if it is part of a longer one that occurs at least ``cover`` percent as often. Ranks
    are by score, count and phrase (UTF-8 order); ``top=None`` returns all. ``n`` is the number of
    words of the language.

    Null texts are empty, a null language is ``und``. Repeated rows count as often as they
    occur. Further columns of ``df`` are not read. A table without phrases has no rows.
    """
    if not 2 <= shortest <= longest or min_count < 1:
        raise ValueError("phrases have two words or more, and min_count is at least 1")
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("_lang"),
    )
    paths, counts = phrase_counts(rows, longest, min_count)
    found = materialise(_scored(paths, counts, shortest, longest, cover), "scored")

    needed = materialise(found.select(F.explode(F.array(*_g(1, longest))).alias("g")).where("g != 0").distinct(), "needed")
    words = rows.mapInArrow(_word_rows(_filter(needed, "g")), "lang string, g long, word string, n long")
    words = words.groupBy("lang", "g", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "words")
    names = words.where("word is not null").join(needed, "g", "left_semi").groupBy("g").agg(
        F.min("lang").alias("lang"), F.min("word").alias("word"),
        F.count("*").alias("same"),
    )
    clash = F.raise_error(F.lit("two words have one hash")).cast("string")
    names = materialise(names.select("g", "lang", F.when(F.col("same") == 1, F.col("word")).otherwise(clash).alias("word")), "names")
    if names.count() <= BROADCAST_WORDS:
        names = F.broadcast(names)
    for m in range(1, longest + 1):
        own = names.select(F.col("g").alias(f"g{m}"), F.col("word").alias(f"w{m}"), *(["lang"] if m == 1 else []))
        found = found.join(own, f"g{m}", "left")
    found = found.select(
        "lang", F.concat_ws(" ", *[f"w{m}" for m in range(1, longest + 1)]).alias("phrase"), "a", "l", "r", "score"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        found = found.where(F.col("rank") <= top)
    totals = words.where("word is null").select("lang", "n")
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(paths: DataFrame, counts: list[DataFrame], shortest: int, longest: int, cover: int) -> DataFrame:
    """(g1 ..., a, l, r, score) of the phrases that no longer one covers; missing words are 0."""
    of = {m + 1: c for m, c in enumerate(counts)}
    edges = paths.withColumnRenamed("n", "a")
    out = []
    for m in range(shortest, longest + 1):
        # Interior nodes are missing here: the edge around each covers it.
        own = edges if m == longest else of[m].withColumnRenamed("f", "a")
        for size in range(m + 1, longest + 1):
            longer = edges.select(*_g(1, longest), "a") if size == longest else of[size].withColumnRenamed("f", "a")
            parts = F.array(*[F.struct(*[F.col(f"g{at + i}").alias(f"g{i}") for i in range(1, m + 1)]) for at in range(size - m + 1)])
            most = longer.select(F.explode(parts).alias("part"), "a").groupBy("part").agg(F.max("a").alias("most"))
            own = own.join(most.select("part.*", "most"), _g(1, m), "left")
            own = own.where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))).drop("most")
        own = _cuts(own, of, m, longest)
        out.append(own.withColumns({f"g{i}": F.lit(0).cast("long") for i in range(m + 1, longest + 1)}))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both.select(*_g(1, longest), "a", "l", "r", "score")


def _cuts(own: DataFrame, of: dict[int, DataFrame], m: int, longest: int) -> DataFrame:
    """Phrases of ``m`` words with the cut of the lowest score."""
    def count(frame, first, last, name):
        """The count of words ``first`` to ``last``; a node inside a path has the weight of the path."""
        part = of[last - first + 1].select(
            *[F.col(f"g{i + 1}").alias(f"g{first + i}") for i in range(last - first + 1)], F.col("f").alias(name)
        )
        frame = frame.join(part, _g(first, last), "left")
        inside = m == longest and last - first + 1 == longest - 1
        return frame.withColumn(name, F.coalesce(name, "a")) if inside else frame

    cuts = []
    for k in range(1, m):
        own = count(count(own, 1, k, f"l{k}"), k + 1, m, f"r{k}")
        a, left, right = (F.col(c).cast("decimal(18,0)") for c in ("a", f"l{k}", f"r{k}"))
        own = own.withColumns({"_over": F.lit(1_000_000).cast("decimal(7,0)") * a * a, "_under": left * right})
        own = own.withColumn(f"score{k}", F.expr("cast(_over div _under as long)")).drop("_over", "_under")
        cuts.append(F.struct(F.col(f"score{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    least = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return own.withColumn("cut", least).select(*_g(1, m), "a", "cut.l", "cut.r", "cut.score")
