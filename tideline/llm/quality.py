"""Quality rules: counts of words, lines and symbols, and n-gram perplexity bands.

The language model is a modified Kneser-Ney model over the characters of a language,
up to four at a time. Every task counts the n-grams of its texts; Spark adds them up,
derives continuation counts, discounts and back-off weights, and interpolates the
orders. Every text that is scored has been counted, so the probabilities of the n-grams
of four characters are all that scoring needs. They are kept under the whole n-gram, in
sorted arrays for each language. At most 2**GRAM_BITS of them are sent out at once; if
there are more, they are split by hash, and the texts are read once for each part.

A text is rejected if its perplexity lies outside the band of its language. The band is
set by the quartiles of the different texts of the language, so it follows the corpus, and
is wider for short texts, whose perplexity varies more. Copies count once, for the model too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SPACE, as_bytes, bounded_batches, by_size, key_filter, with_filter, with_more
from tideline.scratch import materialise

ORDER = 4
#: At most 2**GRAM_BITS n-grams are in one broadcast.
GRAM_BITS = 22
#: The band reaches so many quartile ranges beyond the quartiles of log perplexity.
WIDTH = 3.0
#: A short text varies more: its band is wider by sqrt(1 + SHORT / characters).
SHORT = 500
WINDOW = 8
#: Bands of so many languages are sent to all tasks; more are joined.
BROADCAST_LANGUAGES = 100_000
_START = 1  # the character before a text, a control character
_PART = 1 << 20
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_RNG = np.random.default_rng(8)
_WEIGHTS = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.int64).view(np.uint64) | np.uint64(1)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words)) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h += ids[j : j + n] * _WEIGHTS[j % len(_WEIGHTS)]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, duplicate lines, words in repeated windows)."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _CONTINUATION + SPACE)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def characters(text: bytes) -> np.ndarray:
    """Characters as numbers of 16 bits, those beyond folded."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return (points ^ (points >> np.uint32(16))).astype(np.uint16)


def grams(texts: list[bytes]) -> np.ndarray:
    """Keys of the four characters that end at each character of the texts."""
    if not texts:
        return np.zeros(0, np.uint64)
    lead = np.full(ORDER - 1, _START, np.uint16)
    parts = [characters(t) for t in texts]
    line = np.concatenate([x for p in parts for x in (lead, p)]).astype(np.uint64)
    key = line.copy()
    for back in range(1, ORDER):
        key[back:] |= line[:-back] << np.uint64(16 * back)
    keep = np.concatenate([x for p in parts for x in (np.zeros(ORDER - 1, bool), np.ones(len(p), bool))])
    return key[keep]


def _merged(held: list) -> list:
    keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return [(keys, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64))]


def _gram_rows():
    """(lang, key, count) of the texts of a partition."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("c", pa.int64())])

    def run(batches):
        held: dict[str, list] = {}

        def out():
            for lang, parts in held.items():
                ((keys, n),) = _merged(parts)
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(k)), pa.array(k), pa.array(n[at : at + (1 << 16)])],
                        schema=schema,
                    )
            held.clear()

        for b in batches:
            langs = b.column("_lang").to_pylist()
            rows = sorted(zip(langs, as_bytes(b.column("_text"))), key=lambda r: r[0])
            for part in by_size(rows, lambda r: len(r[1]), _PART):
                for lang in dict.fromkeys(r[0] for r in part):
                    keys, n = np.unique(grams([t for x, t in part if x == lang]), return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((keys, n))
                    if len(parts) > 8:
                        held[lang] = _merged(parts)
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2_000_000:
                yield from out()
        yield from out()

    return run


def _bits(order: int) -> int:
    return (1 << 16 * order) - 1 if order < 4 else -1


def kneser_ney(raw: DataFrame) -> DataFrame:
    """(lang, key, p) of a modified Kneser-Ney model over (lang, key, c).

    ``p`` is the interpolated probability of the last character after the ones before
    it. Discounts follow from the numbers of n-grams seen once to four times; a corpus too small to
    have them takes 0.5, 1 and 1.5.
    """
    tables = {ORDER: raw}
    for order in range(ORDER - 1, 0, -1):
        # How many different characters come before: each key of the order above counts one.
        tables[order] = (
            tables[order + 1].select("lang", F.col("key").bitwiseAND(_bits(order)).alias("key"))
            .groupBy("lang", "key").agg(F.count("*").alias("c"))
        )
        tables[order] = materialise(tables[order], f"grams{order}")
    below = None
    for order in range(1, ORDER + 1):
        grams_ = tables[order].withColumn("context", F.shiftrightunsigned("key", 16))
        many = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
        n = grams_.groupBy("lang").agg(*many)
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        found = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
        discounts = n.select(
            "lang",
            *[
                F.when(found, F.greatest(F.lit(0.01), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))
                .otherwise(F.lit(i / 2)).alias(f"d{i}")
                for i in (1, 2, 3)
            ],
        )
        discounts = materialise(discounts, f"discounts{order}")
        if discounts.count() <= BROADCAST_LANGUAGES:
            # A join would bring all n-grams of a language to one task.
            discounts = F.broadcast(discounts)
        grams_ = grams_.join(discounts, "lang")
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams_ = grams_.withColumn("less", F.least(less, F.col("c")))
        contexts = grams_.groupBy("lang", "context").agg(
            F.sum("c").alias("total"), F.sum("less").alias("left"), F.count("*").alias("kinds")
        )
        contexts = materialise(contexts, f"contexts{order}")
        grams_ = grams_.join(contexts, ["lang", "context"])
        gamma = F.col("left") / F.col("total")
        if order == 1:
            lower = 1 / (F.col("kinds") + 1)  # all characters seen, and one unseen
        else:
            grams_ = grams_.withColumn("low", F.col("key").bitwiseAND(_bits(order - 1))).join(
                below.select("lang", F.col("key").alias("low"), F.col("p").alias("p_low")), ["lang", "low"]
            )
            lower = F.col("p_low")
        p = (F.col("c") - F.col("less")) / F.col("total") + gamma * lower
        below = materialise(grams_.select("lang", "key", p.alias("p")), f"model{order}")
    return below


def stored(model: DataFrame) -> dict:
    """Sorted keys and log10 probabilities of each language."""
    t = model.toArrow()
    langs = t["lang"].combine_chunks().dictionary_encode()
    which, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
    key, p = t["key"].to_numpy().view(np.uint64), np.log10(t["p"].to_numpy())
    order = np.lexsort((key, which))
    cuts = np.searchsorted(which[order], np.arange(len(names) + 1))
    return {
        lang: (key[order[a:z]], p[order[a:z]].astype(np.float32))
        for lang, a, z in zip(names, cuts[:-1], cuts[1:])
    }


def look(arrays: dict, key: np.ndarray, lang: str) -> np.ndarray:
    """log10 probability of each n-gram, 0 if it is not in the arrays."""
    if lang not in arrays:
        return np.zeros(len(key), np.float32)
    keys, p = arrays[lang]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, p[at], np.float32(0))


def log_sums(arrays: dict, langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log10 probabilities over the characters of each text, and the characters."""
    total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lang in dict.fromkeys(langs):
        own = [k for k, x in enumerate(langs) if x == lang and texts[k]]
        if own:
            size[own] = n = np.array([len(characters(texts[k])) for k in own])
            p = look(arrays, grams([texts[k] for k in own]), lang)
            total[own] = np.add.reduceat(p, np.cumsum(n) - n, dtype=np.float64)
    return total, size


def _sum_rows(arrays):
    """(_lang, _text1, _text2, total, size) of each text by one part of the model."""
    schema = pa.schema([
        ("_lang", pa.string()), *((c, pa.int64()) for c in ("_text1", "_text2")), ("total", pa.float64()), ("size", pa.int64()),
    ])

    def run(batches):
        for b in batches:
            langs, texts = b.column("_lang").to_pylist(), as_bytes(b.column("_text"))
            for part in by_size(range(len(texts)), lambda k: len(texts[k]), _PART):
                sums = log_sums(arrays.value, [langs[k] for k in part], [texts[k] for k in part])
                some = b.slice(part[0], len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[k] for k in part], pa.string()), some.column("_text1"), some.column("_text2"), *map(pa.array, sums)],
                    schema=schema,
                )

    return run


def _rule_rows(arrays, keep: tuple[str, ...]):
    names = ["_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names.append("n_chars")
    kinds = [pa.int64(), pa.string()] + [pa.int64()] * 6
    schema = pa.schema([*zip(names, kinds), ("log_perplexity", pa.float64())])

    def run(batches):
        for b in batches:
            ids, langs = b.column("_id").to_pylist(), b.column("_lang").to_pylist()
            texts = as_bytes(b.column("_text"))
            for part in by_size(range(len(ids)), lambda k: len(texts[k]), _PART):
                rows = [
                    (ids[k], langs[k], *counts(texts[k]), len(texts[k].translate(None, _CONTINUATION)))
                    for k in part
                ]
                log = np.full(len(part), np.nan)
                if arrays is not None:
                    total, size = log_sums(arrays.value, [langs[k] for k in part], [texts[k] for k in part])
                    np.divide(-total, size, out=log, where=size > 0)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                out = pa.RecordBatch.from_arrays([*columns, pa.array(log, from_pandas=True)], schema=schema)
                yield with_more(out, b.slice(part[0], len(part)), keep)

    return run


def _different(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` once for each text of a language; texts that occur once are not shuffled."""
    key = ["_lang", "_text1", "_text2"]
    copied = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    filtered = with_filter(rows.select(*key, "_text"), materialise(key_filter(copied, *key), "filter"), *key)
    once = filtered.where("_maybe").groupBy(*key).agg(F.first("_text").alias("_text"))
    return filtered.where("not _maybe").select(*columns).union(once.select(*columns))


def _logs(rows: DataFrame, model: DataFrame, parts: int) -> DataFrame:
    """(_lang, _text1, _text2, log_perplexity) of each text, by one part of the model after another."""
    different, sums = _different(rows, "_lang", "_text1", "_text2", "_text"), None
    for part in range(parts):
        own = model.where(F.pmod(F.xxhash64("lang", "key"), F.lit(parts)) == part)
        arrays = rows.sparkSession.sparkContext.broadcast(stored(own))
        kinds = "_lang string, _text1 long, _text2 long, total double, size long"
        one = materialise(different.mapInArrow(_sum_rows(arrays), kinds), "sums")
        arrays.unpersist()
        sums = one if sums is None else sums.union(one)
    totals = sums.groupBy("_lang", "_text1", "_text2").agg(F.sum("total").alias("total"), F.max("size").alias("size"))
    log = F.when(F.col("size") > 0, -F.col("total") / F.col("size"))
    return totals.select("_lang", "_text1", "_text2", log.alias("log_perplexity"))


def quality(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
    width: float = WIDTH, bits: int = GRAM_BITS, keep: tuple[str, ...] = (),
    with_text: bool = False,
) -> DataFrame:
    """One row per input row with counts, perplexity, and whether the text is kept.

    Columns: ``_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_perplexity`` (log10 for each character, null for an empty text),
    ``lower, upper`` (the band of the language), ``kept``, ``keep`` as ``_<name>`` and, with ``with_text``, ``_text``. Null texts are empty and
    fail; a null language is a language of its own, as is every text if there is no
    language column. The bands come from texts that pass the base rules, so a language
    without any keeps none. Equal texts of a language count once, for the model and the bands.
    """
    bounded_batches(df.sparkSession)
    lang = F.lit("") if lang_col is None else F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
        lang.alias("_lang"), *[F.col(f"`{c}`").alias(f"_{c}_") for c in keep],
    )
    # Named so that they cannot clash with the language.
    passed = ("text1", "text2") + ("text",) * with_text + tuple(f"{c}_" for c in keep)
    rows = rows.withColumns({"_text1": F.xxhash64("_text"), "_text2": F.xxhash64(F.lit("second"), "_text")})
    raw = _different(rows, "_lang", "_text").mapInArrow(_gram_rows(), "lang string, key long, c long")
    raw = materialise(raw.groupBy("lang", "key").agg(F.sum("c").alias("c")), "grams")
    model = kneser_ney(raw)
    parts = -(-model.count() // (1 << bits))
    spark = df.sparkSession.sparkContext
    arrays = spark.broadcast(stored(model)) if parts <= 1 else None
    scored = rows.mapInArrow(
        _rule_rows(arrays, passed),
        "_id long, _lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_chars long, log_perplexity double, _text1 long, _text2 long"
        + ", _text string" * with_text
        + "".join(f", `_{c}_` {df.schema[c].dataType.simpleString()}" for c in keep),
    ).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    if parts > 1:
        scored = scored.drop("log_perplexity").join(_logs(rows, model, parts), ["_lang", "_text1", "_text2"], "left")
    scored = materialise(scored, "scored")
    quartile = [F.percentile_approx("log_perplexity", q, 10_000).alias(f"q{q}") for q in (0.25, 0.75)]
    different = scored.where("not base_failed").groupBy("_lang", "_text1", "_text2")
    bands = different.agg(F.min("log_perplexity").alias("log_perplexity")).groupBy("_lang").agg(*quartile)
    spread = width * F.greatest(F.col("`q0.75`") - F.col("`q0.25`"), F.lit(0.01))
    bands = bands.select(
        "_lang", F.col("`q0.25`").alias("low"), F.col("`q0.75`").alias("high"), spread.alias("spread")
    )
    bands = materialise(bands, "bands")
    if bands.count() <= BROADCAST_LANGUAGES:
        # A join would bring all texts of a language to one task.
        bands = F.broadcast(bands)
    wider = F.col("spread") * F.sqrt(1 + SHORT / F.greatest(F.col("n_chars"), F.lit(1)))
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return (
        scored.join(bands, "_lang", "left")
        .withColumns({"lower": F.col("low") - wider, "upper": F.col("high") + wider})
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .drop("_lang", "_text1", "_text2", "n_chars", "low", "high", "spread")
        .withColumnsRenamed({f"_{c}_": f"_{c}" for c in keep})
    )
