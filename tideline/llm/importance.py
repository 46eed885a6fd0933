"""Quality classification by importance resampling.

Two generative models over hashed words and word pairs, one of a target set and one of
all texts, give each text the logarithm of its importance weight. Gumbel noise is added
and the k largest sums are taken, which samples k texts without replacement in
proportion to their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, bounded_batches
from tideline.scratch import materialise

BUCKETS = 1 << 16
#: Rows of the target set that the target model learns from, at most.
TARGETS = 20_000
SHARE = 0.85
ALPHA = 0.5
SEED = 6


class Features:
    """Buckets of the words and word pairs of texts; hashes of words are remembered."""

    def __init__(self, most: int = 400_000):
        self.memory, self.most = {}, most

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        memory = self.memory
        if len(memory) > self.most:
            memory.clear()
        for w in [w for w in set(words) if w not in memory]:
            memory[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        pairs ^= pairs >> np.uint64(29)
        pairs *= np.uint64(0xBF58476D1CE4E5B9)
        return np.concatenate([h >> np.uint64(48), pairs >> np.uint64(48)]).astype(np.int64)


def _count_rows():
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches):
        features = Features()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, wanted in zip(as_bytes(b.column("_text")), b.column("_wanted").to_pylist()):
                found = np.bincount(features(text), minlength=BUCKETS) if len(text) > 1 << 16 else None
                if found is None:
                    at = features(text)
                    np.add.at(raw, at, 1)
                    if wanted:
                        np.add.at(target, at, 1)
                else:
                    raw += found
                    target += found * bool(wanted)
        some = np.flatnonzero(raw).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(raw[some]), pa.array(target[some])], schema=schema
        )

    return run


def _weight_rows(ratio: np.ndarray, seed: int):
    schema = pa.schema(
        [("_id", pa.int64()), ("log_ratio", pa.float64()), ("key", pa.float64()), ("place", pa.int64())]
    )

    def run(batches):
        features = Features()
        for b in batches:
            texts, ids = as_bytes(b.column("_text")), b.column("_id")
            log = np.array([ratio[features(t)].sum() for t in texts], np.float64)
            named = [xxhash.xxh3_64_intdigest(str(i), seed=seed) for i in ids.to_pylist()]
            u = ((np.array(named, np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            key = log - np.log(-np.log(u))
            place = (key + 0.0).view(np.int64)
            place = np.where(place < 0, place ^ np.int64((1 << 63) - 1), place)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(log), pa.array(key), pa.array(place)], schema=schema
            )

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a column of longs, by counting 16 bits at a time.

    Each pass sends at most 65,536 counts to the driver. None if k is less than 1; the
    smallest value if there are fewer than k rows.
    """
    if k < 1:
        return None
    raised = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # order of unsigned numbers
    rows, prefix = df.select(raised.alias("u")), 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(0xFFFF)
        here = rows if shift == 48 else rows.where(F.shiftrightunsigned("u", shift + 16) == prefix)
        found = here.groupBy(digit.alias("digit")).count().toArrow()
        digits, n = found["digit"].to_numpy(), found["count"].to_numpy()
        if len(digits) == 0:
            return None
        order = np.argsort(-digits)
        total = np.cumsum(n[order])
        at = min(int(np.searchsorted(total, k)), len(order) - 1)
        k -= int(total[at - 1]) if at else 0
        prefix = prefix << 16 | int(digits[order[at]])
    return prefix - (1 << 63)


def resample(
    df: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    share: float = SHARE, targets: int = TARGETS, seed: int = SEED,
) -> DataFrame:
    """One row per input row: ``_id, log_ratio, key, kept``.

    ``wanted`` names the target texts in ``id_col``; the target model learns from
    ``targets`` of them at most, those with the smallest hashes. The rows with the
    largest keys are kept, ``share`` of all rows, and all that tie with the last of
    them. Null texts are empty and have weight one; the noise of a row follows from its
    identifier, so repeated rows tie. An empty target leaves a model without data,
    which prefers no text.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")
    )
    chosen = (
        wanted.select(F.col(f"`{id_col}`").alias("_id")).where("_id is not null").distinct()
        .orderBy(F.xxhash64("_id"), "_id").limit(targets)
    )
    chosen = materialise(chosen.withColumn("_wanted", F.lit(True)), "target")
    counted = (
        rows.join(F.broadcast(chosen), "_id", "left").select("_text", "_wanted")
        .mapInArrow(_count_rows(), "bucket int, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counted["bucket"].to_numpy()
    raw[at], target[at] = counted["raw"].to_numpy(), counted["target"].to_numpy()
    if target.sum() == 0:
        ratio = np.zeros(BUCKETS)
    else:
        ratio = np.log((target + ALPHA) / (target + ALPHA).sum()) - np.log((raw + ALPHA) / (raw + ALPHA).sum())
    weighed = rows.mapInArrow(
        _weight_rows(ratio, seed), "_id long, log_ratio double, key double, place long"
    )
    weighed = materialise(weighed, "weights")
    last = kth_largest(weighed, "place", int(np.ceil(share * weighed.count())))
    kept = F.lit(False) if last is None else F.col("place") >= last
    return weighed.select("_id", "log_ratio", "key", kept.alias("kept"))
