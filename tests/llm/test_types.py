"""Identifiers of any type, and columns whose names clash with the operators' own."""

import collections
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import importance
from tideline.llm.bpe import encode
from tideline.llm.exact_dedup import exact_groups
from tideline.llm.hmm import score_texts
from tideline.llm.line_dedup import line_bitmaps
from tideline.llm.packing import pack
from tideline.llm.queries import tokenizer_path
from tideline.llm.simhash import near_duplicates
from tideline.llm.suffix_dedup import remove_repeats
from tideline.llm.warc import read_archives, write_pages

OPERATORS = {
    "op1": remove_repeats,
    "op3": exact_groups,
    "op4": lambda df: near_duplicates(df, words=4, radius=4),
    "op7": lambda df: pack(df, tokenizer_path("byte_bpe_50k.json")),
    "op10": lambda df: encode(df, tokenizer_path("word_bpe_49k.json")),
    "op12": line_bitmaps,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_text_identifiers_pass_through(edge, name):
    short = edge.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    texts = short.withColumn("doc_id", F.concat(F.lit("no "), "doc_id"))
    by_number = OPERATORS[name](short).select("_id").distinct().collect()
    by_text = OPERATORS[name](texts)
    assert dict(by_text.dtypes)["_id"] == "string"
    want = {None if r._id is None else f"no {r._id}" for r in by_number}
    assert {r._id for r in by_text.select("_id").distinct().collect()} == want


def test_clashing_columns_of_scores_packing_and_encoding(edge):
    """Columns named like those inside the operators change nothing."""
    plain = edge.where("doc_id < 8").select("doc_id", "text")
    clash = plain
    for name in ("block", "hash", "held", "n", "c", "kinds", "start", "sequence_id", "ids"):
        clash = clash.withColumn(name, F.lit("x"))
    both = [score_texts(plain, states=2, rounds=1), score_texts(clash, states=2, rounds=1)]
    got = [sorted(((r._id, r.n_tokens, round(r.base_score, 6)) for r in x.collect()), key=repr) for x in both]
    assert got[0] == got[1] and got[0]
    for run in (OPERATORS["op7"], OPERATORS["op10"]):
        sizes = [sorted((str(r._id) for r in run(x).select("_id").collect())) for x in (plain, clash)]
        assert sizes[0] == sizes[1]


def test_pages_of_an_empty_table_and_long_ones(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string, path string, kind string")
    write_pages(empty, f"{tmp_path}/none")
    assert read_archives(spark, f"{tmp_path}/none").count() == 0
    long = "x" * 3_000_000
    rows = [(1, "u", long, "p", "k"), (2, "u", long, "p", "k"), (3, None, None, "p", "k")]
    write_pages(spark.createDataFrame(rows, empty.schema), f"{tmp_path}/long")
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in read_archives(spark, f"{tmp_path}/long").collect()}
    assert found == {1: ("revisit", 2, 3_000_000), 2: ("response", None, 3_000_000), 3: ("response", None, 0)}


def plain_weights(rows, wanted):
    """Log ratios and keys of the resampling operator, text by text."""
    def buckets(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
        out = [x >> 48 for x in h]
        for a, b in zip(h, h[1:]):
            p = (a * 0x9E3779B97F4A7C15 + b) % 2**64
            p = (p ^ p >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            out.append(p >> 48)
        return out

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in wanted:
            target.update(buckets(t))
    half, size = importance.ALPHA, importance.BUCKETS
    whole, share = sum(raw.values()) + half * size, sum(target.values()) + half * size
    out = []
    for i, t in rows:
        log = sum(
            math.log((target[b] + half) / share) - math.log((raw[b] + half) / whole) for b in buckets(t)
        )
        u = ((xxhash.xxh3_64_intdigest(str(i), seed=importance.SEED) >> 11) + 0.5) / 2**53
        out.append((i, log, log - math.log(-math.log(u))))
    return out


def test_resampling_equals_a_plain_version(spark, edge):
    words = "alpha beta gamma Delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(3)
    rows = [(100 + i, " ".join(rng.choice(words[: 4 + i % 5], size=i % 40))) for i in range(80)]
    rows += [(r.doc_id, r.text) for r in edge.collect() if r.doc_id is not None and r.doc_id not in (8, 9)]
    wanted = {i for i, _ in rows if i % 3 == 0}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    found = importance.resample(df, good).collect()
    want = plain_weights(rows, wanted)
    last = sorted((k for *_, k in want), reverse=True)[math.ceil(importance.SHARE * len(rows)) - 1]
    near = lambda rs: sorted((i, round(log, 6), round(key, 6), kept) for i, log, key, kept in rs)
    assert near((r._id, r.log_ratio, r.key, r.kept) for r in found) == near((i, a, k, k >= last) for i, a, k in want)
