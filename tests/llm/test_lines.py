import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import line_dedup
from tideline.llm.line_dedup import kept_lines, line_bitmaps

SPACE = " \t\n\r\x0b\x0c"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, min_length=1, keep_first=False):
    seen, first = collections.Counter(), {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, line_order(r[1])))
    for i, t in order:
        lines = (t or "").split("\n")
        seen.update({key(x) for x in lines})
        for n, x in enumerate(lines):
            first.setdefault(key(x), (i, t or "", n))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [
            n for n, x in enumerate(lines)
            if len(key(x)) < max(min_length, 1) or seen[key(x)] < min_docs
            or keep_first and first[key(x)] == (i, t or "", n)
        ]
        kept = "\n".join(lines[n] for n in stay)
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256(kept.encode()).hexdigest(), tuple(stay)))
    return sorted(out, key=repr)


HASHES = {}


def line_order(text):
    return HASHES.get(text or "", 0)


def got(frame):
    return sorted(
        ((r._id, r.n_lines, r.n_dropped, r.kept_sha256, tuple(kept_lines(r.keep_bitmap, r.n_lines))) for r in frame.collect()),
        key=repr,
    )


def corpus(seed, n=400):
    rnd = random.Random(seed)
    lines = [f"Line {i}" for i in range(60)]
    rows = []
    for i in range(n):
        own = [rnd.choice(lines) if rnd.random() < 0.6 else f"own {i} {k}" for k in range(rnd.randrange(6))]
        own += ["  ALWAYS here\t", ""] if i % 3 else []
        rnd.shuffle(own)
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_lines_match_brute_force(spark, edge, min_docs, keep_first):
    """Four range partitions for few keys, so that keys cross their edges."""
    rows = corpus(5) + [(r.doc_id, r.text) for r in edge.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = df.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    HASHES.update({t or "": h for t, h in hashed})
    assert got(line_bitmaps(df, min_docs=min_docs, keep_first=keep_first)) == brute(rows, min_docs, 1, keep_first)


def test_a_key_that_all_documents_hold_is_spread(spark):
    """One key over many partitions: each holds a part, and none decides alone."""
    rows = [(i, "The Same\nline %d" % i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got(line_bitmaps(df, min_docs=10))
        once = got(line_bitmaps(df, min_docs=10, keep_first=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute(rows, 10)
    assert once == brute(rows, 10, keep_first=True)


def test_stream_holds_at_most_the_undecided_rows():
    import pyarrow as pa

    def rows(keys):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([0] * len(keys), pa.int64()), pa.array(range(len(keys))),
             pa.array(range(len(keys))), pa.array([[0]] * len(keys), line_dedup._PLACES)],
            names=["h1", "h2", "_id", "t1", "places"],
        )

    run = line_dedup._decided_rows(3)
    out = [b.to_pydict() for b in run([rows([1, 1]), rows([]), rows([1, 2, 2, 3, 3, 3]), rows([3, 4]), rows([4])])]
    flat = [(k, p, lead, n) for b in out for k, p, lead, n in zip(b["h1"], b["pending"], b["lead"], b["n"])]
    assert sorted(x for x in flat if x[0] == 1) == [(1, False, False, 0)] * 2 + [(1, True, True, 3)]
    assert [x[0] for x in flat if x[0] == 2] == []
    assert sorted(x for x in flat if x[0] == 3) == [(3, False, False, 0)] * 3 + [(3, False, True, 0)]
    assert sorted(x for x in flat if x[0] == 4) == [(4, True, False, 0), (4, True, True, 2)]


def test_types_extra_columns_and_empty_tables(spark, edge, nothing):
    assert line_bitmaps(nothing).count() == 0
    df = edge.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("places", F.lit(1)).withColumn("t1", F.lit(2))
    found = line_bitmaps(df, min_docs=2, with_text=True, keep=("places", "lang"))
    assert dict(found.dtypes)["_id"] == "string" and {"_places", "_lang", "_kept"} <= set(found.columns)
    rows = {(r._id, r._kept) for r in found.collect()}
    # A repeated row is two documents, so its line goes; the long copies have one line.
    assert ("4", "") in rows and ("8", "") in rows and ("5", "one two three four") in rows
    with pytest.raises(ValueError):
        line_bitmaps(edge, min_docs=0)


def test_shorter_keys_stay(spark):
    rows = [(i, "ab\nabc\näö") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_bitmaps(df, min_docs=2, min_length=3)) == brute(rows, 2, 3)
