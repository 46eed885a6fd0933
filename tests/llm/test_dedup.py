import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from tideline.llm.components import components
from tideline.llm.exact_dedup import exact_groups
from tideline.llm.simhash import ball, near_duplicates, spanning
from tideline.llm.suffix_dedup import covered, remove_repeats


def brute_repeats(texts, threshold):
    seen = collections.Counter(
        t[p : p + threshold] for t in texts for p in range(len(t) - threshold + 1)
    )
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - threshold + 1):
            if seen[t[p : p + threshold]] > 1:
                gone[p : p + threshold] = b"\1" * threshold
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()


def results(df):
    return sorted(
        ((r._id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr
    )


def expected(rows, threshold):
    texts = [(t or "").encode() for _, t in rows]
    return sorted(
        ((i, *found) for (i, _), found in zip(rows, brute_repeats(texts, threshold))), key=repr
    )


@pytest.mark.parametrize("threshold,digit", [(12, 4), (40, 8), (40, 40)])
def test_repeated_passages_match_brute_force(spark, threshold, digit):
    rnd = random.Random(threshold)
    passage = "".join(rnd.choice("abcd") for _ in range(3 * threshold))
    rows = []
    for i in range(60):
        text = "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(6 * threshold)))
        if i % 3 == 0:
            a = rnd.randrange(threshold)
            text += passage[a : a + threshold + rnd.randrange(threshold)] + text[:9]
        rows.append((i, text))
    rows += [(100, "z" * 5 * threshold), (101, rows[3][1]), (101, rows[3][1]), (102, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(remove_repeats(df, threshold=threshold, digit=digit)) == expected(rows, threshold)


def test_long_texts_are_walked_in_steps(spark, monkeypatch):
    from tideline.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "STRIDE", 64)
    rnd = random.Random(5)
    text = "".join(rnd.choice("ab") for _ in range(700))
    rows = [(1, text + "c" + text[100:300]), (2, text[250:500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(remove_repeats(df, threshold=30, digit=10)) == expected(rows, 30)


def test_repeats_of_edge_rows(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert results(remove_repeats(edge)) == expected(rows, 400)
    out = remove_repeats(nothing, with_text="bytes", keep=("lang",))
    assert out.count() == 0 and out.columns[-2:] == ["_kept", "_lang"]


def test_what_stays_is_the_text_without_its_spans(edge):
    texts = {(r.doc_id, r.text) for r in edge.collect()}
    for r in remove_repeats(edge, with_text="bytes").collect():
        assert any(
            i == r._id and bytes(r._kept) == b"".join(
                (t or "").encode()[a:z]
                for a, z in zip([0, *(e for _, e in r.spans)], [*(s for s, _ in r.spans), r.n_bytes])
            )
            for i, t in texts
        )


def test_covered_runs():
    start, end = covered(np.array([9, 0, 3]), np.array([9, 1, 4]), 4)
    assert start.tolist() == [0, 9] and end.tolist() == [8, 13]


def test_arguments_of_repeats(edge):
    with pytest.raises(ValueError):
        remove_repeats(edge, threshold=10, digit=11)
    with pytest.raises(ValueError):
        remove_repeats(edge, threshold=70_000)


def test_exact_groups_of_edge_rows(edge, nothing):
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    size = collections.Counter(t for _, t in rows)
    top = {t: max((i for i, x in rows if x == t and i is not None), default=None) for _, t in rows}
    found = exact_groups(edge, with_text=True, keep=("lang",)).collect()
    assert sorted((r._id, r._text) for r in found if r._id) == sorted(x for x in rows if x[0])
    assert all((r.group_size, r.keep_id) == (size[r._text], top[r._text]) for r in found)
    kept = collections.Counter(r._text for r in found if r.kept)
    assert kept == dict.fromkeys(size, 1)
    assert all(r._id == r.keep_id for r in found if r.kept)
    assert exact_groups(nothing).count() == 0


def test_equal_length_and_prefix_do_not_make_a_copy(spark):
    head = "p" * 100
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a"), (4, "q" * 101)]
    found = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r._id: (r.keep_id, r.group_size, r.kept) for r in found} == {
        1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True),
    }


def fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    n = min(words, len(parts))
    shingles = [b" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, words, radius):
    prints = [fingerprint(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, p, least.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def family(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(n):
        if i % 4 == 0:
            words = list(words)
            words[rnd.randrange(60)] = f"W{rnd.randrange(400)}"
        other = [f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 80))]
        rows.append((1000 - i, " ".join(words if i % 2 == 0 else other)))
    return rows


@pytest.mark.parametrize("compared", [1, 3, 256])
def test_components_match_brute_force(spark, edge, compared):
    rows = family(3) + [(r.doc_id, r.text) for r in edge.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(df, words=4, radius=4, compared=compared).collect()
    got = sorted(((r._id, r.f0 & (1 << 64) - 1, r.component_id) for r in found), key=repr)
    assert got == brute_components(rows, 4, 4)


def test_near_duplicates_of_an_empty_table(nothing):
    assert near_duplicates(nothing, keep=("lang",)).count() == 0


def test_unusable_radius(edge):
    with pytest.raises(ValueError):
        near_duplicates(edge, radius=5)


def test_ball_and_spanning_links():
    assert len(ball(64, 2)) == 2081 and len(set(ball(32, 1).tolist())) == 33
    prints = np.array([0, 1, 3, 3 << 40], np.uint64)
    assert len(spanning(prints, 1)) == 2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3), (500, 500)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    want = dict.fromkeys(range(1, 41), 1) | dict.fromkeys(range(100, 130), 100) | {500: 500}
    assert got == want
    assert components(df.limit(0)).count() == 0
