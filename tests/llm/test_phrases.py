import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import phrases as ph
from tideline.llm.phrases import compact_paths, cut_words, phrases


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
        words = [w for w in re.split("[\x20\x09]", piece) if w]
        if words:
            yield words


def counts(rows, longest):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return f, n


def brute(rows, shortest=2, longest=3, min_count=10, cover=50, top=None):
    f, n = counts(rows, longest)
    found = {k: a for k, a in f.items() if shortest <= len(k[1]) and len(k[1]) > 1 and a >= min_count}
    covered = set()
    for (lang, g), a in found.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                part = lang, g[i : i + m]
                if part in found and 100 * a >= cover * found[part]:
                    covered.add(part)
    by_lang = collections.defaultdict(list)
    for (lang, g), a in found.items():
        if (lang, g) not in covered:
            cuts = [(10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            phrase = " ".join(g)
            by_lang[lang].append((-score, -a, phrase.encode(), phrase, f[lang, g[:k]], f[lang, g[k:]]))
    out = []
    for lang, some in by_lang.items():
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(some)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, n[lang], -score))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def corpus(seed):
    rnd = random.Random(seed)
    common = [f"w{i}" for i in range(12)] + ["É", "字"]
    line = "once upon a time there was one long line that never ends without its last word"
    out = []
    for i in range(300):
        words = [rnd.choice(common) if rnd.random() < 0.8 else f"rare{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]
        for at in range(rnd.randrange(4)):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice([", ", "\n", ".", "\t", "Big Apple", "a a a a"]))
        if i % 4 == 0:
            words += [".", line if i % 8 else line.upper()]
        out.append((rnd.choice(["en", "de", None, "und"]), " ".join(words)))
    return out


@pytest.mark.parametrize("longest, min_count, cover", [(3, 10, 50), (2, 3, 50), (4, 4, 80), (5, 6, 50)])
def test_phrases_match_brute_force(spark, edge, longest, min_count, cover):
    rows = corpus(longest) + [(r.lang, r.text) for r in edge.collect()]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = phrases(df, longest=longest, min_count=min_count, cover=cover, top=None)
    want = brute(rows, 2, longest, min_count, cover)
    assert want and got(found) == want


def test_top_longer_phrases_and_other_columns(spark, nothing):
    rows = corpus(9)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, g1 int, n string, score int")
    assert got(phrases(df, shortest=3, top=4)) == brute(rows, shortest=3, top=4)
    assert phrases(nothing).count() == 0
    assert phrases(df.withColumn("text", F.lit(None))).count() == 0
    with pytest.raises(ValueError):
        phrases(df, shortest=1)


@pytest.mark.parametrize("bits", [7, 20])
def test_a_full_filter_changes_no_count(spark, monkeypatch, bits):
    monkeypatch.setattr(ph, "MOST_BITS", bits)
    monkeypatch.setattr(ph, "LEAST_BITS", 7)
    monkeypatch.setattr(ph, "CHUNK", 300)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(phrases(df, min_count=5, top=None)) == brute(rows, min_count=5)


def test_unary_paths(spark):
    """a b c d e f has weight 10; b c branches where 5 more pieces are b c x."""
    def edge(*g):
        return tuple(ord(c) for c in g)

    edges = [(*edge(*"abc"), 10), (*edge(*"bcd"), 10), (*edge(*"cde"), 10), (*edge(*"def"), 10), (*edge(*"bcx"), 5)]
    nodes = [(*edge(*"ab"), 10), (*edge(*"bc"), 15), (*edge(*"cd"), 10), (*edge(*"de"), 10), (*edge(*"ef"), 10), (*edge(*"cx"), 5)]
    found = compact_paths(
        spark.createDataFrame(edges, "g1 long, g2 long, g3 long, n long"),
        spark.createDataFrame(nodes, "g1 long, g2 long, f long"), 3,
    ).collect()
    shown = {"".join(map(chr, (r.g1, r.g2, r.g3))): ("".join(map(chr, r.path)), r.place, r.ends) for r in found}
    assert shown == {
        "abc": ("abc", 0, True), "bcx": ("bcx", 0, True),
        "bcd": ("bcd", 0, False), "cde": ("bcd", 1, False), "def": ("bcd", 2, True),
    }


def test_words_of_a_text():
    data = "Ab  c\td.É f!".encode().translate(ph._PLAIN)
    h, piece, start, end = cut_words(data, 5)
    assert [data[s:e].decode() for s, e in zip(start, end)] == ["ab", "c", "d", "É", "f"]
    assert piece.tolist() == [0, 0, 0, 1, 1]
    again, *_ = cut_words(b"xx ab f c", 5)
    assert again[1] == h[0] and again[2] == h[4] and again[3] == h[1]
    assert cut_words(b"ab", 6)[0][0] != h[0]
    assert len(cut_words(b"", 1)[0]) == 0 and len(np.unique(cut_words(b"ab ba aab aba baa", 1)[0])) == 5
