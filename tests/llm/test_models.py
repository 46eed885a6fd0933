import collections
import hashlib
import math
import random
import re
import time
import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, chat_format, hmm, importance, packing, quality, warc
from tideline.llm.queries import tokenizer_path

BYTE = tokenizer_path("byte_bpe_50k.json")
WORD = tokenizer_path("word_bpe_49k.json")
ODD = [
    "", " ", " a", "<|endoftext|>", "Hi <|startoftext|>You<|endoftext|>!", "ΑΣ ΣΑΣ", "İstanbul ǅ ﬁ", "é́ 가",
    "日本語 😀👍🏽", "it's don't I'LL we've", "a" * 700, "ab" * 300, "12345 ١٢٣ ½ ²³ ªº µ", "\x00\x01\x1c\x85 ​ x",
    "tab\tnew\nline", "ſ K", "q\xa0r\x85s", "ab</w>cd", "  two  spaces\n\n end ", "‸԰",
]


@pytest.fixture(scope="module")
def odd(spark, edge):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(900 + i, r.text) for i, r in enumerate(edge.collect())]
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(odd, nothing):
    df, rows = odd
    t = library(WORD)
    for r in bpe.encode(df, WORD, with_ids=True).collect():
        ids = t.encode(rows[r._id] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded == text and r.n_tokens == len(ids), rows[r._id]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(nothing, WORD).count() == 0


def test_merges_equal_a_plain_merge_loop():
    rnd = random.Random(1)
    letters = [bpe.byte_letters()[b] for b in b"abc"]
    vocab = {x: i for i, x in enumerate(bpe.byte_letters())}
    merges, have = [], list(letters)
    for _ in range(30):
        a, b = rnd.choice(have), rnd.choice(have)
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
            have.append(a + b)
    rank = {m: i for i, m in enumerate(merges)}
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(60))) for _ in range(300)]

    def plain(word):
        parts = [chr(b) for b in word]
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not found:
                return [vocab[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    got = bpe.Merger(vocab, merges, None)(words)
    assert [g.tolist() for g in got] == [plain(w) for w in words]


def check_pieces(rows, ids, window):
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per_doc[r._id].append(r)
        per_sequence[r.sequence_id].append(r)
    assert per_doc.keys() == ids.keys()
    for i, data in ids.items():
        at = 0
        for r in sorted(per_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(data) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(data[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(data)
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two


@pytest.mark.parametrize("window", [8, 2048])
def test_packing_cuts_and_fills(odd, nothing, window):
    df, rows = odd
    t = library(BYTE)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows.items()}
    found = packing.pack(df, BYTE, window=window, with_ids=True).collect()
    check_pieces(found, ids, window)
    assert all(r.ids == ids[r._id][r.start : r.start + r.length] for r in found)
    assert packing.pack(nothing, BYTE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, BYTE, window=100)


def test_repeat_counts_use_exact_fits():
    histogram = np.zeros(64, np.int64)
    histogram[[20, 44, 10, 54]] = 100, 100, 50, 50
    combos = packing.combinations(64, 8)
    counts = packing.repeat_counts(histogram, combos)
    used = {tuple(combos[i]): round(counts[i]) for i in np.flatnonzero(counts > 0.5)}
    assert used == {(0, 20, 44): 100, (0, 10, 54): 50}


def test_chats_round_trip(spark):
    odd_texts = [r"<\s>", r"[\\INST]", "</s></s>", r"<<s>[[INST]", r"\<s>", "<s", "é<s>\0", r"[\/INST]x", None, ""]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(odd_texts[::-1], odd_texts))]
    rows += [(2, 1, "assistant", "b"), (2, 0, "assistant", "a</s>"), (2, 0, "assistant", "a</s>"), (None,) * 4]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("_id", F.lit("clash"))
    found = {r._id: r for r in chat_format.format_chats(df).collect()}
    turns = [(a.decode(), b.decode()) for a, b in chat_format.read_turns(bytes(found[1].formatted))]
    assert turns == [(r or "", t or "") for _, _, r, t in rows[:10]]
    data = bytes(found[2].formatted)
    assert [chat_format.unescape(data[a:z]) for a, z in found[2]["mask"]] == [b"a</s>", b"a</s>", b"b"]
    assert chat_format.read_turns(bytes(found[None].formatted)) == [(b"", b"")]
    digest = {r._id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert (digest[2].n_turns, digest[2].loss_chars) == (3, 11)
    assert digest[2].loss_sha256 == hashlib.sha256(b"a</s>a</s>b").hexdigest()
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_batches_of_chats_are_cut_between_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "MOST", 100)
    rows = [(i, t, "user", f"{i} {t}") for i in range(50) for t in range(1 + i % 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.read_back(chat_format.format_chats(df)).collect()
    assert {r._id: r.n_turns for r in found} == {i: 1 + i % 7 for i in range(50)}


def test_pages_round_trip(spark, tmp_path):
    pages = [(1, "u", "same"), (5, None, "same"), (3, "a\nb", "same"), (2, "u", None), (7, "u", ""), (None, "u", "x"),
             (9, "u", "é" * 10_000), (9, "u", "é" * 10_000), (10, "u", "WARC/1.1\r\n\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_pages(df, f"file://{tmp_path}/w")
    found = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert {r.kind for r in found} == {"record"}
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr)
    best = {1: 5, 3: 5, 2: 7}
    want = [
        (i, len((h or "").encode()), warc.digest((h or "").encode()), "revisit" if i in best else "response", best.get(i))
        for i, _, h in pages
    ]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_one_record(compress):
    rnd = random.Random(2)
    records = [
        warc.page_record(i, "u", (f"WARC/1.1\r\n\x1f\x8b\x08 {i} " * 40).encode(), compress=compress) for i in range(12)
    ]
    starts = np.cumsum([0, *map(len, records)]).tolist()
    data = b"".join(records)
    for _ in range(150):
        k = rnd.randrange(12)
        broken = bytearray(data)
        at = starts[k] + rnd.randrange(len(records[k]))
        if rnd.random() < 0.5:
            broken[at] ^= 1 << rnd.randrange(8)
        else:
            del broken[at : starts[k + 1]]
        rows = list(warc.read_rows("f", bytes(broken)))
        assert set(range(12)) - {r[5] for r in rows if r[1] == "record"} <= {k}
        spans = sorted({(r[2], r[3]) for r in rows})
        assert spans[0][0] == 0 and spans[-1][1] == len(broken)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert list(warc.read_rows("f", b"")) == []
    assert [r[1] for r in warc.read_rows("f", b"junk")] == ["gap"]


def members(n, size=200):
    """Plain records with their digests."""
    return [warc.page_record(i, f"u{i}", bytes([65 + i]) * size, compress=False) for i in range(n)]


def test_a_damaged_record_inside_a_member_costs_only_itself():
    records = members(5)
    records[2] = records[2].replace(b"CCC", b"CxC", 1)
    packed = gzip.compress(b"".join(records))
    found = list(warc.salvage(packed + gzip.compress(members(6)[5])))
    assert [f[0] for f in found] == ["record", "record", "gap", "record", "record", "record"]
    assert [f[4][-1:] for f in found if f[0] == "record"] == [b"A", b"B", b"D", b"E", b"F"]
    assert found[2][1:3] == (0, len(packed)) and found[5][1] == len(packed)
    plain = list(warc.salvage(b"".join(records)))
    assert [f[0] for f in plain] == ["record", "record", "gap", "record", "record"]


def test_a_member_that_is_cut_off_gives_what_it_holds():
    rnd = random.Random(1)
    records = [warc.page_record(i, f"u{i}", rnd.randbytes(3000), compress=False) for i in range(6)]
    packed = gzip.compress(b"".join(records))
    after = gzip.compress(members(1)[0])
    found = list(warc.salvage(packed[:-30] + after))
    assert [f[0] for f in found] == ["record"] * 5 + ["gap", "gap", "record"] or [f[0] for f in found] == ["record"] * 5 + ["gap", "record"]
    assert found[-1][4].endswith(b"A" * 200) and found[-1][1] == len(packed) - 30
    broken = bytearray(packed)
    broken[len(packed) // 2] ^= 255
    found = list(warc.salvage(bytes(broken) + after))
    assert [f[0] for f in found].count("record") >= 3 and found[-1][0] == "record"


def test_salvage_time_grows_with_the_file():
    rnd = random.Random(2)
    for data in (b"WARC/1.1\r\n" * 26_000, b"\x1f\x8b\x08\x00" * 250_000, b"".join(b"\x1f\x8b\x08" + rnd.randbytes(9) for _ in range(80_000))):
        begin = time.time()
        found = list(warc.salvage(data + members(1)[0]))
        assert found[-1][0] == "record" and found[0][0] == "gap" and time.time() - begin < 8


@pytest.mark.parametrize("size", [(1 << 20) - 300, (1 << 20) + 5, 3_000_000, 4 << 20])
def test_a_record_that_inflates_to_much_more_is_whole(size):
    """A piece of a member may inflate to more than is taken at once, also the last one of the file."""
    packed = warc.page_record(1, "u", b"x" * size)
    assert len(packed) < warc.PIECE
    for data in (packed, packed + packed, packed + members(1)[0]):
        found = list(warc.salvage(data))
        assert [f[0] for f in found] == ["record"] * (1 if data is packed else 2)
        assert (found[0][1], found[0][2]) == (0, len(packed)) and found[-1][2] == len(data)
        assert found[0][4].endswith(b"x" * size)
    cut = list(warc.salvage(packed[:-20] + packed))
    assert [f[0] for f in cut] == ["gap", "record"] and cut[1][4].endswith(b"x" * size)


def test_an_empty_member_is_no_gap():
    data = members(1)[0] + gzip.compress(b"") + gzip.compress(members(2)[1]) + gzip.compress(b"")
    assert [f[0] for f in warc.salvage(data)] == ["record", "record"]


def test_headers_have_a_bound():
    long = warc.VERSION + b"X: y\r\n" * 20_000 + b"Content-Length: 0\r\n\r\n\r\n\r\n"
    found = list(warc.salvage(long + members(1)[0]))
    assert [f[0] for f in found] == ["gap", "record"] and found[0][2] == len(long)



def test_language_model_counts_and_likelihood(spark, nothing):
    rnd = random.Random(4)
    pools = [[f"a{i}on" for i in range(40)], [f"z{i}ent" for i in range(40)]]
    rows = [(i, " ".join(rnd.choice(pools[i % 2]) for _ in range(rnd.randrange(700)))) for i in range(80)]
    rows += [(200, None), (200, None), (None, "A0on  unseen"), (201, "A0ON a1on"), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    found = hmm.score_texts(df, held_out=held, states=2, rounds=3).collect()
    assert len(found) == len(rows)
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    taught = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    c = collections.Counter(w for i, words in tokens if taught(i) for w in words)
    n, v = sum(c.values()), len(c)
    base = lambda words: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
    want = sorted(
        (str(i), not taught(i), len(w), sum(c[x] > 0 for x in w), n, round(base(w), 6)) for i, w in tokens
    )
    got = sorted(
        (str(r._id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found
    )
    assert got == want
    held_out = [r for r in found if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)
    assert hmm.score_texts(nothing).count() == 0
    unknown = hmm.score_texts(df, held_out=F.lit(True)).collect()
    assert {r.n_known for r in unknown} == {0} and {r.train_tokens for r in unknown} == {0}


def test_forward_recursion_by_segments_is_exact():
    rng = np.random.default_rng(0)
    model = hmm.Model.from_counts(rng.random(3), rng.random((3, 3)), rng.random((3, 12)), np.full(12, 1 / 12))
    sizes = np.array([5, 1, 300, 17, 513])
    flat = rng.integers(0, 12, sizes.sum())
    got, at = model.log10(hmm.Segments(flat, sizes, 8), 5), 0
    for k, size in enumerate(sizes):
        a = model.start * model.emit[:, flat[at]]
        log = math.log10(a.sum())
        a /= a.sum()
        for x in flat[at + 1 : at + size]:
            a = (a @ model.move) * model.emit[:, x]
            log += math.log10(a.sum())
            a /= a.sum()
        at += size
        assert abs(log - got[k]) < 1e-8


@pytest.mark.parametrize("segment", [1, 2, 3, 256])
def test_expected_counts_equal_a_sum_over_paths(segment):
    """The uncut text and its segments teach the same."""
    rng = np.random.default_rng(1)
    model = hmm.Model.from_counts(rng.random(2), rng.random((2, 2)), rng.random((2, 4)), np.full(4, 1 / 4))
    seen = np.array([0, 3, 1, 1, 2])
    weight = {}
    for path in np.ndindex(*[2] * len(seen)):
        p = model.start[path[0]] * model.emit[path[0], seen[0]]
        for t in range(1, len(seen)):
            p *= model.move[path[t - 1], path[t]] * model.emit[path[t], seen[t]]
        weight[path] = p
    total = sum(weight.values())
    start, move, emit, log = model.expected(hmm.Segments(seen, np.array([5]), segment), 1)
    assert abs(log - math.log10(total)) < 1e-12
    for i in range(2):
        assert np.isclose(start[i], sum(p for q, p in weight.items() if q[0] == i) / total)
        for j in range(2):
            want = sum(p * sum(a == i and b == j for a, b in zip(q, q[1:])) for q, p in weight.items()) / total
            assert np.isclose(move[i, j], want)


def test_more_rounds_never_lower_the_likelihood():
    rng = np.random.default_rng(2)
    flat, sizes = rng.integers(0, 6, 400), np.full(8, 50)
    kinds = np.bincount(flat, minlength=6).astype(float)
    model, logs = hmm.Model.first(kinds, 3), []
    for _ in range(6):
        start, move, emit, log = model.expected(hmm.Segments(flat, sizes, 7), 8)
        logs.append(log)
        model = hmm.Model.from_counts(start, move, emit.T, (kinds + 0.1) / (kinds + 0.1).sum())
    assert all(b > a - 0.05 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    mark = [0] * len(words)
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            mark[i : i + 8] = [1] * 8
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), sum(mark),
    )


@pytest.mark.parametrize("text", [*ODD, "a b c " * 30, "x | y # z\nx | y # z\n \n \n", "a b c d e f g h i a b c d e f g h"])
def test_counts_of_quality_rules(text):
    assert quality.counts(text.encode()) == brute_counts(text)


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over characters, as a function of (context, character)."""
    grams = collections.Counter()
    for t in texts:
        line = "\x01" * 3 + t
        grams.update(line[i - 3 : i + 1] for i in range(3, len(line)))
    levels = {4: grams}
    for order in (3, 2, 1):
        levels[order] = collections.Counter(g[1:] for g in levels[order + 1])
    discounts = {}
    for order, level in levels.items():
        n = collections.Counter(level.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            discounts[order] = [max(0.01, i - (i + 1) * y * n[i + 1] / n[i]) for i in (1, 2, 3)]
        else:
            discounts[order] = [0.5, 1.0, 1.5]

    def p(context, x, order=4):
        if order == 0:
            return 1 / (len(levels[1]) + 1)
        context = context[len(context) - order + 1 :] if order > 1 else ""
        here = {g: c for g, c in levels[order].items() if g[:-1] == context}
        low = p(context[1:], x, order - 1)
        if not here:
            return low
        less = lambda c: min(c, discounts[order][min(c, 3) - 1])
        total, c = sum(here.values()), here.get(context + x, 0)
        return (c - less(c) if c else 0) / total + sum(map(less, here.values())) / total * low

    return p


def test_perplexity_equals_a_plain_model(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abbccd ") for _ in range(rnd.randrange(1, 60))) for _ in range(25)]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    p = brute_kneser_ney(texts)
    for r in quality.quality(df).collect():
        line = "\x01" * 3 + texts[r._id]
        logs = [math.log10(p(line[i - 3 : i], line[i])) for i in range(3, len(line))]
        assert abs(r.log_perplexity + sum(logs) / len(logs)) < 1e-4


def test_quality_of_edge_rows(edge, nothing):
    found = quality.quality(edge, keep=("lang",), with_text=True).collect()
    assert sorted(map(repr, ((r._id, r._text, r._lang) for r in found))) == sorted(
        map(repr, ((r.doc_id, r.text or "", r.lang) for r in edge.collect()))
    )
    for r in found:
        words, *_, repeats = brute_counts(r._text or "")
        assert r.n_words == words and r.base_failed == (words < 20 or 100 * repeats > 30 * words)
        assert not (r.base_failed and r.kept)
    assert quality.quality(nothing).count() == 0


def test_bands_reject_a_stranger(spark):
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("etaoins") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(60)), "en") for i in range(100)]
    rows.append((999, " ".join("".join(chr(rnd.randrange(33, 9000)) for _ in range(5)) for _ in range(60)), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r._id: r.kept for r in quality.quality(df).collect()}
    assert not kept.pop(999) and sum(kept.values()) >= 98


def test_copies_do_not_narrow_the_band(spark):
    """Two thirds of the rows of a language are one text; the others stay all the same."""
    rnd = random.Random(16)
    pool = ["".join(rnd.choice("etaoinshrdlu") for _ in range(5)) for _ in range(200)]

    def text():
        return " ".join(rnd.choice(pool) for _ in range(rnd.randrange(60, 120)))

    rows = [(i, text(), "en") for i in range(60)]
    copy = text()
    plain = spark.createDataFrame([*rows, (60, copy, "en")], "doc_id long, text string, lang string")
    rows += [(60 + i, copy, "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r._id: r for r in quality.quality(df).collect()}
    for r in quality.quality(plain).collect():
        assert abs(r.log_perplexity - found[r._id].log_perplexity) < 1e-9
        assert (r.kept, r.lower, r.upper) == (found[r._id].kept, found[r._id].lower, found[r._id].upper)
    assert sum(r.kept for i, r in found.items() if i < 60) >= 58


@pytest.mark.parametrize("bits", [8, 22])
def test_perplexity_does_not_depend_on_the_space(spark, bits):
    """Far more n-grams than 2**8: none takes the probability of another."""
    rnd = random.Random(17)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x4E40)) for _ in range(rnd.randrange(1, 50))) for _ in range(25)]
    df = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)] + [(99, None, "zh")], "doc_id long, text string, lang string")
    p = brute_kneser_ney(texts)
    for r in quality.quality(df, bits=bits).collect():
        if r._id == 99:
            assert r.log_perplexity is None
            continue
        line = "\x01" * 3 + texts[r._id]
        logs = [math.log10(p(line[i - 3 : i], line[i])) for i in range(3, len(line))]
        assert abs(r.log_perplexity + sum(logs) / len(logs)) < 1e-4


def test_resampling_prefers_the_target(spark, edge, nothing):
    rnd = random.Random(7)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choice(good if i < 60 else bad) for _ in range(40))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    kept = {r._id for r in importance.resample(df, wanted, share=0.5).collect() if r.kept}
    assert len(kept) == 50 and kept <= set(range(60))
    assert importance.resample(edge, wanted).count() == edge.count()
    assert importance.resample(nothing, wanted).count() == 0
    assert importance.resample(edge, wanted.limit(0)).count() == edge.count()


def test_kth_largest(spark):
    rnd = random.Random(9)
    values = [rnd.choice([-(1 << 63), -5, 0, 3, (1 << 63) - 1, rnd.randrange(-(1 << 62), 1 << 62)]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 7, 120, 200):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 500) == min(values)
    assert importance.kth_largest(df, "v", 0) is None
