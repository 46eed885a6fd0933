import collections
import hashlib
import random
import zlib

import pytest

from tideline.llm.prefix_trie import Block, Strand, numbered, prefix_nodes, rebuilt


def brute(sequences):
    """{conv: [(text, bytes), ...]} to the rows of all nodes."""
    nodes = collections.defaultdict(list)
    for conv, items in sequences.items():
        for d in range(len(items) + 1):
            nodes[tuple(items[:d])].append(conv)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        own = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += k not in kids
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(sequences[c]) == len(k))
        out.append((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def rows_of(sequences):
    return [
        (c, at, hashlib.md5(repr(i).encode()).digest(), len(i[1].encode()))
        for c, items in sequences.items() for at, i in enumerate(items)
    ]


def plant(seed, n, width=3, longest=14):
    """Sequences that share prefixes, copies, prefixes of others, and some without a turn."""
    rnd = random.Random(seed)
    out = {}
    for c in range(n):
        kind = rnd.random()
        if out and kind < 0.3:
            items = list(out[rnd.choice(list(out))])
        elif out and kind < 0.5:
            items = list(out[rnd.choice(list(out))])[: rnd.randrange(longest)]
        else:
            items = []
        if kind > 0.25:
            items += [("user", f"t{rnd.randrange(width)}" * rnd.randrange(1, 3)) for _ in range(rnd.randrange(longest))]
        out[c * 7 - 50] = items
    return out


@pytest.mark.parametrize("band, block, last", [(256, 1 << 17, 8 << 20), (256, 12, 2000), (3, 40, 4000)])
def test_nodes_match_brute_force(spark, band, block, last):
    """Also with bands, blocks and last merges so small that all ways are taken."""
    sequences = plant(band + block, 160, longest=8)
    turns = spark.createDataFrame(rows_of(sequences), "_id long, at long, digest binary, bytes long").repartition(3)
    ids = spark.createDataFrame([(c,) for c in sequences], "_id long")
    assert got(prefix_nodes(turns, ids, band, block, last)) == brute(sequences)


def solved(sequences, cuts):
    """Blocks of the given sizes, merged in one last block, without Spark."""
    def key(items):
        return b"".join(hashlib.md5(repr(i).encode()).digest() for i in items)

    def sizes(items):
        return b"".join(len(i[1].encode()).to_bytes(8, "little") for i in items)

    strands = [
        Strand(b"", key(x), sizes(x), b"", [[len(x), 1, c, 0, 0, 0, [c]]]) for c, x in sequences.items()
    ]
    strands.sort(key=lambda s: (s.key, s.events[0][2]))
    nodes, left, named = [], [], {}
    for size in cuts:
        part, strands = strands[:size], strands[size:]
        if not part:
            break
        block = Block(part, 999, 0, True, False)
        left += block.contracted()
        nodes += block.nodes
    final = Block(left, 999, 0, False, True)
    for n in final.nodes:
        named[n[4]] = n[0]
    return sorted(
        ((n[0], n[1], named[n[3]] if n[3] else n[2], *n[5:9]) for n in nodes + final.nodes), key=repr
    )


@pytest.mark.parametrize("seed", range(12))
def test_contracted_blocks_lose_nothing(seed):
    rnd = random.Random(seed)
    sequences = plant(seed, 40, 2, 5)
    cuts = [rnd.randrange(1, 9) for _ in range(40)]
    assert solved(sequences, [c for c in cuts if c][:40]) == sorted((r[:7] for r in brute(sequences)), key=repr)


def test_rebuilt_conversations(spark, nothing):
    rows = [(c, t, "user" if t % 2 else None, f"text {c // 3} {t}" if t else None) for c in range(23) for t in range(c % 7 + 1)]
    rows += [(4, None, "first", "null turn"), (None, 1, "x", "no conversation"), (12, 99, "late", "é" * 40)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, at string, bytes int")
    own = collections.defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    found = prefix_nodes(*rebuilt(numbered(df, "conv_id", "turn", ("role", "text"), "text")))
    assert got(found) == brute(built)
    empty = df.limit(0)
    assert prefix_nodes(*rebuilt(numbered(empty, "conv_id", "turn", ("role", "text"), "text"))).count() == 0


def test_one_conversation_with_most_rows(spark):
    """Thousands of turns in one conversation are cut into bands, of which it has most for itself."""
    turns = [(1, i, "user", str(i % 977)) for i in range(4000)] + [(2, i, "user", str(i % 977)) for i in range(600)]
    turns += [(c, i, "user", "a") for c in range(3, 9) for i in range(c)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    numbers = numbered(df, "conv_id", "turn", ("role", "text"), "text")
    sequences = collections.defaultdict(list)
    for c, _, role, text in turns:
        sequences[c].append((role, text))
    found = got(prefix_nodes(numbers, numbers.select("_id")))
    assert len(found) == 4000 + 8 + 1
    shared = [r for r in found if r[3] == 2 and r[0] == 1]
    assert {r[1] for r in shared} == set(range(1, 601)) and all(r[2] == 1 for r in shared)
    assert next(r for r in found if r[1] == 600 and r[0] == 1)[4:6] == (1, 1)
    top = next(r for r in found if r[1] == 0)
    assert top[0] == 1 and top[3] == 8 and top[5] == 2
    assert top[6] == sum(len(t[3]) for t in turns if t[0] == 2) + sum(9 - max(d, 3) - 1 for d in range(1, 9))
