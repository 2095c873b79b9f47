import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logfathom.llm import prefix_trie as module
from logfathom.llm.prefix_trie import prefix_trie, rank_segments

SCHEMA = "conv_id long, turn long, role string, text string, id long, parent long, part int, depth long, pos long, length long"


def brute(turns):
    """Nodes of the trie, from dictionaries."""
    by = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by.setdefault(conv, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    nodes = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children, out = {}, []
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k, members in nodes.items():
        inside = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(k))))
        leaves, saved = sum(x not in children for x in inside), sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in inside if x)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    texts = ["", "hello", "hello", "what is é?", "x" * 30, "日本"]
    turns = []
    for c in [*range(0, 60), *range(95, 260, 3), 700, 705, 799, -3, -101]:
        for t in range(r.choice([0, 1, 2, 3, 6, 9])):
            turns.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None]), r.choice([*texts, None])))
    turns += [(300, 1, "user", "twice"), (300, 1, "user", "twice"), (None, 1, "user", "of none"), (400, None, None, None)]
    turns += [(500 + i % 3, j, "user", f"long {j}") for i in range(3) for j in range(70)]  # copies, and deep nodes
    turns += [((1 << 63) - 1, 0, "user", "hello"), (-(1 << 63), 0, "user", "hello")]
    return turns


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("seed,few", [(1, 100_000), (2, 3)])
def test_against_brute_force(spark, seed, few):
    turns = made(seed)
    df = spark.createDataFrame([(*t, 9, 9, 9, 9, 9, 9) for t in turns], SCHEMA).repartition(3)
    got = prefix_trie(df, few)
    rows = got.collect()
    assert sorted(tuple(r)[:8] for r in rows) == brute(turns)
    assert sorted(x for r in rows for x in (r.enter, r.exit)) == list(range(2 * len(rows)))  # one tour


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    """A conversation with nearly all turns is numbered and named over several partitions, and a hot node's members are
    joined in pieces."""
    monkeypatch.setattr(module, "_CHUNK", 8)
    turns = [(7, i, "user", f"turn {i % 50}") for i in range(3000)] + [(c, 0, "user", "same") for c in range(1000, 1300)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in prefix_trie(df).collect()}
    assert len(got) == 1 + 3000 - zlib.crc32(b"7") % 6 + 1
    same = got[min(c for c in range(1000, 1300) if (c, 1) in got), 1]
    members = [c for c in range(1000, 1300) if zlib.crc32(str(c).encode()) % 6 == 0 or c % 100 == 0 or c - c % 100 in range(1000, 1300, 100)]
    assert same.n_convs == len(members) and same.ends_sha256 == hashlib.sha256(",".join(map(str, members)).encode()).hexdigest()


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(empty).count() == 0


@pytest.mark.parametrize("few", [1, 5, 1000])
def test_ranks(spark, few):
    order = random.Random(few).sample(range(1000, 2000), 200)
    rows = [(a, b, 1, a % 3, a) for a, b in zip(order, [*order[1:], -1], strict=True)]
    df = spark.createDataFrame(rows, "segment long, next long, pos long, leaves long, saved long")
    got = {r.segment: r for r in rank_segments(df, few).collect()}
    for i, a in enumerate(order):
        assert (got[a].pos, got[a].leaves, got[a].saved) == (i, sum(x % 3 for x in order[:i]), sum(order[:i]))


def test_paths_stay_apart(spark):
    """The same turns in another order, or split otherwise between role and text, are other nodes."""
    turns = [(100, 0, "a", "bc"), (100, 1, "x", "y"), (200, 0, "x", "y"), (200, 1, "a", "bc"), (300, 0, "ab", "c"), (300, 1, "x", "y")]
    got = prefix_trie(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert got.count() == 7 and got.filter(F.col("n_leaves") == 3).select("depth").first()[0] == 0
