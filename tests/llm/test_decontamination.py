import hashlib
import random
import re

import numpy as np
import pytest

from logfathom.llm import decontamination as module
from logfathom.llm.decontamination import contamination, decontaminate, longest_matches, search, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - window + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[s : s + window]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (own := tuple(w[s : s + size])) in windows:
                    hit |= set(range(s, s + size))
                    ids |= windows[own]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(documents, prose):
    texts = dict(documents)
    part = lambda i, a, b: " ".join(texts[i].split()[a:b])
    return [
        (1, part(0, 5, 40)), (2, part(3, 0, 12).upper()), (10, part(3, 3, 20) + " and " + prose(15, 77)), (3, "word"), (4, None), (5, ""), (6, "?! --"), (7, "nowhere here"),
        (8, part(35, 17000, 17100)), (8, part(5, 1, 11)), (None, part(6, 2, 30)), (9, part(0, 5, 40)), (9, part(0, 5, 40)), (11, "日本 123"), (12, part(1, 0, 9)), (13, prose(50, 4321)),
    ]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(*x, 1, "w", 2) for x in items], "item_id long, text string, block int, words string, window int").repartition(2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shard,block", [(1 << 20, 8_000_000), (64, 300)])
def test_against_brute_force(docs, documents, benchmark, items, empty, monkeypatch, shard, block):
    """Also with shards that cut documents, and items in many blocks."""
    monkeypatch.setattr(module, "_SHARD", shard)
    monkeypatch.setattr(module, "_BLOCK", block)
    got = rows(contamination(docs, benchmark))
    assert got == brute(documents, items) and sum(x[5] for x in got) > 10
    assert rows(contamination(docs, benchmark, 4)) == brute(documents, items, 4)
    assert contamination(empty, benchmark).count() == 0
    assert rows(contamination(docs, benchmark.limit(0))) == brute(documents, [])


def test_removal(docs, documents, benchmark, items):
    clean = {i for i, *_, bad in brute(documents, items) if not bad}
    got = decontaminate(docs, benchmark)
    assert got.schema == docs.schema and {r.doc_id for r in got.collect()} == clean | {None}
    assert got.count() == sum(not x[5] for x in brute(documents, items))


def test_longest_matches(docs, documents, benchmark, items):
    want = {}
    for item, text in items:
        w = words(text)
        for s in range(len(w)):
            for doc, other in documents:
                v = words(other)
                at = [j for j, x in enumerate(v) if x == w[s]]
                for j in at:
                    n = 0
                    while s + n < len(w) and j + n < len(v) and w[s + n] == v[j + n]:
                        n += 1
                    if n >= 10:
                        key = ("null" if item is None else str(item), s)
                        want[key] = min(want.get(key, (0, True, 0, 0)), (-n, doc is None, doc or 0, j))
    got = {(r.item_id, r.start): (-r.n_words, r.doc_id is None, r.doc_id or 0, r.doc_start) for r in longest_matches(docs, benchmark).collect()}
    assert got == want and len(got) > 100


@pytest.mark.parametrize("letters,n", [(1, 50), (2, 400), (30, 1000)])
def test_suffix_arrays(letters, n):
    r = random.Random(n)
    text = [r.randint(0 if r.random() < 0.1 else 1, letters) for _ in range(n)]
    array = suffix_array(np.array(text), n)
    assert sorted(array.tolist()) == [i for i, x in enumerate(text) if x]
    key = lambda i: text[i : text.index(0, i) if 0 in text[i:] else n]  # noqa: E731  what follows the end of a text has no order
    assert all(key(a) <= key(b) for a, b in zip(array.tolist(), array.tolist()[1:], strict=False))
    test = np.array([r.randint(0, letters + 2) for _ in range(200)])
    test[test > letters] = 0
    length, low, high, from_, to = search(np.array(text), array, test, np.full(200, 3))
    for p in range(200):
        best, three = 0, 0
        for i in range(n):
            k = 0
            while p + k < 200 and i + k < n and test[p + k] and test[p + k] == text[i + k]:
                k += 1
            best, three = max(best, k), three + (k >= 3)
        assert length[p] == best and to[p] - from_[p] == three
        assert not best or all(text[i : i + best] == test[p : p + best].tolist() for i in array[low[p] : high[p]].tolist())
