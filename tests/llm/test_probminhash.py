import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logfathom.llm import probminhash as module
from logfathom.llm._words import text_bytes
from logfathom.llm.components import components
from logfathom.llm.probminhash import near_duplicates, one_of_each, shingles, signatures, similarity


def weights(t):
    w = (t or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def exact(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in every) for x in a if x in b)


def classes(items, threshold=0.8):
    """Brute force: each row's class name."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    w = [weights(t) for _, t in items]
    for i in range(len(items)):
        for j in range(i):
            if w[i] and w[j] and exact(w[i], w[j]) >= threshold - 1e-9:
                parent[find(i)] = find(j)
    out = []
    for i, (own, _) in enumerate(items):
        ids = [items[j][0] for j in range(len(items)) if find(j) == find(i)]
        out.append((own, min((x for x in ids if x is not None), default=None) if w[i] else own))
    return sorted(out, key=str)


def test_estimate(prose):
    """The share of equal registers is the probability Jaccard similarity, for repeated shingles too."""
    a = prose(200, 1)
    b = a + " " + " ".join([" ".join(a.split()[:20])] * 3) + " " + prose(60, 2)
    h, n, first = shingles(*text_bytes(pa.array([a, b])), 5)
    sig = signatures(h, n.astype(float), first, 4000)
    want = exact(weights(a), weights(b))
    cut = lambda i: (h[first[i] : first[i + 1]], n[first[i] : first[i + 1]])
    assert abs(similarity(*cut(0), *cut(1)) - want) < 1e-9
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_documents(docs, documents, empty):
    got = sorted(((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == classes(documents)
    assert near_duplicates(empty).count() == 0
    kept = one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and {30, 31, 32} <= set(ids) and ids.count(40) == 0 and 22 not in ids and {0, 5, 33, 35} <= set(ids)


def test_hard_group(spark, prose):
    """Many edits of one text, most pairs under the threshold: classes are those of all links."""
    base, rng, items = prose(80, 11).split(), random.Random(2), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(80)] = f"edit{rng.randrange(6)}"
        items.append((i, " ".join(words)))
    df = spark.createDataFrame(items, "doc_id long, text string")
    want = classes(items)
    assert 1 < len({c for _, c in want}) < 150
    for block in (2048, 20):
        assert sorted(((r.doc_id, r.class_id) for r in near_duplicates(df, block=block).collect()), key=str) == want


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    for few in (0, 20_000):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), few=few).collect()}
        assert got == {x: find(x) for x in root}
        assert components(spark.createDataFrame([], "u long, v long"), few=few).count() == 0


@pytest.mark.parametrize("block", [12])
def test_a_growing_family(spark, prose, monkeypatch, block):
    """Edits of one text of which few are alike: classes are those of all links, and the nodes that go to tasks stay within
    the bands of each, however many edits there are."""
    counts = {}
    kept = module.stage

    def counting(df, label):
        out = kept(df, label)
        if label == "units":
            counts[len(items)] = out.count()
        return out

    monkeypatch.setattr(module, "stage", counting)
    base = prose(90, 21).split()
    for n in (30, 60):
        rng, items = random.Random(n), []
        for i in range(n):
            words = list(base)
            for _ in range(rng.randint(1, 7)):
                words[rng.randrange(90)] = f"edit{rng.randrange(9)}"
            items.append((i, " ".join(words)))
        df = spark.createDataFrame(items, "doc_id long, text string")
        assert sorted(((r.doc_id, r.class_id) for r in near_duplicates(df, block=block).collect()), key=str) == classes(items)
    assert all(c <= 25 * n for n, c in counts.items()) and counts.get(60, 0) <= 5 * counts.get(30, 1e9)
