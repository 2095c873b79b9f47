import math
import random
from collections import Counter

import numpy as np
import pytest

from logfathom.llm import dual_tree as module
from logfathom.llm.dual_tree import Best, Items, kd_order, rank_documents, search
from tests.llm.test_decontamination import words


def brute(docs, items, k=10):
    terms = [(doc, words(text)) for doc, text in docs if words(text)]
    n_docs, length = len(terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    counts = [(doc, len(w), Counter(w)) for doc, w in terms]
    weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    mine, out = {}, []
    for item, text in dict.fromkeys(items):
        mine.setdefault(item, []).extend(words(text))
    for item, query in mine.items():
        scored = []
        for doc, n, tf in counts:
            m = 25 + 75 * n * n_docs // length
            s = sum(weight(t) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in query if t in tf)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(documents, prose):
    texts = dict(documents)
    return [(i, " ".join(texts[i % 12].split()[i : i + 20])) for i in range(14)] + [
        (50, None), (51, ""), (52, "?"), (53, "notaword"), (54, "word word WORD"), (55, "日本"), (None, prose(30, 3)), (56, prose(9, 1)), (56, prose(9, 1)), (57, prose(9, 1)), (57, prose(9, 2)),
    ]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(*x, 1, 2, 3) for x in items], "item_id long, text string, rank int, score long, item int").repartition(2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("group,tree,item_bytes,seed", [(256, 4096, 16_000_000, 20_000), (4, 8, 900, 7)])
def test_against_brute_force(docs, documents, benchmark, items, empty, monkeypatch, group, tree, item_bytes, seed):
    """Also with many trees, several passes and a first search."""
    for name, value in (("_GROUP", group), ("_TREE", tree), ("_ITEM_BYTES", item_bytes), ("_SEED", seed)):
        monkeypatch.setattr(module, name, value)
    got = rank_documents(docs, benchmark)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows(got) == brute(documents, items)
    assert rows(rank_documents(docs, benchmark, 3)) == brute(documents, items, 3)
    assert rank_documents(empty, benchmark).count() == 0 and rank_documents(docs, benchmark.limit(0)).count() == 0


def test_ties_go_by_doc_id(spark):
    docs = [(i, f"tie tie number{i % 2} other") for i in range(40, 0, -1)] + [(None, "tie tie number1 other"), (5, "tie tie number1 other")]
    items = [(1, "tie"), (2, "number1"), (3, "tie number1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows(rank_documents(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def sparse(r, rows_, columns, share):
    cells = [(i, j, r.randint(1, 900)) for i in range(rows_) for j in range(columns) if r.random() < share * (1 + (i + j) % 3)]
    return [np.array(x, np.int64) for x in zip(*cells, strict=True)]


@pytest.mark.parametrize("seed,times", [(1, 1), (2, 1), (3, 10**10)])
def test_the_trees_prune_exactly(seed, times):
    """times: weights so large that products leave the exact range of doubles."""
    r = random.Random(seed)
    item, term, weight = sparse(r, 30, 60, 0.08)
    doc, at, impact = sparse(r, 500, 60, 0.05)
    tree = Items.of(np.arange(30), item, term, weight * times)
    best = Best(30, 5, np.zeros(30, np.int64))
    scored, pairs = search(tree, best, np.arange(1000, 1500), np.zeros(500, bool), doc, at, impact)
    assert 0 < scored < pairs
    q, d = np.zeros((30, 60), np.int64), np.zeros((500, 60), np.int64)
    q[item, term], d[doc, at] = weight * times, impact
    s = d @ q.T
    for i in range(30):
        order = np.lexsort((np.arange(500), -s[:, i]))[:5]
        want = [(int(s[j, i]), 1000 + int(j)) for j in order if s[j, i] > 0]
        assert [(a, b) for a, b in zip(best.score[i].tolist(), best.doc[i].tolist(), strict=True) if a] == want


def test_kd_order():
    r = random.Random(5)
    row, column, value = sparse(r, 103, 20, 0.1)
    assert sorted(kd_order(103, row, column, value.astype(float), 8).tolist()) == list(range(103))
    assert kd_order(0, row[:0], column[:0], value[:0].astype(float), 8).tolist() == []
