import itertools

import numpy as np
import pytest

from logfathom.llm import mixing
from logfathom.llm.mixing import Rates, mix, mixed, project, solve, whole_copies

WEIGHTS = {"good": 0.7, "low": 0.3}


def corpus(spark, prose):
    texts = [(i, prose(50, i) if i % 3 else " ".join(f"{w}###" for w in prose(50, i).split())) for i in range(90)]
    labels = [(i, "low" if i % 3 == 0 else "good") for i in range(60)] + [(3, "low"), (None, "good"), (4, None), (5, "else")]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_targets(spark, prose):
    docs, labels = corpus(spark, prose)
    rows = mix(docs, labels, WEIGHTS).collect()
    assert len(rows) == 90 and all(r.rate >= 0 for r in rows)
    total = sum(r.tokens for r in rows)
    for d, w in WEIGHTS.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) - w * total) < 1e-4 * total
    assert all((r.p_low > 0.5) == (r.doc_id % 3 == 0) for r in rows)  # the unlabelled ones too
    assert all(abs(r.copies - r.rate) < 1 + 1e-4 for r in rows)


def test_copies_keep_the_totals(spark):
    """Lengths from 1 to 20,000 and rates of all kinds: no domain's tokens are off by more than two of its longest texts."""
    rng = np.random.default_rng(4)
    n = 3000
    p, t = np.eye(3)[rng.integers(0, 3, n)], np.exp(rng.uniform(0, 10, n)).astype(int)
    t[0], rate = 0, rng.uniform(0, 3, n) * (rng.random(n) < 0.8)
    df = spark.createDataFrame([(i if i else None, int(t[i]), [float(x) for x in p[i]], float(rate[i])) for i in range(n)], "doc_id long, tokens long, p array<double>, rate double")
    rows = {r.doc_id or 0: r for r in whole_copies(df).collect()}
    copies = np.array([rows[i].copies for i in range(n)])
    assert np.abs(copies - rate).max() < 1 + 1e-4 and copies.min() >= 0
    for d in range(3):
        own = p[:, d] > 0
        assert abs(((copies - rate) * t)[own].sum()) < 2 * t[own].max()
    assert [r.copies for r in whole_copies(df.repartition(7)).orderBy("doc_id").collect()] == [r.copies for r in whole_copies(df).orderBy("doc_id").collect()]


def members(spark, p, t):
    rows = [(i, int(t[i]), [float(x) for x in p[i]]) for i in range(len(p))]
    return spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>").coalesce(2)


def least_distance(a, b):
    """Brute force for three domains: the nearest point to b of the cone of the columns of a is in the span of three, two
    or one of them, or 0."""
    best = np.linalg.norm(b)
    for n in (1, 2, 3):
        for columns in itertools.combinations(range(a.shape[1]), n):
            x = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (x >= -1e-12).all():
                best = min(best, np.linalg.norm(a[:, columns] @ x - b))
    return best


@pytest.mark.parametrize("target", [[3000, 10, 0], [4000, 0, 0], [100, 100, 3000], [900, 800, 700], [0, 0, 0]])
def test_against_brute_force(spark, target):
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet([0.5, 0.5, 0.5], 40), rng.integers(10, 200, 40)
    df, goal = members(spark, p, t), np.array(target, float)
    want = least_distance((t[:, None] * p).T, goal)
    rates, left, proved = solve(df, target)
    x = rates.of(p)
    assert proved and x.min() >= 0 and abs(np.linalg.norm((t * x) @ p - goal) - want) < 1e-4 * max(goal.sum(), 1)
    got = np.array([r.x for r in df.select("doc_id", rates.column().alias("x")).orderBy("doc_id").collect()])
    assert np.abs(got - x).max() < 1e-9 * max(1, x.max())


def test_projected_gradient(spark):
    """Targets within reach are met by it alone; every step brings the totals nearer; equal posteriors keep equal rates."""
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet([0.5, 0.5, 0.5], 40).round(1), rng.integers(10, 200, 40)
    p[:, 2] = 1 - p[:, 0] - p[:, 1]
    goal = (t[:, None] * p).sum(axis=0) * [1.2, 0.9, 0.7]
    rates, at = project(members(spark, p, t), goal, 1e-3)
    assert np.abs(at - goal).max() <= 1e-3 and 0 < len(rates.steps) < 40 and rates.share == 1 and not rates.corners
    assert np.abs((t * rates.of(p)) @ p - at).max() < 1e-6
    off = [np.linalg.norm((t * Rates(rates.steps[:i]).of(p)) @ p - goal) for i in range(len(rates.steps) + 1)]
    assert all(b <= a + 1e-9 for a, b in zip(off, off[1:], strict=False))


@pytest.mark.parametrize(("spread", "weights"), [(0.5, [0.98, 0.01, 0.01]), (0.5, [0.2, 0.2, 0.6]), (2.0, [0.001, 0.001, 0.998])])
def test_targets_far_from_shares(spark, spread, weights):
    """Targets that can be met are, however many rates become 0; for others no document's rate can better the distance."""
    rng = np.random.default_rng(5)
    n = [1680, 200, 120]
    p = np.vstack([rng.dirichlet(spread / 2 + 2 * np.eye(3)[d], n[d]) for d in range(3)])
    t = np.exp(rng.normal(5, 1, len(p))).round() + 1
    goal = np.array(weights)
    rates, left, proved = solve(members(spark, p, t), (goal * t.sum()).tolist())
    x = rates.of(p)
    off = (t * x) @ p / t.sum() - goal
    assert proved and abs(np.linalg.norm(off) - left) < 1e-8
    if left > 1e-6:
        assert (p @ off).min() > -1e-6 and abs(off @ (goal + off)) < 1e-6
    else:
        assert np.abs(off).max() < 2e-6
    if weights[0] == 0.2:
        assert left <= 1e-6


def test_unproved_rates_raise(spark, prose, monkeypatch):
    docs, labels = corpus(spark, prose)
    monkeypatch.setattr(mixing, "solve", lambda *a: (Rates(), 0.25, False))
    with pytest.raises(RuntimeError, match="0.25"):
        mix(docs, labels, WEIGHTS)


def test_edges(docs, documents, empty, spark):
    labels = spark.createDataFrame([(0, "good"), (37, "low")], "doc_id long, domain string")
    assert mix(docs, labels, WEIGHTS).count() == len(documents)
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mix(docs, none, WEIGHTS).count() == len(documents)
    assert mix(empty, labels, WEIGHTS).count() == 0
    assert mixed(docs, labels, WEIGHTS).columns == docs.columns
