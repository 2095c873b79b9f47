import hashlib

import pytest

from logfathom.llm.substring_dedup import dedup_passages, without_repeats


def brute(items, window=20):
    """Rows in order of doc_id (nulls last), each window's words looked up among all earlier ones."""
    seen, out = {}, {}
    for key in sorted({(i is None, i or 0, t or "") for i, t in items}):
        words = key[2].encode().split()
        for s in range(len(words) - window + 1):
            seen.setdefault(tuple(words[s : s + window]), (key, s))
    for i, t in items:
        key, words = (i is None, i or 0, t or ""), (t or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s : s + window])] != (key, s):
                gone |= set(range(s, s + window))
        out.setdefault(i, []).append((i, len(words), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()))
    return sorted((x for v in out.values() for x in v), key=str)


def test_against_brute_force(docs, documents, empty):
    # Rows of one doc_id and different texts are ordered by a hash, which brute force does not know: left out here.
    items = [x for x in documents if x[0] not in (41, None)]
    some = docs.filter("doc_id <> 41")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_passages(some).collect()), key=str)
    assert got == brute(items)
    assert sum(x[2] for x in got) > 100
    assert dedup_passages(empty).count() == 0
    assert dedup_passages(docs).count() == len(documents)
    with pytest.raises(ValueError):
        dedup_passages(docs, 7)


@pytest.mark.parametrize("buckets", [1, 7])
def test_buckets_do_not_matter(docs, buckets):
    rows = lambda n: sorted(map(tuple, dedup_passages(docs.filter("doc_id <> 41"), buckets=n).collect()))
    assert rows(buckets) == rows(3)


def test_stage(docs, documents):
    got = without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(documents)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text == dict(documents)[0] and rows[20].text == "" and rows[20].n_chars == 0 and rows[20].th == "th"


def test_hot_passages_over_slices_and_tasks(spark, prose, monkeypatch):
    """A passage in every document, tasks of many slices: each task sends a repeated hash once, and rows stay right."""
    from logfathom.llm import substring_dedup as module

    passage = prose(45, 1)
    items = [(i, f"{prose(15 + i % 7, 100 + i)} {passage} {prose(5, 900 + i)}" + (f" {passage}" if i % 5 == 0 else "")) for i in range(240)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(2)
    want = sorted(brute(items), key=str)
    for slice_, held in ((4_000_000, 2_000_000), (2_000, 2_000_000), (2_000, 50)):
        monkeypatch.setattr(module, "_SLICE", slice_)
        monkeypatch.setattr(module, "_HELD", held)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_passages(df, buckets=3).collect()), key=str)
        assert got == want
    assert sum(x[2] for x in want) > 240 * 40


def test_what_a_task_has_sent():
    import numpy as np

    from logfathom.llm.substring_dedup import _Seen

    seen = _Seen(1)
    seen.add(np.array([5, 3], np.uint64), np.array([[1], [0]]))
    seen.add(np.array([5], np.uint64), np.array([[0]]))
    held, at = seen.find(np.array([3, 4, 5, 9], np.uint64))
    assert held.tolist() == [True, False, True, False] and seen.values[at[held], 0].tolist() == [0, 0]
