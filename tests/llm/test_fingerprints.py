import hashlib

import numpy as np
import pyarrow as pa

from logfathom.llm._words import text_bytes
from logfathom.llm.oph_fingerprint import fingerprint_documents, fingerprints, likeness


def sets(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_are_unbiased(prose):
    errors = []
    for size in (30, 300, 3000):
        for i in range(12):
            words = prose(size, 100 + i).split()
            other = words[: size * (i + 1) // 13] + prose(size, 200 + i).split()[: size - size * (i + 1) // 13]
            a, b = " ".join(words), " ".join(other)
            fp, has = fingerprints(*text_bytes(pa.array([a, b])))
            x, y = sets(a), sets(b)
            errors.append(likeness(fp[:1], fp[1:], has[:1], has[1:])[0] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_documents(docs, documents, empty):
    items = [x for x in documents if x[0] not in (40, 41, None)]
    got = {r.doc_id: r for r in fingerprint_documents(docs.filter("doc_id not in (40, 41)")).collect()}
    order = sorted(items, key=lambda x: -x[0])
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        x, y = sets(t), sets(edited)
        want = 1.0 if not x and not y else len(x & y) / len(x | y)
        assert abs(got[i].near_edited - want) < 0.2 and 0 <= got[i].near_next <= 1
    assert got[20].fingerprint == got[21].fingerprint == got[2].fingerprint and got[20].near_next < 0.2 and got[21].near_next == 1
    assert got[30].fingerprint == got[32].fingerprint == ""
    assert fingerprint_documents(docs).count() == len(documents)
    assert fingerprint_documents(empty).count() == 0
    single = fingerprint_documents(docs.filter("doc_id = 3")).collect()[0]
    assert single.near_next == 1
