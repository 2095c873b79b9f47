import numpy as np
import pyarrow as pa
import pytest

from logfathom.llm.toxicity import fit, grade_documents, grades, reject_toxic, severities, train, words_present


def test_thresholds_share_weights(prose):
    texts, y = [], []
    for i in range(400):
        g = i % 3
        texts.append(prose(40, i) + " mild" * (g == 1) + " Awful! vile," * (g == 2))
        y.append(g)
    doc, h = words_present(pa.array(texts))
    m = train(doc, h, np.array(y))
    assert len(m.words) <= 6 and (np.diff(m.thresholds) > 0).all()
    over = severities(*words_present(pa.array(["mild", "awful vile", "calm", "", None])), 5, m)
    severity = over.sum(axis=1)
    assert severity[1] > 1.5 > severity[0] > 0.5 > severity[2] == severity[3] == severity[4]
    assert (over[:, 0] >= over[:, 1]).all()


def test_degenerate():
    none = train(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert severities(*words_present(pa.array(["x"])), 1, none).sum() < 1e-9
    only = train(*words_present(pa.array(["x", "y"])), np.array([2, 2]))
    assert abs(severities(*words_present(pa.array(["z"])), 1, only).sum() - 2) < 1e-9


def test_documents(spark, docs, documents, empty, prose):
    texts = [(100 + i, prose(30, i) + (" scoundrel" if i % 4 == 0 else "")) for i in range(200)]
    train_docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, i % 7 and 1, int(i % 4 == 0)) for i in range(200)] + [(100, 1, 0), (None, 1, 1), (101, None, None)], "doc_id long, quality int, toxic int")
    m = fit(train_docs, grades(labels))
    got = {r.doc_id: r for r in grade_documents(train_docs, m).collect()}
    assert all(got[100 + i].toxic == (i % 4 == 0) for i in range(200))
    assert grade_documents(docs, m).filter("toxic").count() == 0 and grade_documents(docs, m).count() == len(documents)
    kept = reject_toxic(train_docs, m)
    assert kept.count() == 150 and kept.columns == train_docs.columns
    assert reject_toxic(docs, m).columns == docs.columns and reject_toxic(empty, m).count() == 0
    assert grade_documents(empty, m).count() == 0
    assert len(fit(train_docs, grades(labels).limit(0)).words) == 0


def test_no_toxic_labels(spark, prose):
    """Without labels of the top grade nothing is toxic, however low its quality; a grade alone says only itself."""
    texts = [(i, prose(30, i) + (" spam" * 3 if i % 2 else "")) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for low in (lambda i: i % 2, lambda i: 1, lambda i: 0):
        labels = spark.createDataFrame([(i, 1 - low(i), 0) for i in range(200)], "doc_id long, quality int, toxic int")
        m = fit(df, grades(labels))
        assert len(m.thresholds) == 2
        assert all(abs(r.severity - low(r.doc_id)) < 0.5 and not r.toxic for r in grade_documents(df, m).collect())
        assert reject_toxic(df, m).count() == 200
    assert len(fit(df, grades(labels).limit(0)).thresholds) == 2
    with pytest.raises(ValueError, match="grade 3"):
        fit(df, spark.createDataFrame([(1, 3)], "doc_id long, grade int"))


def test_against_a_plain_fit():
    """Thresholds and shared weights of a maximum-likelihood fit by numeric gradients, on counts of a few kinds of texts."""
    rng = np.random.default_rng(0)
    words, true = np.array([11, 12, 13], np.uint64), np.array([1.5, 2.5, -1.0])
    x = rng.random((900, 3)) < 0.4
    latent = x @ true + rng.logistic(size=900)
    y = (latent > 0.5).astype(int) + (latent > 3)
    doc, at = np.nonzero(x)
    m = train(doc, words[at], y, l2=0.0, steps=3000)

    def loss(v):
        theta = np.array([v[3], v[3] + np.exp(v[4])])
        below = np.column_stack([np.zeros(900), 1 / (1 + np.exp(x @ v[:3] - theta[0])), 1 / (1 + np.exp(x @ v[:3] - theta[1])), np.ones(900)])
        return -np.log(below[np.arange(900), y + 1] - below[np.arange(900), y]).mean()

    v = np.zeros(5)
    for _ in range(4000):
        slope = np.array([(loss(v + 1e-5 * e) - loss(v - 1e-5 * e)) / 2e-5 for e in np.eye(5)])
        v -= 1.0 * slope
    assert m.words.tolist() == [11, 12, 13]
    assert np.abs(m.weights - v[:3]).max() < 0.05 and np.abs(m.thresholds - [v[3], v[3] + np.exp(v[4])]).max() < 0.05


def test_held_out(spark, prose):
    """Graded on documents that the fit has not seen; one in ten labels is wrong, none of which is learned."""
    kind = lambda i: (i * 7919) % 5
    text = lambda i: prose(40, i) + {0: "", 1: "", 2: "", 3: " shoddy spam", 4: " vile wretch"}[kind(i)]
    df = spark.createDataFrame([(i, text(i)) for i in range(900)], "doc_id long, text string")
    grade = lambda i: {3: 1, 4: 2}.get(kind(i), 0) if i % 10 else (i // 10) % 3
    m = fit(df, spark.createDataFrame([(i, grade(i)) for i in range(600)], "doc_id long, grade int"))
    got = {r.doc_id: r for r in grade_documents(df.filter("doc_id >= 600"), m).collect()}
    assert all(r.toxic == (kind(i) == 4) for i, r in got.items())
    assert np.mean([abs(r.severity - {3: 1, 4: 2}.get(kind(i), 0)) for i, r in got.items()]) < 0.4
