"""Toxicity grades by cumulative-link ordinal regression on the words a text has.

P(grade <= k) = logistic(threshold_k - w . x): all thresholds share one weight vector over words present (case-folded
ASCII, punctuation dropped). The expected severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm._shared import stage
from logfathom.llm._words import slices, text_bytes, word_hashes, word_spans

_FOLD = np.array([b if b > 127 else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


#: The top grade of the label scheme, see grades(); in how many documents a word must be to be learned.
TOXIC, LEAST_DOCS = 2, 3


def least_gain(words: int) -> float:
    """The likelihood-ratio statistic over which a word's association counts, one of so many that are tried."""
    return float(2 * np.log(max(2, words)) + 6)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades


def words_present(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word hash) pairs of a batch, in text order."""
    data, offsets = text_bytes(column)
    data = _FOLD[data]
    starts, ends, first = word_spans(data, offsets)
    h, doc = word_hashes(data, starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc, h


def severities(doc: np.ndarray, h: np.ndarray, docs: int, model: Model) -> np.ndarray:
    """P(grade > k), one row for each text and one column for each threshold."""
    score = np.zeros(docs)
    if len(model.words):
        at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
        hit = model.words[at] == h
        pairs = np.unique(doc[hit] * len(model.words) + at[hit])
        np.add.at(score, pairs // len(model.words), model.weights[pairs % len(model.words)])
    return 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - score[:, None], -500, 500)))


def train(doc: np.ndarray, h: np.ndarray, grades: np.ndarray, least_docs: int = LEAST_DOCS, l2: float = 1e-5, steps: int = 800, top: int | None = None) -> Model:
    """Fit by Adam on all rows. Words enter if they are in ``least_docs`` texts and their association with any grade
    boundary is significant (likelihood-ratio
    statistic over least_gain()), so that the many words of few texts don't. ``top`` is the scheme's highest grade (None:
    that of the rows); no text is over a threshold that no row is over."""
    kinds = np.unique(grades)
    seen = int(kinds.max()) if len(kinds) else 0
    beyond = [np.inf] * ((seen if top is None else top) - seen)
    top = seen
    if len(kinds) < 2:  # nothing to tell apart: the one grade for every text
        level = int(kinds[0]) if len(kinds) else 0
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([-50.0] * level + [50.0] * (max(top, 1) - level) + beyond[max(1 - top, 0) :]))
    words, index = np.unique(h, return_inverse=True)
    pairs = np.unique(doc * len(words) + index)
    doc, index = pairs // len(words), pairs % len(words)
    n, df = len(grades), np.bincount(index, minlength=len(words)).astype(float)
    best = np.zeros(len(words))
    for k in range(top):
        over = (grades > k).astype(float)
        a, p = np.bincount(index, over[doc], len(words)), over.mean()
        if 0 < p < 1:
            gain = a * np.log(np.maximum(a, 1e-9) / (df * p)) + (df - a) * np.log(np.maximum(df - a, 1e-9) / (df * (1 - p)))
            best = np.maximum(best, 2 * gain)
    good = (df >= least_docs) & (best > least_gain((df >= least_docs).sum()))
    new = np.cumsum(good) - 1
    keep = good[index]
    doc, index, words = doc[keep], new[index[keep]], words[good]
    x = np.zeros(len(words) + top)
    share = np.clip([(grades <= k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    x[len(words) :] = np.log(share / (1 - share))
    weight = 1 / n
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, theta = x[: len(words)], np.concatenate(([-np.inf], np.maximum.accumulate(x[len(words) :]), [np.inf]))
        s = np.bincount(doc, w[index], n)
        upper, lower = 1 / (1 + np.exp(np.clip(s - theta[grades + 1], -500, 500))), 1 / (1 + np.exp(np.clip(s - theta[grades], -500, 500)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        g = np.concatenate([np.bincount(index, (du - dl)[doc], len(words)) + l2 * w, [dl[grades == k + 1].sum() - du[grades == k].sum() for k in range(top)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(words, x[: len(words)], np.concatenate([np.maximum.accumulate(x[len(words) :]), beyond]))


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = 4000, top: int = TOXIC, vocabulary: int = 1 << 16, pairs: int = 8_000_000) -> Model:
    """Fit on at most ``per_grade`` labelled documents of each grade, those with the smallest hashes of doc_id.

    labels: doc_id and grade (0, 1 ... ``top``, which is toxic; a higher one is an error, negative ones and nulls are left
    out). Without labels of the top grade no text is toxic. Of several labels of one doc_id the highest counts. Words are
    counted and chosen, as train() does, by Spark; the driver receives which of the chosen ones (``vocabulary`` at most,
    the most telling, and so many that documents have ``pairs`` of them in all, 8 bytes each) each sampled document has. The sample bounds only the fit; the model is applied to everything.
    """
    graded = labels.filter("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    highest = graded.agg(F.max("grade")).first()[0]
    if highest is not None and highest > top:
        raise ValueError(f"grade {highest} is over {top}, the highest of the scheme")
    if highest is None:
        return train(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), top=top)
    picks = [graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade) for g in range(highest + 1)]
    sample = reduce(DataFrame.union, picks)  # at most per_grade rows a grade: small enough to broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for x in batches for part in slices(x, "text")):
            doc, h = words_present(batch.column("text"))
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
            doc, h = doc[new], h[new]
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))], names=["grade", "words"])

    rows = stage(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("grade", "text").mapInArrow(extract, "grade int, words array<long>"), "toxicity-sample")
    sizes = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    total, kept = sum(sizes.values()), np.zeros(0, np.int64)
    if len(sizes) > 1:
        counts = rows.select("grade", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *[F.count_if(F.col("grade") > k).alias(f"over_{k}") for k in range(highest)])
        counts = stage(counts.filter(F.col("n") >= LEAST_DOCS), "toxicity-words")
        n, gains = F.col("n").cast("double"), []
        for k in range(highest):
            a, share = F.col(f"over_{k}").cast("double"), sum(c for g, c in sizes.items() if g > k) / total
            if 0 < share < 1:
                gains.append(2 * (a * F.log(F.greatest(a, F.lit(1e-9)) / (n * share)) + (n - a) * F.log(F.greatest(n - a, F.lit(1e-9)) / (n * (1 - share)))))
        best = counts.withColumn("gain", F.greatest(*gains, F.lit(0.0)))
        chosen = best.filter(F.col("gain") > least_gain(counts.count())).orderBy(F.desc("gain"), "w").limit(vocabulary)
        found = chosen.select("w", "n").collect()
        fits = np.cumsum([r["n"] for r in found]) <= pairs
        kept = np.sort(np.array([r["w"] for r, fit_ in zip(found, fits.tolist(), strict=True) if fit_], np.int64))

    def of_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.intersect1d(np.array(x, np.int64), kept).tobytes() for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(words, pa.binary())], names=["grade", "words"])

    got = rows.mapInArrow(of_kept, "grade int, words binary").toArrow()
    each = [np.frombuffer(x, np.uint64) for x in got.column("words").to_pylist()]
    order = sorted(range(len(each)), key=lambda i: (got.column("grade")[i].as_py(), each[i].tobytes()))  # whatever order rows came in
    grades = np.array([got.column("grade")[i].as_py() for i in order], np.int64)
    each = [each[i] for i in order]
    return train(np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate([np.zeros(0, np.uint64), *each]), grades, top=top)


def grade_documents(docs: DataFrame, model: Model, flag_over: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (that of the top grade), toxic (p_toxic > flag_over); a row for each row of docs.

    A text without words (null, empty) has the severity of a text with none of the model's words. Null and repeated
    doc_ids stay. Extra columns are ignored; an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for x in batches for part in slices(x, "text")):
            over = severities(*words_present(batch.column("text")), batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(over.sum(axis=1)), pa.array(over[:, -1]), pa.array(over[:, -1] > flag_over)], names=["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, severity double, p_toxic double, toxic boolean")


def reject_toxic(docs: DataFrame, model: Model, flag_over: float = 0.5) -> DataFrame:
    """The rows of docs that grade_documents() does not flag, with all their columns. A null or empty text is flagged no
    more than any without the model's words; repeated rows share a fate; an empty table gives no rows."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for x in batches for part in slices(x, "text")):
            over = severities(*words_present(batch.column("text")), batch.num_rows, model)
            yield batch.filter(pa.array(~(over[:, -1] > flag_over)))

    return docs.mapInArrow(keep, docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Severity grades of the labels table: 0 neither, 1 of low quality only, 2 toxic; a row with null toxic has none.

    Toxic is the top grade: a text with more of the words that mark it may lie any distance above the last threshold.
    (With the toxic split by quality, which no word predicts, such a text would have to lie between two thresholds.)
    """
    low = F.when(F.col("quality") == 0, 1).otherwise(0)
    return labels.select("doc_id", F.when(F.col("toxic") == 1, TOXIC).when(F.col("toxic") == 0, low).alias("grade"))
