"""Ranked lexical search by dual trees: the k best documents of every item, exactly.

A document is a vector over the items' terms, its coordinates the terms' impacts 1000000000 tf / (1000 tf + 8 m); an item
is one of its terms' weights times their counts; the score is their product. Items and documents are both put into
hierarchies by splitting at the median of the coordinate that varies most, and every node holds the maxima of its
coordinates. The product of two nodes' maxima bounds every score of a document of the one and an item of the other: where
it is under the weakest k-th score of the node's items so far, the pair goes with all that is below it. What is left at the
leaves is scored in exact integers.

The texts are read once, into vectors that hold the items' terms alone. Spark deals those out; a task searches trees of
some thousand documents with the scores it has so far, starting from those of a first search in a bounded sample (any lower
bound of a k-th score prunes exactly), and gives k rows an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm._shared import stage
from logfathom.llm._words import slices, term_hashes, text_bytes

_SLICE = 4_000_000  # bytes of text that are turned into terms at once
_ITEM_BYTES = 16_000_000  # bytes of items searched in one pass
_GROUP = 256  # items of a tree
_TREE = 4096  # documents of a tree
_NARROW, _WIDE = 4, 16  # items (or nodes), documents of a leaf
_SEED = 20_000  # documents of the first search, about
_LAST = (1 << 63) - 1


def kd_order(count: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, leaf: int) -> np.ndarray:
    """Rows 0 .. count - 1 of a sparse table (row, column, value) in an order whose runs of ``leaf`` rows are alike: split at
    the median of the column that varies most, and so on in both halves."""
    width = int(column.max(initial=-1)) + 1
    out: list[np.ndarray] = []
    stack = [(np.arange(count), row, column, value)]
    while stack:
        rows, r, c, v = stack.pop()
        if len(rows) <= leaf or not len(c):
            out.append(rows)
            continue
        spread = np.bincount(c, v * v, width) - np.bincount(c, v, width) ** 2 / len(rows)
        own = c == int(np.argmax(spread))
        at = np.zeros(count)
        at[r[own]] = v[own]
        half = max(leaf, len(rows) // 2 // leaf * leaf)
        order = np.argsort(-at[rows], kind="stable")
        side = np.zeros(count, bool)
        side[rows[order[:half]]] = True
        left = side[r]
        stack.append((rows[order[half:]], r[~left], c[~left], v[~left]))
        stack.append((rows[order[:half]], r[left], c[left], v[left]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Items:
    """A tree of items: weights over the columns that stand for their own terms, rows in tree order; nodes are the root, and
    leaves of some rows each."""

    number: np.ndarray  # of each row, in the pass
    terms: np.ndarray  # of each column, ascending
    weights: np.ndarray
    leaves: np.ndarray  # maxima by leaf
    begin: np.ndarray  # of each leaf's rows, and the end
    top: np.ndarray

    @staticmethod
    def of(number: np.ndarray, item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Items:
        terms, column = np.unique(term, return_inverse=True)
        dense = np.zeros((len(number), len(terms)))
        dense[item, column.reshape(-1)] = weight
        order = kd_order(len(number), item, column.reshape(-1), weight.astype(float), _NARROW)
        dense, begin = dense[order], np.arange(0, len(order), _NARROW)
        leaves = np.maximum.reduceat(dense, begin, axis=0)
        return Items(number[order], terms, dense, leaves, np.append(begin, len(order)), leaves.max(axis=0))


class Best:
    """The k best (score, document) of each item so far, and a k-th score that is known to be reached."""

    def __init__(self, items: int, k: int, known: np.ndarray):
        self.k, self.known = k, known
        self.score, self.doc, self.none = np.zeros((items, k), np.int64), np.full((items, k), _LAST), np.ones((items, k), bool)

    def weakest(self, items: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(self.score[items, -1], self.known[items]), 1)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """Candidates that may be among the best; equal scores go by doc_id, null last."""
        some, place = np.unique(item, return_inverse=True)
        item = np.concatenate([place.reshape(-1), np.repeat(np.arange(len(some)), self.k)])
        score, doc, none = np.concatenate([score, self.score[some].ravel()]), np.concatenate([doc, self.doc[some].ravel()]), np.concatenate([none, self.none[some].ravel()])
        order = np.lexsort((doc, none, -score, item))
        first = np.searchsorted(item[order], np.arange(len(some)))
        pick = order[first[:, None] + np.arange(self.k)]
        self.score[some], self.doc[some], self.none[some] = score[pick], doc[pick], none[pick]


def _visit(items: Items, levels: list[np.ndarray], level: int, node: int, groups: np.ndarray, weakest: list, score) -> None:
    """The pairs below a node of the document tree and some leaves of the item tree."""
    maxima = levels[level][node]
    if len(groups) == len(items.leaves) and maxima @ items.top < min(weakest[0](g) for g in groups.tolist()):
        return
    bounds = items.leaves[groups] @ maxima
    groups = groups[bounds >= [weakest[0](g) for g in groups.tolist()]]
    if not len(groups):
        return
    if level == 0:
        score(node, groups)
        return
    children = np.arange(node * _NARROW, min((node + 1) * _NARROW, len(levels[level - 1])))
    worth = (levels[level - 1][children] @ items.leaves[groups].T).max(axis=1)
    for child in children[np.argsort(-worth, kind="stable")].tolist():
        _visit(items, levels, level - 1, child, groups, weakest, score)


def search(items: Items, best: Best, doc: np.ndarray, none: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[int, int]:
    """Offer best all documents (doc: ids, none: whether null; row, term, impact: their coordinates) that may be among the k
    best of an item of the tree. Gives the pairs scored and the pairs there were."""
    column = np.minimum(np.searchsorted(items.terms, term), len(items.terms) - 1)
    own = items.terms[column] == term
    have, row = np.unique(row[own], return_inverse=True)
    row, column, impact, doc, none = row.reshape(-1), column[own], impact[own].astype(float), doc[have], none[have]
    if not len(have):
        return 0, 0
    order = kd_order(len(have), row, column, impact, _WIDE)
    place = np.argsort(order)
    row, doc, none = place[row], doc[order], none[order]
    by_row = np.argsort(row, kind="stable")
    row, column, impact = row[by_row], column[by_row], impact[by_row]
    starts = np.searchsorted(row, np.arange(0, len(have) + _WIDE, _WIDE))
    leaves = np.zeros((-(-len(have) // _WIDE), len(items.terms)))
    np.maximum.at(leaves, (row // _WIDE, column), impact)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), _NARROW), axis=0))
    exact = items.weights.sum(axis=1).max() * 1_000_000 < 1 << 53  # or products are made of integers
    floor = best.weakest(items.number).astype(float)
    least = np.minimum.reduceat(floor, items.begin[:-1])
    slack = 1.0 if exact else 1 - 1e-9
    scored = 0

    def score(leaf: int, groups: np.ndarray) -> None:
        nonlocal scored
        a, b = starts[leaf], starts[leaf + 1]
        used, at = np.unique(column[a:b], return_inverse=True)
        count = min(_WIDE, len(have) - leaf * _WIDE)
        dense = np.zeros((count, len(used)))
        dense[row[a:b] - leaf * _WIDE, at.reshape(-1)] = impact[a:b]
        alive = dense @ items.leaves[np.ix_(groups, used)].T >= least[groups] * slack  # document by item leaf
        some, groups = np.flatnonzero(alive.any(axis=1)), groups[alive.any(axis=0)]
        if not len(some):
            return
        rows = np.concatenate([np.arange(items.begin[g], items.begin[g + 1]) for g in groups.tolist()])
        weights = items.weights[np.ix_(rows, used)]
        got = dense[some] @ weights.T if exact else dense[some].astype(np.int64) @ weights.T.astype(np.int64)
        scored += got.size
        i, j = np.nonzero(got >= floor[rows])
        if len(i):
            at_doc = leaf * _WIDE + some[i]
            best.offer(items.number[rows[j]], got[i, j].astype(np.int64), doc[at_doc], none[at_doc])
            floor[rows] = best.weakest(items.number[rows])
            least[groups] = [floor[items.begin[g] : items.begin[g + 1]].min() for g in groups.tolist()]

    _visit(items, levels, len(levels) - 1, 0, np.arange(len(items.leaves)), [lambda g: least[g] * slack], score)
    return scored, len(have) * len(items.number)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """1000000000 tf div (1000 tf + 8 m) with m = 25 + (75 n N) div L, in 64-bit integers (wider where they would overflow)."""
    n = n.astype(np.int64)
    m = 25 + 75 * n * documents // length if 75 * int(n.max(initial=0)) * documents < 1 << 63 else np.array([25 + 75 * x * documents // length for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


def _vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """kind 0: doc_id, n (all terms) and the places in ``terms`` (ascending hashes) of those that the text has, with tf; kind
    1: one row a task, n the sum of all n, tf the number of documents by term, doc_id the number of documents with terms."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)  # at most 16 MB of items' text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shipped.value, ["kind", "doc_id", "n", "term", "tf"]
        df, documents, length = np.zeros(len(own), np.int64), 0, 0
        for batch in (part for x in batches for part in slices(x, "text", _SLICE)):
            h, first = term_hashes(*text_bytes(batch.column("text")))
            place = np.minimum(np.searchsorted(own, h), max(len(own) - 1, 0))
            mine = np.flatnonzero(own[place] == h) if len(own) else np.zeros(0, np.int64)
            text = np.searchsorted(first, mine, "right") - 1
            key, tf = np.unique(text * max(len(own), 1) + place[mine], return_counts=True)
            text, term = key // max(len(own), 1), key % max(len(own), 1)
            df += np.bincount(term, minlength=len(own))
            n = np.diff(first)
            documents, length = documents + int((n > 0).sum()), length + len(h)
            full = np.unique(text)
            ends = pa.array(np.append(np.searchsorted(text, full), len(text)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(full), np.int32)), batch.column("doc_id").take(pa.array(full)), pa.array(n[full]), *lists], names=names)
        if documents:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([documents]), pa.array([length]), pa.array([some.astype(np.int32)]), pa.array([df[some].astype(np.int32)])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, term array<int>, tf array<int>")


def _one_pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item (the item's place in what is collected of them), score, doc_id of each item's k best. items: item_id, text."""
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = term_hashes(*text_bytes(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType
    found: dict = {}
    for r in items.mapInArrow(split, f"item_id {kind.simpleString()}, terms array<long>").toLocalIterator():  # at most _ITEM_BYTES of text
        found.setdefault(r["item_id"], []).append(np.array(r["terms"], np.int64).view(np.uint64))
    ids = list(found)
    words = [np.concatenate(found[i]) for i in ids]
    terms, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
    item = np.repeat(np.arange(len(ids)), [len(w) for w in words])
    key, times = np.unique(item * max(len(terms), 1) + place.reshape(-1), return_counts=True)
    item, term = key // max(len(terms), 1), key % max(len(terms), 1)

    vectors = stage(_vectors(docs, terms), "vectors")
    totals = vectors.filter("kind = 1")
    documents, length = totals.agg(F.sum("doc_id"), F.sum("n")).first()
    pairs = totals.select(F.explode(F.arrays_zip("term", "tf")).alias("t")).groupBy("t.term").agg(F.sum("t.tf").alias("df"))
    df = np.zeros(len(terms), np.int64)
    for r in pairs.toLocalIterator():  # one row for each term of the pass
        df[r["term"]] = r["df"]
    documents, length = documents or 0, length or 1
    w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    weight = (times * w[term] if len(term) else times).astype(np.int64)
    order = kd_order(len(ids), item, term, weight.astype(float), _GROUP)
    trees = []
    for at in range(0, len(order), _GROUP):
        number = order[at : at + _GROUP]
        inner = np.full(len(ids), -1)
        inner[number] = np.arange(len(number))
        mine = np.flatnonzero(inner[item] >= 0)
        if len(mine):
            trees.append(Items.of(number, inner[item[mine]], term[mine], weight[mine]))
    shipped = spark.sparkContext.broadcast(trees)

    def searched(rows: DataFrame, known: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(known), k, known)

            def grow(held: list[pa.RecordBatch]) -> None:
                table = pa.Table.from_batches(held).combine_chunks()
                column = table.column("term").combine_chunks()
                tf = table.column("tf").combine_chunks()
                sizes = np.diff(column.offsets.to_numpy())
                row = np.repeat(np.arange(table.num_rows), sizes)
                value = impacts(tf.flatten().to_numpy(), np.repeat(table.column("n").to_numpy(), sizes), documents, length)
                none = np.array(table.column("doc_id").is_null())
                doc = table.column("doc_id").fill_null(_LAST).to_numpy()
                for tree in shipped.value:
                    search(tree, best, doc, none, row, column.flatten().to_numpy(), value)

            held: list[pa.RecordBatch] = []
            for batch in batches:
                for at in range(0, batch.num_rows, _TREE):
                    held.append(batch.slice(at, _TREE))
                    if sum(b.num_rows for b in held) >= _TREE:
                        grow(held)
                        held = []
            if held:
                grow(held)
            item, rank = np.nonzero(best.score)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(best.score[item, rank]), pa.array(best.doc[item, rank], mask=best.none[item, rank])], names=["item", "score", "doc_id"])

        each = rows.select("doc_id", "n", "term", "tf").mapInArrow(run, "item long, score long, doc_id long")
        ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return each.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    known = np.zeros(len(ids), np.int64)
    some = vectors.filter("kind = 0")
    if documents > 2 * _SEED:
        parts = documents // _SEED
        for r in searched(some.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(parts)) == 0), known).filter(F.col("rank") == k).toLocalIterator():
            known[r["item"]] = r["score"]
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind.simpleString()}")
    return searched(some, known).join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k best documents of each item with a score above 0, exactly; equal
    scores go by doc_id, null last.

    Terms are maximal runs of ASCII digits and letters, A-Z in lower case, and of characters beyond ASCII, of the whole
    texts. With N documents that have a term, L their terms with repeats, n a document's, df the documents with the term and
    tf its count in one: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + (75 n N) div L, and the score is the sum of
    w ((1000000000 tf) div (1000 tf + 8 m)) over the item's terms, repeats included. Null, empty and wordless texts have no
    terms: such a document is never ranked, such an item has no rows. Equal rows of items count once; different texts of one
    item_id are one item (a null item_id is one too). Each row of docs is a document, whatever its doc_id. Extra columns are
    ignored; empty tables give no rows.

    Items are taken in passes of about 16 MB of text, each over all documents, so that what a task holds of them is bounded.
    """
    some = items.select("item_id", "text").filter("text is not null").distinct()
    total = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // _ITEM_BYTES))
    out = None
    for i in range(passes):
        own = some if passes == 1 else some.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        found = _one_pass(docs, own, k)
        out = found if out is None else out.unionByName(found)
    return out
