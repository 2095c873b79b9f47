"""Benchmark decontamination by suffix arrays of the training text.

A shard is about a million words of training text, each word a number. Its suffix array holds the places of all words in
the order of what follows them, as far as the longest benchmark item is long: places are ordered by their first words, then
by what has been ordered already, one, three, nine ... words on, and places that are told apart are not looked at again.

Every suffix of every benchmark item is then searched: it begins with the places of its first word, and each further word
cuts that range by two binary searches, until none is left. The range after ten words is all places of a ten-word window;
the last range that is not empty is the longest verbatim match. No two shards and no two documents meet, so nothing of the
training text is shuffled; the items come to the tasks in blocks of a bounded size, from the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm._shared import fresh_path
from logfathom.llm._words import slices, term_hashes, text_bytes

_SLICE = 8_000_000  # bytes of text that are turned into words at once
_SHARD = 1 << 20  # words of a suffix array
_BLOCK = 8_000_000  # bytes of items searched at once


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of all words (numbers from 1 on; 0 is the end of a text), ordered by at least ``depth`` words from there on,
    or as many as tell them apart."""
    n = len(words)
    bits = max(1, n.bit_length())
    at_once = max(2, 63 // bits)
    rank = np.append(words, 0).astype(np.int64)
    array = np.flatnonzero(words)
    open_, reach = np.arange(len(array)), 1  # slots whose place is not settled
    while len(open_):
        places = array[open_]
        key = rank[places]
        for j in range(1, at_once):
            key = key << bits | rank[np.minimum(places + j * reach, n)]
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        array[open_] = places
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        rank[places] = np.repeat(open_[first], size) + 1
        reach *= at_once
        if reach >= depth:
            break
        open_ = open_[np.repeat(size > 1, size)]
    return array


@dataclass(frozen=True)
class Items:
    """A block of benchmark items as words one after another: each word's hash (0: an item ends), and where a window starts
    its words (0: none starts there) and item."""

    words: np.ndarray
    window: np.ndarray
    owner: np.ndarray
    ids: list[str]


def search(words: np.ndarray, array: np.ndarray, test: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place of test: how many of its words match somewhere, the slots [low, high) of all such longest matches,
    and the slots of all matches of its first ``least`` words. Both arrays number the same words alike; 0 ends a text, and in
    test also stands for a word that the text lacks."""
    counts = np.bincount(words, minlength=int(max(words.max(initial=0), test.max(initial=0))) + 2)
    counts[0] = 0
    begin = np.cumsum(counts) - counts
    low, high = begin[test], begin[test] + counts[test]
    padded, wanted = np.append(words, 0), np.append(test, 0)
    length = np.zeros(len(test), np.int64)
    from_, to = np.zeros(len(test), np.int64), np.zeros(len(test), np.int64)
    live = np.flatnonzero((test > 0) & (high > low))
    depth = 1
    while len(live):
        length[live] = depth
        whole = live[least[live] == depth]
        from_[whole], to[whole] = low[whole], high[whole]
        x = wanted[np.minimum(live + depth, len(test))]
        live, x = live[x > 0], x[x > 0]
        a, b = _cut(padded, array, depth, x, low[live], high[live], False), _cut(padded, array, depth, x, low[live], high[live], True)
        more = b > a
        live = live[more]
        low[live], high[live] = a[more], b[more]
        depth += 1
    return length, low, high, from_, to


def _cut(words: np.ndarray, array: np.ndarray, depth: int, x: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """The first slot of each range whose word at ``depth`` is not under x (not x either, with after)."""
    low, high = low.copy(), high.copy()
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) // 2
        there = words[np.minimum(array[middle] + depth, len(words) - 1)]
        under = there <= x[todo] if after else there < x[todo]
        low[todo[under]] = middle[under] + 1
        high[todo[~under]] = middle[~under]
        todo = todo[low[todo] < high[todo]]
    return low


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All slots of ranges, and which range each is of."""
    size = high - low
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of], of


def _shards(words: np.ndarray, deepest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a long row of words, each with the words that a match may run into."""
    step = max(_SHARD, deepest)
    for at in range(0, max(len(words) - deepest, 1), step):
        yield at, words[at : at + step + deepest]


class _Search:
    """The items of a staged folder, and what a task finds of them."""

    def __init__(self, path: str, blocks: int, deepest: int):
        self.path, self.blocks, self.deepest = path, blocks, deepest
        self.held: list[Items] | None = None

    def items(self) -> Iterator[Items]:
        """Block after block from the shared folder; a single one is kept."""
        if self.held is not None:
            yield from self.held
            return
        where, inner = fs.FileSystem.from_uri(self.path)
        held = []
        for batch in pyarrow.dataset.dataset(inner, filesystem=where, format="parquet").to_batches(batch_size=1):
            for row in range(batch.num_rows):
                words, window, owner = (batch.column(c)[row].values.to_numpy() for c in ("words", "window", "owner"))
                block = Items(words.view(np.uint64), window.astype(np.int64), owner.astype(np.int64), batch.column("ids")[row].as_py())
                if self.blocks == 1:
                    held.append(block)
                yield block
        if self.blocks == 1:
            self.held = held

    def matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[Items, np.ndarray, tuple[np.ndarray, ...]]]:
        """For each shard of the texts whose words have the hashes h and each block of items: the block, the suffix array
        (places in the texts one after another, each with a 0 after it) and search()'s result."""
        ends = first[1:] + np.arange(len(first) - 1)
        row = np.zeros(len(h) + len(first) - 1, np.uint64)
        inked = np.ones(len(row), bool)
        inked[ends] = False
        row[inked] = h
        for at, piece in _shards(row, self.deepest):
            known, words = np.unique(piece, return_inverse=True)
            words = words.reshape(-1) + (0 if len(known) and known[0] == 0 else 1)
            known = known[known > 0]
            if not len(known):
                continue
            array = suffix_array(words, self.deepest)
            for block in self.items():
                place = np.minimum(np.searchsorted(known, block.words), len(known) - 1)
                test = np.where(known[place] == block.words, place + 1, 0)
                yield block, array + at, search(words, array, test, block.window)


def _prepared(items: DataFrame, window: int) -> _Search:
    """The items as rows of words in the shared folder, in blocks of about 8 MB of text."""
    spark = items.sparkSession
    known = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    total, most = known.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    blocks = max(1, -(-(total or 0) // _BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        h, first = term_hashes(*text_bytes(table.column("text")))
        ids, owner = np.unique(np.array(table.column("item").to_pylist(), object), return_inverse=True)
        words, windows, owners = [], [], []
        for i in range(table.num_rows):
            n = int(first[i + 1] - first[i])
            starts = np.zeros(n + 1, np.int32)
            starts[: max(n - window + 1, min(n, 1))] = min(n, window)
            words.append(np.append(h[first[i] : first[i + 1]], np.uint64(0)))
            windows.append(starts)
            owners.append(np.full(n + 1, owner.reshape(-1)[i], np.int32))
        one = lambda parts, kind: pa.array([np.concatenate(parts)], pa.list_(kind))
        longest = int(np.diff(first).max(initial=0))
        columns = [one([w.view(np.int64) for w in words], pa.int64()), one(windows, pa.int32()), one(owners, pa.int32()), pa.array([ids.tolist()], pa.list_(pa.string())), pa.array([longest])]
        return pa.table(columns, names=["words", "window", "owner", "ids", "longest"])

    path = fresh_path(spark, "items")
    dealt = known.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    dealt.groupBy("block").applyInArrow(pack, "words array<long>, window array<int>, owner array<int>, ids array<string>, longest long").write.parquet(path)
    deepest = spark.read.parquet(path).agg(F.max("longest")).first()[0]
    return _Search(path, blocks, max(deepest or 0, window))


def _hits(own: _Search, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """For each text its words, how many of them windows cover, and the sorted ids of the items with such windows."""
    h, first = term_hashes(data, offsets)
    texts = len(first) - 1
    cover = np.zeros(len(h) + texts + 1, np.int32)
    begins = first[:-1] + np.arange(texts)  # of texts in the row with a 0 after each
    found: list[set[str]] = [set() for _ in range(texts)]
    for block, array, (_, _, _, low, high) in own.matches(h, first):
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        # Windows of the same words have the same slots: their places are gone through once, whatever items share them.
        ranges, which = np.unique(np.stack([low[hit], high[hit], block.window[hit]]), axis=1, return_inverse=True)
        slots, of = _spans(ranges[0], ranges[1])
        places, size = array[slots], ranges[2][of]
        np.add.at(cover, places, 1)
        np.add.at(cover, places + size, -1)
        text = np.searchsorted(begins, places, "right") - 1
        order = np.argsort(which.reshape(-1), kind="stable")
        starts = np.searchsorted(which.reshape(-1)[order], np.arange(ranges.shape[1] + 1))
        owners = [sorted({block.ids[i] for i in block.owner[hit[order[a:b]]].tolist()}) for a, b in zip(starts, starts[1:], strict=False)]
        for t, r in np.unique(np.stack([text, of]), axis=1).T.tolist():
            found[t].update(owners[r])
    inked = np.cumsum(cover) > 0
    covered = np.concatenate(([0], np.cumsum(inked)))
    return np.diff(first), covered[begins + np.diff(first)] - covered[begins], [sorted(x) for x in found]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """What each document has of the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row for each
    row of docs.

    Words are maximal runs of ASCII digits and letters, A-Z in lower case, and of characters beyond ASCII. A window is
    ``window`` consecutive words of one item; an item of fewer words, but one at least, is one window. n_hit counts the
    document's words inside any occurrence of any window, n_items the items with such windows, items_sha256 is of their ids
    sorted as strings and joined by commas. Rows of one item_id are one item, a null item_id is one too (written ``null``).
    A null, empty or wordless text has no words and no hits, as a document or as an item. Null and repeated doc_ids stay,
    each row by its own text; extra columns are ignored. Without documents there are no rows, without items no hits.
    """
    own = _prepared(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for x in batches for part in slices(x, "text", _SLICE)):
            words, hit, ids = _hits(own, *text_bytes(batch.column("text")))
            sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            columns = [batch.column("doc_id"), pa.array(words), pa.array(hit), pa.array(list(map(len, ids)), pa.int64()), pa.array(sums, pa.string()), pa.array(hit > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs, all their columns, without the rows that have a word inside an occurrence of a window (see contamination())."""
    own = _prepared(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for x in batches for part in slices(x, "text", _SLICE)):
            _, hit, _ = _hits(own, *text_bytes(batch.column("text")))
            yield batch.filter(pa.array(hit == 0))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """For each place of an item from which ``least`` words or more also stand in a document: item_id (as a string), start
    (the word it starts at, from 0), n_words of the longest such match over all documents, doc_id and doc_start of its first
    place (smallest doc_id, nulls last, then the earliest word). If an item_id has several rows, a start is that of any of them,
    and the longest match of all counts. Edges are as in contamination()."""
    own = _prepared(items, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for x in batches for part in slices(x, "text", _SLICE)):
            h, first = term_hashes(*text_bytes(batch.column("text")))
            begins = first[:-1] + np.arange(len(first) - 1)
            docs_ = np.array([(i is None, i or 0) for i in batch.column("doc_id").to_pylist()], [("none", bool), ("id", np.int64)])
            for block, array, (length, low, high, _, _) in own.matches(h, first):
                hit = np.flatnonzero(length >= least)
                if not len(hit):
                    continue
                slots, of = _spans(low[hit], high[hit])
                text = np.searchsorted(begins, array[slots], "right") - 1
                order = np.lexsort((array[slots] - begins[text], docs_["id"][text], docs_["none"][text], of))
                one = order[np.searchsorted(of[order], np.arange(len(hit)))]
                texts = np.concatenate(([0], np.flatnonzero(block.words == 0) + 1))
                start = hit - texts[np.searchsorted(texts, hit, "right") - 1]
                found = text[one]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.ids[i] for i in block.owner[hit].tolist()], pa.string()), pa.array(start), pa.array(length[hit]), pa.array(docs_["id"][found], mask=docs_["none"][found]), pa.array(array[slots[one]] - begins[found])],
                    names=["item_id", "start", "n_words", "doc_id", "doc_start"],
                )

    each = docs.select("doc_id", "text").mapInArrow(run, "item_id string, start long, n_words long, doc_id long, doc_start long")
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_start")).alias("m")
    return each.groupBy("item_id", "start").agg(best).select("item_id", "start", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.doc_start")
