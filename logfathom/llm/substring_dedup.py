"""Exact removal of repeated passages by fixed-block anchors.

A passage is a window of ``window`` words. Blocks of half a window, at word 0, b, 2b ... of every document, are the
index: any window holds one of them whole. All rolling windows of a block's length probe it, and each hit is extended
to every passage around it:

1. Every document's rolling block hashes go to buckets by hash; those at multiples of b are the indexed blocks. A bucket
   tells which hashes an indexed block shares with another place. A task sends each distinct hash of some MB of text
   once, and one that it has found repeated there not again, so a passage that a third of all documents have costs a
   bucket one entry for each task, not for each document.
2. Around the hits, every passage's 96-bit hash goes to a bucket, which finds the first place of each passage. Unions of
   passages that are not first are the maximal repeats.
3. The words of those are taken out.

Texts travel once, compressed; both joins to the documents use that one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm._words import mix, slices, text_bytes, window_hashes, word_hashes, word_spans

_LAST = (1 << 63) - 1
_SLICE = 4_000_000  # bytes of text that repeats are looked for in before anything is sent
_BUCKET = 64_000_000  # bytes of the table, as stored, for each bucket
_HELD = 2_000_000  # hashes that a task knows to be repeated
_BLOB = "bucket int, own binary, n binary, pos binary, a binary, b binary"


def _lists(keys: list[np.ndarray], pos: np.ndarray) -> tuple[list[np.ndarray], pa.Array]:
    """Sort by the keys and gather each key's positions."""
    order = np.lexsort((pos, *reversed(keys)))
    keys, pos = [k[order] for k in keys], pos[order]
    first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if len(pos) else np.zeros(0, np.int64)
    return [k[first] for k in keys], pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)), pa.int32()), pa.array(pos, pa.int32()))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as their low halves, then their high ones, which are mostly 0 and shrink to nothing in the shuffle."""
    x = x.astype("<u4")
    return (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()


def _joined(x: bytes) -> np.ndarray:
    low, high = np.frombuffer(x, "<u2").reshape(2, -1).astype(np.uint32)
    return low | high << np.uint32(16)


def _ship(bucket: np.ndarray, buckets: int, doc: np.ndarray, own: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    """One row for each bucket: entries in document order as packed columns. own: 8-byte columns by document."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k in range(buckets):
        i = order[ends[k] : ends[k + 1]]
        if len(i):
            docs, n = np.unique(doc[i], return_counts=True)  # entries come in document order
            rows.append((k, own[docs].tobytes(), n.astype("<u4").tobytes(), _planes(pos[i]), a[i].tobytes(), b[i].tobytes() if b is not None else None))
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=["bucket", "own", "n", "pos", "a", "b"])


def _pack(own: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places as packed rows for the owners' buckets, few rows however many documents there are. own: its first column is the rid."""
    own, doc = np.unique(own, axis=0, return_inverse=True)
    doc = doc.reshape(-1)
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    to = (mix(own[:, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    made = _ship(to[doc], buckets, doc, own, pos, np.zeros(len(doc), "V0"), None)
    return made.set_column(4, "a", pa.nulls(made.num_rows, pa.binary()))


def _received(table: pa.Table, width: int, a: str, b: str | None) -> tuple[np.ndarray, ...]:
    get = lambda name, kind: np.concatenate([np.frombuffer(x or b"", kind) for x in table.column(name).to_pylist()] or [np.zeros(0, kind)])
    pos = np.concatenate([_joined(x) for x in table.column("pos").to_pylist()] or [np.zeros(0, np.uint32)])
    own = np.repeat(get("own", "<i8").reshape(-1, width), get("n", "<u4"), axis=0)
    return own, pos, get("a", a), get("b", b) if b else None


class _Seen:
    """Hashes that a task has sent as repeated ones, with a value each (the least counts); emptied when it holds very many,
    which only sends some again."""

    def __init__(self, width: int):
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, width), np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and the row of each that is."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)), at

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(self.keys) + len(keys) > _HELD:
            self.__init__(values.shape[1])
        keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.values, values])
        order = np.lexsort((*reversed(values.T), keys))
        first = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(order) else np.zeros(0, bool)
        self.keys, self.values = keys[order[first]], values[order[first]]


def _buckets(docs: DataFrame) -> int:
    """Buckets for a table: as many as the session has shuffle partitions, or more where those would be large."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // _BUCKET), 100_000) if size < 1 << 60 else 1)


def dedup_passages(docs: DataFrame, window: int = 20, buckets: int | None = None, keep_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Remove every word that a repeated passage covers; one row for each row of docs.

    A passage (``window`` consecutive words of one text, an even number) is repeated if its words also start at an
    earlier place: a smaller doc_id, or the same document and an earlier word. All are judged on the texts as given.
    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space, UTF-8), with keep_text kept
    (those words; the text as it is if none was removed), and the columns of docs named in carry, as ``carried_<name>``. Words are ``[^\\x20\\x09-\\x0D]+``. A null, empty or blank text has no words, and so has a text of fewer words
    than a passage no repeats. A null doc_id comes after all others; rows with one doc_id are ordered by a hash of their
    texts, and those with the same text too count as one document, so each gets the same result. Extra columns are
    ignored; an empty table gives no rows.
    """
    size, many = window // 2, buckets or _buckets(docs)
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) % np.uint64(many)).astype(np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(1)  # 0: as an indexed block
        for batch in (part for x in batches for part in slices(x, "text", _SLICE)):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            h, doc, pos = window_hashes(word_hashes(data, starts, ends), first, size)
            if not len(h):
                continue
            rid = batch.column("rid").to_numpy()
            order = np.argsort(h, kind="stable")
            fresh = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            at = np.flatnonzero(fresh)
            anchored = np.logical_or.reduceat((pos % size == 0)[order], at)
            one = order[at]
            many_here = np.diff(np.append(at, len(h))) > 1
            held, where = seen.find(h[one])
            sent = held.copy()
            sent[held] = seen.values[where[held], 0] <= ~anchored[held]
            repeated = many_here | held
            fresh = np.flatnonzero(repeated & ~sent)
            seen.add(h[one[fresh]], (~anchored[fresh]).astype(np.int64)[:, None])
            many_here, back = repeated, np.flatnonzero(~sent)[np.argsort(one[~sent])]  # in document order again
            one, anchored = one[back], anchored[back]
            yield _ship(bucket_of(h[one]), many, doc[one], rid[:, None], pos[one] * 2 + anchored, h[one].astype("<u4"), None)
            if many_here.any():  # repeated inside the slice, or before in this task: hits already, which a bucket only passes on
                mine = np.sort(order[np.repeat(many_here, np.diff(np.append(at, len(h))))])
                known = _ship(doc[mine] % many, many, doc[mine], rid[:, None], pos[mine], np.zeros(len(mine), "V0"), None)
                yield known.set_column(4, "a", pa.nulls(known.num_rows, pa.binary()))

    def hits(table: pa.Table) -> pa.RecordBatch:
        known = pa.compute.is_null(table.column("a"))
        own, pos, _, _ = _received(table.filter(known), 1, "<u4", None)
        rid, at = [own], [pos.astype(np.int64)]
        own, pos, h, _ = _received(table.filter(pa.compute.invert(known)), 1, "<u4", None)
        if len(h):
            order = np.argsort(h, kind="stable")
            s = h[order]
            begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            length = np.diff(np.append(begin, len(s)))
            good = (length > 1) & np.logical_or.reduceat((pos & 1).astype(bool)[order], begin)
            pick = order[np.repeat(good, length)]
            rid.append(own[pick])
            at.append((pos[pick] >> 1).astype(np.int64))
        return _pack(np.concatenate(rid), np.concatenate(at), many)

    def gather_hits(table: pa.Table) -> pa.RecordBatch:
        own, pos, _, _ = _received(table, 1, "<u4", None)
        (rid,), places = _lists([own[:, 0]], pos.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), places], names=["rid", "pos"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([z.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
            more = [batch.column(c) for c in extra]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("th"), packed, *more], names=["rid", "doc_id", "th", "z", *extra])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, seen = zstandard.ZstdDecompressor(), _Seen(4)  # the second hash, and the place sent: doc_id, text's hash, word
        for batch in batches:
            texts = pa.array([z.decompress(x) for x in batch.column("z").to_pylist()], pa.large_binary())
            batch = batch.append_column("raw", texts)
            for part in slices(batch, "raw", _SLICE):
                data, offsets = text_bytes(part.column("raw"))
                starts, ends, first = word_spans(data, offsets)
                wanted = np.zeros(len(starts) + 1, np.int32)
                marks = part.column("pos").to_pylist()
                for i, places in enumerate(marks):  # passages around a hit at q start at q - size .. q
                    q = np.array(places, np.int64) + first[i]
                    q = q[q < first[i + 1]]
                    np.add.at(wanted, np.maximum(q - size, first[i]), 1)
                    np.add.at(wanted, np.minimum(q + 1, first[i + 1]), -1)
                a, doc, pos = window_hashes(word_hashes(data, starts, ends), first, window)
                b, _, _ = window_hashes(word_hashes(data, starts, ends, 1), first, window)
                take = np.cumsum(wanted)[first[:-1][doc] + pos] > 0
                a, b, doc, pos = a[take], b[take].astype("<u4"), doc[take], pos[take]
                d = part.column("doc_id").fill_null(_LAST).to_numpy()
                own = np.stack([part.column("rid").to_numpy(), d, part.column("th").to_numpy()], axis=1)
                _, rank = np.unique(own[:, 1:], axis=0, return_inverse=True)
                rank = rank.reshape(-1)
                order = np.lexsort((pos, rank[doc], b, a))
                same = np.concatenate(([False], (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])))
                begin = np.flatnonzero(~same)
                lead = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
                twin = (rank[doc[lead]] == rank[doc[order]]) & (pos[lead] == pos[order])
                one, count = order[begin], np.diff(np.append(begin, len(order)))
                place = np.column_stack([b[one].astype(np.int64), own[doc[one], 1], own[doc[one], 2], pos[one]])
                held, where = seen.find(a[one])
                later = held.copy()  # than the place that this task has sent of the passage
                if held.any():
                    was, now = seen.values[where[held]], place[held]
                    differ = was != now
                    column = np.where(differ.any(axis=1), differ.argmax(axis=1), 1)
                    rows = np.arange(len(now))
                    later[held] = ~differ[:, 0] & (was[rows, column] < now[rows, column])
                fresh = np.flatnonzero((count > 1) & ~held)
                seen.add(a[one[fresh]], place[fresh])
                known_late = np.concatenate([order[~twin], one[later]])
                one = np.sort(one[~later])  # in document order
                yield _ship(bucket_of(a[one]), many, doc[one], own, pos[one], a[one], b[one])
                late = np.sort(known_late)
                if len(late):
                    known = _ship(doc[late] % many, many, doc[late], own, pos[late], np.zeros(len(late), "V0"), None)
                    yield known.set_column(4, "a", pa.nulls(known.num_rows, pa.binary()))

    def repeats(table: pa.Table) -> pa.RecordBatch:
        known = pa.compute.is_null(table.column("a"))
        own, pos, _, _ = _received(table.filter(known), 3, "<u8", "<u4")
        owners, at = [own], [pos.astype(np.int64)]
        own, pos, a, b = _received(table.filter(pa.compute.invert(known)), 3, "<u8", "<u4")
        if len(a):
            order = np.lexsort((pos, own[:, 2], own[:, 1], b, a))
            same = np.concatenate(([False], (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])))
            begin = np.flatnonzero(~same)
            lead = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
            late = order[(own[lead] != own[order]).any(axis=1) | (pos[lead] != pos[order])]
            owners.append(own[late])
            at.append(pos[late].astype(np.int64))
        return _pack(np.concatenate(owners), np.concatenate(at), many)

    def gather_repeats(table: pa.Table) -> pa.RecordBatch:
        own, pos, _, _ = _received(table, 3, "<u8", "<u4")
        (rid, th), places = _lists([own[:, 0], own[:, 2]], pos.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(th, pa.int64()), places], names=["rid", "th", "pos"])

    def in_buckets(df: DataFrame, whole: Callable[[pa.Table], pa.RecordBatch], kinds: str) -> DataFrame:
        """Each bucket, a partition of its own, as one table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if got := [b for b in batches if b.num_rows]:
                yield whole(pa.Table.from_batches(got))

        return df.repartitionById(many, F.col("bucket")).mapInArrow(run, kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, gone, sums, kept = [], [], [], []
            for packed, th, marks in zip(batch.column("z").to_pylist(), batch.column("th").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                raw = z.decompress(packed)
                words = raw.split()
                n = len(words)
                if marks:
                    at = np.array([p for m in marks if m["at"] == th for p in m["pos"]], np.int64)
                    cover = np.zeros(n + 1, np.int32)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:n] == 0).tolist()]
                left = b" ".join(words)
                counts.append(n)
                gone.append(n - len(words))
                sums.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append((left if len(words) < n else raw).decode())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_text + [batch.column(c) for c in extra], names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text + extra)

    extra = [f"carried_{c}" for c in carry]
    also = "".join(f", `{e}` {docs.schema[c].dataType.simpleString()}" for c, e in zip(carry, extra, strict=True))
    th = F.xxhash64("text")
    rows = docs.select(F.when(F.col("doc_id") < _LAST, F.col("doc_id")).otherwise(th).alias("rid"), "doc_id", th.alias("th"), "text", *[F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)])
    found = rows.select("rid", "text").mapInArrow(probe, _BLOB)
    by_doc = in_buckets(in_buckets(found, hits, _BLOB), gather_hits, "rid long, pos array<int>")
    # The filter, which drops nothing, is what the inner join would add; so both joins have the same exchange.
    texts = rows.mapInArrow(squeeze, "rid long, doc_id long, th long, z binary" + also).filter("rid is not null")
    around = texts.join(by_doc.hint("merge"), "rid").select("rid", "doc_id", "th", "z", "pos").mapInArrow(passages, _BLOB)
    late = in_buckets(in_buckets(around, repeats, _BLOB), gather_repeats, "rid long, th long, pos array<int>")
    marks = late.groupBy("rid").agg(F.collect_list(F.struct(F.col("th").alias("at"), "pos")).alias("marks"))
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text + also
    return texts.join(marks.hint("merge"), "rid", "left").select("doc_id", "th", "z", "marks", *extra).mapInArrow(cut, kinds)


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with repeated passages taken out of their texts (n_chars, if there is one, says the new length). Every row
    stays, a text that was nothing but repeats as an empty one; a text without repeats is left as it is (a null
    text as an empty one)."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = dedup_passages(docs, window, keep_text=True, carry=carry)
    new = {c: F.col(f"carried_{c}") for c in carry} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in carry:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried_n_chars"))
    return found.select(*[new[c].alias(c) for c in docs.columns])
