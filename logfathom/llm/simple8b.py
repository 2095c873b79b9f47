"""Token-id files in Simple-8b: 64-bit words whose top four bits select how many ids of which width follow.

File layout (little-endian): ``S8BIDS01``; the blocks' words; then the footer: for each block its first word (uint64)
and its ids (uint32), for each document its id (int64), whether that is null (uint8) and its ids (uint64); last the
counts of blocks and documents (uint64 each), the footer's first byte (uint64) and ``S8BEND01``. Blocks hold 1,024 ids
(the last one fewer), so that any range of ids is decoded from its blocks alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.llm._bpe import codec
from logfathom.llm._shared import fresh_path, stage

BLOCK = 1024
# Fixed values of the format: (ids in a word, bits of each) by selector; selector 15 is the escape, whose id of 61 to 64 bits is the next word.
LAYOUT = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1), (120, 0)]
ESCAPE = 15
_COUNT = np.array([n for n, _ in LAYOUT] + [1])
_PAD = 120
_HEAD, _END = b"S8BIDS01", b"S8BEND01"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and, for each block of 1,024 ids, how many words it has. Greedy: each word takes as many ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if len(ids) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks, stride = -(-len(ids) // BLOCK), BLOCK + _PAD
    grid = np.zeros((blocks, stride), np.uint64)
    whole = len(ids) // BLOCK
    grid[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    grid[whole:, : len(ids) - whole * BLOCK] = ids[whole * BLOCK :]
    width = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)
    best = np.where(width > 60, np.uint8(ESCAPE), np.uint8(0))
    spans = {1: width}  # by power of two: the largest width among so many ids from here on
    for p in (1, 2, 4, 8, 16, 32):
        s = spans[p].copy()
        np.maximum(s[:, : stride - p], spans[p][:, p:], out=s[:, : stride - p])
        spans[2 * p] = s
    for k, (n, bits) in enumerate(LAYOUT[1:], 1):
        p = 1 << (n.bit_length() - 1)
        fits = np.maximum(spans[p][:, :BLOCK], spans[p][:, n - p : n - p + BLOCK]) <= bits
        best[:, :BLOCK][fits] = k
    best, flat = best.ravel(), grid.ravel()
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = len(ids) - (blocks - 1) * BLOCK
    at = np.arange(blocks) * stride
    end, taken = at + sizes, np.zeros(len(flat), bool)
    while len(at):  # one word of every block at a time
        taken[at] = True
        at = at + _COUNT[best[at]]
        more = at < end
        at, end = at[more], end[more]
    where = np.flatnonzero(taken)
    chosen = best[where]
    room = np.where(chosen == ESCAPE, 2, 1)
    to = np.cumsum(room) - room
    words = np.zeros(int(room.sum()), np.uint64)
    words[to] = chosen.astype(np.uint64) << np.uint64(60)
    for k, (n, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(chosen == k)
        if bits and len(own):
            got = flat[where[own][:, None] + np.arange(n)] << (np.arange(n, dtype=np.uint64) * np.uint64(bits))
            words[to[own]] |= np.bitwise_or.reduce(got, axis=1)
    big = np.flatnonzero(chosen == ESCAPE)
    words[to[big] + 1] = flat[where[big]]
    return words, np.bincount(where // stride, weights=room, minlength=blocks).astype(np.int64)


def unpack(words: np.ndarray, block_words: np.ndarray, block_ids: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, given each block's words and ids."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    last = -2
    for i in np.flatnonzero(kind == ESCAPE).tolist():
        if i != last + 1:  # not itself the payload of the escape before it
            last = i
            raw[i + 1] = True
    count = _COUNT[kind]
    count[raw] = 0
    ends = np.cumsum(block_words)
    tails = ends - 1 - raw[ends - 1] if len(ends) else ends  # the word with a block's last ids
    before = np.concatenate(([0], np.cumsum(count)))
    count[tails] = block_ids - (before[tails] - before[ends - block_words])
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for k, (n, bits) in enumerate(LAYOUT):
        own = np.flatnonzero((kind == k) & ~raw)
        if not bits or not len(own):
            continue
        shifts, mask = np.arange(n, dtype=np.uint64) * np.uint64(bits), np.uint64((1 << bits) - 1)
        full = own[count[own] == n]
        out[to[full][:, None] + np.arange(n)] = (words[full][:, None] >> shifts) & mask
        for i in own[count[own] < n].tolist():
            out[to[i] : to[i] + count[i]] = ((words[i] >> shifts) & mask)[: count[i]]
    big = np.flatnonzero((kind == ESCAPE) & ~raw)
    out[to[big]] = words[big + 1]
    return out


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0, files: int | None = None) -> DataFrame:
    """Encode every text and write the ids in ascending doc_id order, one file for each range of doc_ids.

    Returns the manifest, one row for each file: part, file, n_docs, n_ids, first_id (ids of all files before it).
    A null text is empty; an empty text is just the end id. A null doc_id comes after all others; rows with one doc_id
    are ordered by a hash of their texts. Extra columns are ignored. No documents: no files. A task that runs again
    writes a file of its own; the manifest names the one whose task ended well.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own, part = codec(tokenizer_path), task.partitionId()
        name = f"ids-{part:06d}-{task.taskAttemptId()}.s8b"
        keys, nulls, lengths, block_words, rest, held, total = [], [], [], [], [], 0, 0
        out = None

        def flush(ids: np.ndarray) -> None:
            words, counts = pack(ids)
            out.write(words.astype("<u8").tobytes())
            block_words.append(counts)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    where, inner = _files(path)
                    where.create_dir(inner, recursive=True)
                    out = where.open_output_stream(f"{inner}/{name}")
                    out.write(_HEAD)
                ids = own.encode(text.as_py() or "")
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                keys.append(key or 0)
                nulls.append(key is None)
                lengths.append(len(ids))
                rest.append(ids)
                total, held = total + len(ids), held + len(ids)
                if held >= 1 << 20:
                    ids = np.concatenate(rest)
                    whole = len(ids) // BLOCK * BLOCK
                    flush(ids[:whole])
                    rest, held = [ids[whole:]], len(ids) - whole
        if out is None:
            return
        flush(np.concatenate(rest))
        counts = np.concatenate(block_words).astype(np.int64)
        sizes = np.full(len(counts), BLOCK, np.int64)
        if len(sizes):
            sizes[-1] = total - (len(counts) - 1) * BLOCK
        footer = len(_HEAD) + 8 * int(counts.sum())
        for column, kind in ((np.cumsum(counts) - counts, "<u8"), (sizes, "<u4"), (keys, "<i8"), (nulls, "u1"), (lengths, "<u8"), ([len(counts), len(keys), footer], "<u8")):
            out.write(np.array(column, kind).tobytes())
        out.write(_END)
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{path}/{name}", "n_docs": len(keys), "n_ids": total}])

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    made = ordered.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    manifest = stage(made, "id-files")  # one row a file: the running sum below sees no documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, at_once: int = 1024) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32).

    A file is decoded ``at_once`` blocks at a time by ranged reads; a document's ids are never all in memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, inner = _files(row["file"])
                with where.open_input_file(inner) as f:
                    size = f.size()
                    tail = f.read_at(32, size - 32)
                    if tail[-8:] != _END or f.read_at(8, 0) != _HEAD:
                        raise ValueError(f"not a Simple-8b id file: {row['file']}")
                    blocks, n, footer = np.frombuffer(tail[:24], "<u8").astype(int).tolist()
                    foot = f.read_at(size - 32 - footer, footer)
                    at, columns = 0, []
                    for kind, length in (("<u8", blocks), ("<u4", blocks), ("<i8", n), ("u1", n), ("<u8", n)):
                        columns.append(np.frombuffer(foot, kind, length, at))
                        at += columns[-1].nbytes
                    firsts, sizes, keys, nulls, lengths = columns
                    firsts = np.append(firsts.astype(np.int64), (footer - len(_HEAD)) // 8)
                    ends = np.cumsum(lengths.astype(np.int64))
                    crcs, doc, seen = np.zeros(n, np.int64), 0, 0
                    for b in range(0, blocks, at_once):
                        to = min(b + at_once, blocks)
                        raw = f.read_at(8 * int(firsts[to] - firsts[b]), len(_HEAD) + 8 * int(firsts[b]))
                        ids = unpack(np.frombuffer(raw, "<u8"), np.diff(firsts[b : to + 1]), sizes[b:to].astype(np.int64)).astype("<u4")
                        data, start = memoryview(ids).cast("B"), seen
                        while doc < n:
                            upto = min(int(ends[doc]), start + len(ids))
                            crcs[doc] = zlib.crc32(data[4 * (seen - start) : 4 * (upto - start)], int(crcs[doc]))
                            seen = upto
                            if upto < ends[doc]:
                                break
                            doc += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=nulls.astype(bool)), pa.array(ends - lengths.astype(np.int64) + row["first_id"]), pa.array(lengths.astype(np.int64)), pa.array(crcs)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write docs as id files in the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_ids(write_ids(docs, fresh_path(spark, "ids"), tokenizer_path, end_id))
