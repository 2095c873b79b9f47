"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit packing.

Each distinct shingle is hashed once: the hash's top bits name a bin, which keeps its smallest hash. An empty bin takes
the value of the first bin that is not empty in a fixed pseudo-random order of its own (drawn anew for each bin, the
same for all texts). Of each bin's value the low-order bits are kept. Two fingerprints' share of equal bins overstates
the Jaccard similarity by chance matches; likeness() takes those out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm._shared import stage
from logfathom.llm._words import mix, slices, text_bytes
from logfathom.llm.probminhash import shingles


@lru_cache(maxsize=4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it tries the others, and its inverse."""
    order = np.argsort(mix(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins), axis=1)
    return order.astype(np.int32), np.argsort(order, axis=1).astype(np.int32)


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = 5, bins: int = 512, bits: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints, one row of bins * bits / 8 bytes for each text, and whether each text has shingles."""
    h, _, first = shingles(data, offsets, size)
    docs, top = len(offsets) - 1, bins.bit_length() - 1
    value = np.full(docs * bins, np.uint64((1 << 64) - 1))
    doc = np.repeat(np.arange(docs), np.diff(first))
    np.minimum.at(value, doc * bins + (h >> np.uint64(64 - top)).astype(np.int64), h)
    value = value.reshape(docs, bins)
    full = value != np.uint64((1 << 64) - 1)
    order, rank = _orders(bins)
    source = np.broadcast_to(np.arange(bins, dtype=np.int32), (docs, bins)).copy()
    at, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(16):
        tried = order[bin_, t]
        good = full[at, tried]
        source[at[good], bin_[good]] = tried[good]
        at, bin_ = at[~good], bin_[~good]
    for i in np.unique(at).tolist():  # few full bins: the best of them, rather than many tries
        have, need = np.flatnonzero(full[i]), bin_[at == i]
        source[i, need] = have[np.argmin(rank[need][:, have], axis=1)]
    low = (mix(np.take_along_axis(value, source.astype(np.int64), axis=1)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    spread = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(spread.reshape(docs, -1).astype(np.uint8), axis=1), np.diff(first) > 0


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray, bins: int = 512, bits: int = 4) -> np.ndarray:
    """Estimated Jaccard similarity, row by row: (share of equal bins - c) / (1 - c) with chance c = 2**-bits, not under 0.

    Two texts without shingles are alike (1); one without and one with are not (0).
    """
    same = ~np.unpackbits(a ^ b, axis=1).reshape(len(a), bins, bits).any(axis=2) if len(a) else np.zeros((0, bins), bool)
    chance = 2.0**-bits
    return np.where(has_a & has_b, np.maximum(0.0, (same.mean(axis=1) - chance) / (1 - chance)), (has_a == has_b).astype(float))


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, size: int = 5, bins: int = 512, bits: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text; one row for each row of docs.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document in descending doc_id order; after the last comes the first, and a single document follows itself. A null
    doc_id comes after all others, rows with one doc_id are ordered by a hash of their texts, and repeated rows follow
    each other. A null text is empty. A text of 1 to 4 words is one shingle; a text without words has the fingerprint
    ``""``, is alike (1) to others without words and not (0) to any with. Extra columns are ignored; an empty table
    gives no rows. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (base64), near_edited,
    near_next. Texts are dealt out by doc_id range; only the first and last text of each range travel further.
    """
    spark = docs.sparkSession

    def prints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.zeros((0, bins * bits // 8), np.uint8)], [np.zeros(0, bool)]
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["t"]), "t"):
            fp, has = fingerprints(*text_bytes(part.column("t")), size, bins, bits)
            got[0].append(fp)
            got[1].append(has)
        return np.concatenate(got[0]), np.concatenate(got[1])

    def finished(ids: list, texts: list[str], following: list[str], fp: np.ndarray, has: np.ndarray, fp_next: np.ndarray, has_next: np.ndarray) -> dict:
        edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
        fe, he = prints(edited)
        coded = lambda rows, has: [bytes(r) if x else b"" for r, x in zip(rows, has, strict=True)]
        return {
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
            "fp": pa.array(coded(fp, has), pa.binary()), "fe": pa.array(coded(fe, he), pa.binary()),
            "near_edited": pa.array(likeness(fp, fe, has, he, bins, bits)), "near_next": pa.array(likeness(fp, fp_next, has, has_next, bins, bits)),
        }

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried, first = TaskContext.get().partitionId(), None, None

        def edge(kind: int, x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "doc_id": x[0], "text": x[1]}], schema=schema)

        for batch in (s for b in batches for s in slices(b, "text")):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            fp, has = prints(texts)
            if first is None:
                first = (ids[0], texts[0])
                yield edge(2, first)
            if carried is not None:
                ids, texts = [carried[0], *ids], [carried[1], *texts]
                fp, has = np.concatenate([carried[2], fp]), np.concatenate([carried[3], has])
            carried = (ids[-1], texts[-1], fp[-1:], has[-1:])
            if len(ids) > 1:
                out = finished(ids[:-1], texts[:-1], texts[1:], fp[:-1], has[:-1], fp[1:], has[1:])
                n = len(ids) - 1
                out |= {"kind": pa.array([0] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "text": pa.nulls(n, pa.string())}
                yield pa.RecordBatch.from_arrays([out[f.name] for f in schema], schema=schema)
        if carried is not None:
            yield edge(1, carried)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            out = finished(batch.column("doc_id").to_pylist(), texts, following, *prints(texts), *prints(following))
            yield pa.RecordBatch.from_arrays([out[f] for f in core], names=core)

    core = ["doc_id", "n_chars", "edited_sha256", "fp", "fe", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *zip(core, kinds, strict=True), ("text", pa.string())])
    ddl = "doc_id long, n_chars long, edited_sha256 binary, fp binary, fe binary, near_edited double, near_next double"
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    walked = stage(dealt.sortWithinPartitions(*order).mapInArrow(walk, f"kind int, part int, {ddl}, text string"), "fingerprints")
    heads = walked.filter("kind = 2")
    parts = heads.select("part")  # numbers of the ranges alone, one a range
    after = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("to"), F.min("part").over(Window.orderBy("part")).alias("low")).select("part", F.coalesce("to", "low").alias("to"))
    tails = walked.filter("kind = 1").select("part", "doc_id", "text").join(after, "part")
    ends = tails.join(heads.select(F.col("part").alias("to"), F.col("text").alias("following")), "to").select("doc_id", "text", "following").mapInArrow(join, ddl)
    every = walked.filter("kind = 0").select(*core).union(ends)
    return every.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.base64("fp").alias("fingerprint"), F.base64("fe").alias("edited_fingerprint"), "near_edited", "near_next")
