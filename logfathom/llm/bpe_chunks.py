"""BPE encoding that encodes a chunk of text once, however many documents share it.

1. A rolling (gear) hash of 32 bytes cuts every text into content-defined chunks; chunks are counted by a 128-bit hash.
2. Of each chunk that two documents or more have, one document is the owner; its task encodes the chunk.
3. Those ids go to the documents that have the chunk. What a document shares with none is encoded where it stands.
4. Joints are repaired: the text between a break before and one after the joint is encoded anew, and both breaks must
   fall between two ids of the neighbours; if one doesn't, the next break out is taken, until they agree exactly. A
   break is a printable ASCII character followed by ASCII white space: there no token can cross, whatever surrounds it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm._bpe import Codec, codec
from logfathom.llm._shared import stage
from logfathom.llm._words import _SPACE, mix, slices, text_bytes

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def cut_chunks(data: np.ndarray, offsets: np.ndarray, bits: int = 10, least: int = 128, most: int = 16384) -> list[list[int]]:
    """For each text the ends of its chunks (bytes from its start): where the hash's top ``bits`` are 0, at most ``most``
    and at least ``least`` (32 or more) bytes apart, and never inside a character."""
    h = _GEAR[data]
    for p in (1, 2, 4, 8, 16):
        h[p:] += h[:-p] << np.uint32(p)
    hits = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    span = np.searchsorted(hits, offsets)
    out = []
    for i in range(len(offsets) - 1):
        base, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
        ends, last = [], 0

        def put(to: int) -> int:
            while to < n and data[base + to] & 0xC0 == 0x80:
                to += 1
            ends.append(to)
            return to

        for c in (hits[span[i] : span[i + 1]] - base).tolist():
            if c - last >= least and c < n:
                while c - last > most:
                    last = put(last + most)
                if c - last >= least:
                    last = put(c)
        while n - last > most:
            last = put(last + most)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def assemble(own: Codec, data: bytes, ends: list[int], known: list[np.ndarray | None]) -> np.ndarray:
    """Ids of a text from those of some of its chunks (None: not known)."""
    pieces: list[tuple[int, int, np.ndarray | None]] = []
    start = 0
    for end, ids in zip(ends, known, strict=True):
        if ids is None and pieces and pieces[-1][2] is None:
            pieces[-1] = (pieces[-1][0], end, None)
        else:
            pieces.append((start, end, ids))
        start = end
    encode = lambda a, b: own.encode(data[a:b].decode("utf-8"))
    if not own.plain or len(pieces) == 1 and pieces[0][2] is None:
        return encode(0, len(data))
    if not pieces:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    breaks = (np.flatnonzero(_SPACE[raw[1:]] & (raw[:-1] > 0x20) & (raw[:-1] < 0x7F)) + 1).tolist()

    def index(sums: np.ndarray, x: int) -> int | None:
        """How many ids cover the first x bytes, if some number does."""
        k = int(np.searchsorted(sums, x, "right"))
        return k if x == 0 or k and sums[k - 1] == x else None

    done: list[np.ndarray] = []
    tail, tail_at, pending = None, 0, None  # ids not yet final, their first byte (0 or a break); from where text is still to be encoded
    for s, e, ids in pieces:
        if ids is None:
            ids = encode(s, e)
        sums = np.cumsum(own.lengths[ids])
        if tail is None and pending is None:
            tail, tail_at, tail_sums = ids, s, sums
            continue
        if pending is None:
            pending, kept = tail_at, 0
            for b in reversed(breaks[bisect_right(breaks, tail_at) : bisect_right(breaks, s)]):
                if (k := index(tail_sums, b - tail_at)) is not None:
                    pending, kept = b, k
                    break
            done.append(tail[:kept])
        tail = None
        for b in breaks[bisect_left(breaks, s) : bisect_left(breaks, e)]:
            if (k := index(sums, b - s)) is not None:
                if b > pending:
                    done.append(encode(pending, b))
                tail, tail_at, tail_sums, pending = ids[k:], b, sums[k:] - (b - s), None
                break
    done.append(tail if pending is None else encode(pending, len(data)))
    return np.concatenate(done)


def encode_documents(docs: DataFrame, tokenizer_path: str, bits: int = 10, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text; one row for each row of docs.

    Columns: doc_id, n_tokens, ids_sha256 (of the ids as little-endian uint32), decoded_sha256 (of the decoded text's
    UTF-8) and, with keep_ids, ids (array) and decoded (string). A null text is empty; an empty text has no ids and
    decodes to the empty text. Null and repeated doc_ids and repeated rows are kept as they are. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(packed, pa.binary())], names=["doc_id", "th", "z"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            data, offsets = text_bytes(batch.column("text"))
            whole = data.tobytes()
            hashes, rows = [], []
            for i, ends in enumerate(cut_chunks(data, offsets, bits)):
                base, last, mine = int(offsets[i]), 0, set()
                for end in ends:
                    mine.add(_digest(whole[base + last : base + end]))
                    last = end
                hashes += mine
                rows += [i] * len(mine)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), batch.column("th").take(take), batch.column("doc_id").take(take)], names=["h", "th", "doc_id"])

    def chunks_of(packed: bytes, z: zstandard.ZstdDecompressor) -> tuple[bytes, list[int], list[bytes]]:
        data = z.decompress(packed)
        raw = np.frombuffer(data, np.uint8)
        ends = cut_chunks(raw, np.array([0, len(raw)]), bits)[0]
        return data, ends, [_digest(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, z = codec(tokenizer_path), zstandard.ZstdDecompressor()
        for batch in batches:
            hashes, ids = [], []
            for packed, wanted in zip(batch.column("z").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                wanted = set(wanted)
                data, ends, digests = chunks_of(packed, z)
                for a, b, h in zip([0, *ends], ends, digests, strict=False):
                    if h in wanted:
                        wanted.discard(h)
                        got = own.encode(data[a:b].decode("utf-8"))
                        small = len(got) == 0 or int(got.max()) < 1 << 16
                        hashes.append(h)
                        ids.append(b"\0" + got.astype("<u2").tobytes() if small else b"\1" + got.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], names=["h", "ids"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, z = codec(tokenizer_path), zstandard.ZstdDecompressor()
        for batch in batches:
            counts, id_sums, text_sums, all_ids, texts = [], [], [], [], []
            for packed, have in zip(batch.column("z").to_pylist(), batch.column("known").to_pylist(), strict=True):
                if have:
                    known = {x["h"]: np.frombuffer(x["ids"], "<u4" if x["ids"][0] else "<u2", offset=1).astype(np.uint32) for x in have}
                    data, ends, digests = chunks_of(packed, z)
                    ids = assemble(own, data, ends, [known.get(h) for h in digests])
                else:
                    ids = own.encode(z.decompress(packed).decode("utf-8"))
                decoded = own.decode(ids)
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids.tolist())
                    texts.append(decoded)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            more = [pa.array(all_ids, pa.list_(pa.int64())), pa.array(texts, pa.string())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    # The filter, which drops nothing, is what the inner join would add; so both joins have the same exchange.
    texts = rows.mapInArrow(squeeze, "doc_id long, th long, z binary").filter("th is not null")
    seen = stage(rows.mapInArrow(index, "h binary, th long, doc_id long").groupBy("h", "th").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "chunks")
    shared = seen.groupBy("h").agg(F.sum("n").alias("n"), F.min(F.struct("th", "doc_id")).alias("owner")).filter("n > 1")
    owners = shared.groupBy("owner").agg(F.collect_list("h").alias("wanted")).select(F.col("owner.th").alias("th"), F.col("owner.doc_id").alias("owner_id"), "wanted")
    # The owner's copies have its text too, but only the owner encodes. Not written as an equality, which would become a
    # join key; neither is a number taken from another, as ids may be any.
    apart = (F.col("owner_id") < F.col("doc_id")) | (F.col("owner_id") > F.col("doc_id"))
    mine = F.coalesce(~apart, F.col("owner_id").isNull() & F.col("doc_id").isNull())
    once = texts.join(owners.hint("merge"), "th").filter(mine).select("z", "wanted").mapInArrow(encode_owned, "h binary, ids binary")
    ids = once.groupBy("h").agg(F.first("ids").alias("ids"))
    known = seen.select("h", "th").join(ids, "h").groupBy("th").agg(F.collect_list(F.struct("h", "ids")).alias("known"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids
    return texts.join(known.hint("merge"), "th", "left").select("doc_id", "z", "known").mapInArrow(finish, kinds)
