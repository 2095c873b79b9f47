"""Words, word hashes and word-window hashes of a batch of texts, in numpy.

A word is a maximal run of bytes other than space and 0x09..0x0D. A word's hash takes its bytes eight at a time, each
step through a mixer that no sum or product of the bytes gets around; a word of more than 128 bytes goes to BLAKE2b. A
window's hash is a tree of pairs of hashes, mixed at every level. Two lanes with keys of their own make 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case, and what lies between terms: ASCII other than digits and letters.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_GAP = np.zeros(256, bool)
_GAP[:0x80] = True
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
_LONG = 128  # bytes of a word from which BLAKE2b hashes it
_KEYS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_RIGHT = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each text the index of its first word (one more than texts)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    starts = np.flatnonzero(ink & (~before | cut[:-1]))
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms (maximal runs of ASCII digits and letters, A-Z in lower case, and of anything beyond ASCII), and
    for each text the index of its first term. No hash is 0."""
    data = _FOLD[data]
    starts, ends, first = word_spans(data, offsets, _GAP)
    return np.maximum(word_hashes(data, starts, ends), np.uint64(1)), first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash for each word, keyed by the lane."""
    key = np.uint64(_KEYS[lane])
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + key)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every byte on
    live, at = np.flatnonzero(lengths <= _LONG), 0
    if len(live) == len(starts):
        live = np.arange(len(starts))
    while len(live):
        left = np.minimum(lengths[live] - at, 8).astype(np.uint64)
        part = eights[starts[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        out[live] = mix(out[live] + mix(part ^ key))
        at += 8
        live = live[lengths[live] > at]
    for i in np.flatnonzero(lengths > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=_KEYS[lane].to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two hashes in this order."""
    return mix(left + mix(right ^ _RIGHT))


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text; the text's index and the window's first word in it."""
    counts = np.maximum(0, np.diff(first) - size + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    n = len(words) - size + 1
    if n <= 0 or len(doc) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs[i]: the hash of the ``width`` words from i on; the window is put together from widths that are powers of two.
    runs, width, whole, have = words, 1, None, 0
    while True:
        if size & width:
            whole = runs[:n] if whole is None else pair(whole, runs[have : have + n])
            have += width
        if have == size:
            break
        runs = pair(runs[: len(runs) - width], runs[width:])
        width *= 2
    return whole[first[:-1][doc] + pos], doc, pos
