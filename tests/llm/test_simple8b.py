import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logfathom.llm.simple8b import BLOCK, pack, token_files, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def round_trip(ids):
    words, counts = pack(np.array(ids, np.uint64))
    sizes = np.full(len(counts), BLOCK)
    if len(sizes):
        sizes[-1] = len(ids) - BLOCK * (len(counts) - 1)
    return words, unpack(words, counts, sizes)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 63).flatmap(lambda b: st.integers(0, 2 ** (b + 1) - 1)), max_size=300), st.integers(1, 12))
def test_round_trip(ids, times):
    ids = ids * times
    assert round_trip(ids)[1].tolist() == ids


def test_widths():
    for n in (0, 1, 119, 120, 121, BLOCK, BLOCK + 1, 3 * BLOCK):
        assert round_trip([0] * n)[1].tolist() == [0] * n
    words, back = round_trip([50_000] * BLOCK)
    assert len(words) == -(-BLOCK // 3) and back.tolist() == [50_000] * BLOCK
    top = [2**64 - 1, 2**60 - 1, 2**60, 15 << 60, 0, 1]
    assert round_trip(top * 300)[1].tolist() == top * 300


def test_files(docs, documents, empty):
    library = Tokenizer.from_file(PATH)
    items = [x for x in documents if x[0] not in (41, None)]
    got = sorted(tuple(r) for r in token_files(docs.filter("doc_id <> 41"), PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, start = [], 0
    for i, t in sorted(items, key=lambda x: x[0]):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    whole = token_files(docs, PATH).collect()
    assert len(whole) == len(documents) and max(r.start for r in whole if r.doc_id is not None) < min(r.start for r in whole if r.doc_id is None)
    assert token_files(empty, PATH).count() == 0
