import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logfathom.llm._bpe import codec
from logfathom.llm.bpe_chunks import assemble, cut_chunks, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_is_the_library(library):
    """Every character in several surroundings, and what both could stumble over."""
    own = codec(PATH)
    assert own.plain
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["日", "😀", "\U0001d54f"]
    texts = [f"a{c}b 1{c} {c}{c}x  {c}" for c in chars] + [" " * 5000 + "b", "\n" * 3000, "é" * 3000, "<|endoftext|>x<|endoftext|>", "", "I'll  don't\n\n x "]
    want = library.encode_batch(texts, add_special_tokens=False)
    for t, w in zip(texts, want, strict=True):
        ids = own.encode(t)
        assert ids.tolist() == w.ids
        assert own.decode(ids) == library.decode(w.ids, skip_special_tokens=False)


def test_joints(library):
    own, rng = codec(PATH), random.Random(1)
    parts = ["the ", "  ", "\n\n", "é", "a", "don't", " we'll", "<|endoftext|>", "123 ", "!!", " \t", "日本", " ", "x" * 50, "re", "' s", ". "]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 150)))
        data = text.encode()
        cuts = sorted({c for c in (rng.randrange(len(data)) for _ in range(10)) if c and data[c] & 0xC0 != 0x80})
        ends = [*cuts, len(data)]
        known = [own.encode(data[a:b].decode()) if rng.random() < 0.6 else None for a, b in zip([0, *ends], ends, strict=False)]
        assert assemble(own, data, ends, known).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks(prose):
    data = (prose(3000, 1) + "x" * 50_000 + "é" * 20_000).encode()
    raw = np.frombuffer(data, np.uint8)
    ends = cut_chunks(raw, np.array([0, len(raw)]))[0]
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= 16388 and sizes[:-1].min() >= 128
    b"".join(data[a:b].decode().encode() for a, b in zip([0, *ends], ends, strict=False))  # no character is cut
    shifted = cut_chunks(np.frombuffer(b"new start " + data, np.uint8), np.array([0, len(raw) + 10]))[0]
    assert len({e - 10 for e in shifted} & set(ends)) > len(ends) / 2


def test_documents(spark, docs, documents, empty, library):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, PATH).collect()), key=str)
    want = []
    for i, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_documents(empty, PATH).count() == 0
    kept = encode_documents(docs, PATH, keep_ids=True).collect()
    assert all(len(r.ids) == r.n_tokens for r in kept)
