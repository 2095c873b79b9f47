"""Extreme ids, and words that sums of powers can't tell apart, in the operators."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logfathom.llm import _shared
from logfathom.llm._words import text_bytes, window_hashes, word_hashes, word_spans
from logfathom.llm.bpe_chunks import encode_documents
from logfathom.llm.language_id import fit_dictionaries, identify
from logfathom.llm.mixing import mix
from logfathom.llm.oph_fingerprint import fingerprint_documents
from logfathom.llm.probminhash import near_duplicates
from logfathom.llm.quality_rules import quality_filter
from logfathom.llm.simple8b import token_files
from logfathom.llm.substring_dedup import dedup_passages
from logfathom.llm.toxicity import fit, grade_documents
from logfathom.llm.warc_zip import archive_pages

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def thue_morse(n, letters="ab"):
    """A word and its complement: equal under every polynomial hash mod 2**64, from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [16, 64, 128, 129, 1024, 4096])
def test_word_hashes_tell_words_apart(n):
    import pyarrow as pa

    data, offsets = text_bytes(pa.array([*thue_morse(n), "a" * n, "a" * (n - 1), "b" + "a" * (n - 1), "a" * (n - 1) + "b"]))
    starts, ends, _ = word_spans(data, offsets)
    for lane in (0, 1):
        h = word_hashes(data, starts, ends, lane)
        assert len(set(h.tolist())) == 6
    assert (word_hashes(data, starts, ends, 0) != word_hashes(data, starts, ends, 1)).all()


def test_windows_in_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000).astype(np.uint64)  # few kinds, so that many windows are permutations of others
    for size in (1, 2, 5, 7, 10, 20):
        h, doc, pos = window_hashes(words, np.array([0, 1500, 1503, 4000]), size)
        keys = [tuple(words[[0, 1500, 1503][d] + p : [0, 1500, 1503][d] + p + size].tolist()) for d, p in zip(doc, pos, strict=True)]
        assert len(set(zip(keys, h.tolist(), strict=True))) == len(set(keys)) == len(set(h.tolist()))


def test_colliding_words(spark, prose):
    """19 common words and a long one that differs: no passage of 20 words is shared, and one changed word of 21."""
    common = " ".join(f"w{i}" for i in range(19))
    a, b = thue_morse(2048)
    df = spark.createDataFrame([(1, f"{common} {a}"), (2, f"{common} {b}"), (3, f"{a} x y z v"), (4, f"{b} x y z v")], "doc_id long, text string")
    assert [r.n_removed for r in dedup_passages(df).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    assert [r.class_id for r in near_duplicates(df).orderBy("doc_id").collect()][2:] == [3, 4]


def test_extreme_ids(spark, prose):
    items = [(HIGH, prose(60, 1)), (-5, prose(60, 1)), (None, prose(60, 1)), (-1, prose(60, 1)), (LOW, prose(60, 2)), (HIGH - 1, None), (0, prose(60, 3))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in items], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(HIGH, 0, "good"), (LOW, 2, "low"), (-1, 1, "low"), (None, 1, "good")], "doc_id long, grade int, domain string")
    library = Tokenizer.from_file(PATH)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in encode_documents(df, PATH).collect()), key=str)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in items]
    assert got == sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for (i, _), x in zip(items, ids, strict=True)), key=str)
    removed = {r.doc_id: r.n_removed for r in dedup_passages(df).collect()}
    assert removed == {HIGH: 60, -5: 0, None: 60, -1: 60, LOW: 0, HIGH - 1: 0, 0: 0}
    classes = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert classes == {HIGH: -5, -5: -5, None: -5, -1: -5, LOW: LOW, HIGH - 1: HIGH - 1, 0: 0}
    every = [
        fingerprint_documents(df), grade_documents(df, fit(df, labels)), identify(df, fit_dictionaries(df)), quality_filter(df), token_files(df, PATH),
        mix(df, labels.select("doc_id", "domain"), {"good": 0.5, "low": 0.5}),
    ]
    for found in every:
        assert sorted((r.doc_id for r in found.collect()), key=str) == sorted((i for i, _ in items), key=str)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"))
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in archive_pages(pages).collect()}
    assert kinds[HIGH] == kinds[-1] == ("revisit", -5) and kinds[-5] == kinds[LOW] == ("response", None)


def test_shared_folder_must_be_named(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Session())
