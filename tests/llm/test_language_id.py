import random
import re

import zstandard

from logfathom.llm.language_id import Classifier, fit_dictionaries, identify

PARTS = {"en": ["the", "ing", "tion", "er", "and", "sh", "ly"], "de": ["der", "sch", "ung", "keit", "ver", "ß", "ein"], "fr": ["le", "eau", "ment", "é", "que", "oi", "ç"]}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_held_out(spark):
    train = [(i, text(lang, 80, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)] + [(900, text("en", 50, 1), None), (901, None, "en")]
    found = fit_dictionaries(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert set(found) == {"en", "de", "fr"} and all(len(d) <= 110_000 for d in found.values())
    test = [(1000 + i, text(lang, 40, 5000 + i), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), found).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 57
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, docs, documents, empty):
    found = fit_dictionaries(docs)
    got = identify(docs, found).collect()
    assert len(got) == len(documents)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and not by_id[i].accepted for i in (30, 31, 32, 37))
    assert by_id[33].lang_pred == "en"
    assert identify(empty, found).count() == 0
    assert fit_dictionaries(empty) == {}
    assert Classifier({})("text") == ("und", 0.0)


def test_against_brute_force(spark):
    """The smallest of plain zstandard encodings with each dictionary; ties go to the most frequent language."""
    train = [(i, text(lang, 60, i), lang) for i, lang in enumerate(["en", "de", "fr", "de"] * 20)]
    found = fit_dictionaries(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert list(found)[0] == "de"
    texts = [text(lang, n, 900 + n) for n in (1, 2, 3, 8, 40, 400) for lang in PARTS] + ["zz", "x", "ÄÖÜ 12", "a\tb", "the der le " * 5000]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), found).collect()}
    for i, t in enumerate(texts):
        raw = " ".join(re.findall(r"[^\W\d_]+", t.lower())).encode()
        sizes = []
        for d in found.values():
            own = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            level = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            own.precompute_compress(compression_params=level)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=own, compression_params=level).compress(raw)))
        assert got[i].lang_pred == list(found)[sizes.index(min(sizes))]
        first, second = sorted(sizes)[:2]
        assert abs(got[i].score - (1 - first / second)) < 1e-12 and got[i].accepted == (1 - first / second >= 0.01)
