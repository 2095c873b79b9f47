import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, rid string, text_key string, copies long, words string, bucket int"


def rows(items):
    """documents with extra columns whose names the operators use inside."""
    return [(i, t, "en", "s", len(t or ""), "th", "rid", "key", 7, "w", 1) for i, t in items]


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, by number."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(["ba", "ko", "ti", "re", "nu", "sé", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(800)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) + ("\n" if r.random() < 0.05 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Ordinary texts, exact and near copies, shared passages, and every edge: null, empty, blank, one word, very long, no
    spaces, repeated rows, repeated and null doc_ids."""
    base = {i: prose(60 + 13 * i, i) for i in range(12)}
    near = base[3].split(" ")
    near[10] = "changed"
    passage = prose(40, 99)
    items = list(base.items()) + [
        (20, base[2]), (21, base[2]), (22, " ".join(near)), (23, base[4] + " " + passage), (24, passage + " " + base[5]), (25, passage + passage),
        (30, None), (31, ""), (32, " \n\t "), (33, "word"), (34, "don't  stop<|endoftext|> 日本 123"), (35, prose(20000, 5)), (36, "x" * 30000), (37, "!?### $$"),
        (40, base[6]), (40, base[6]), (41, base[7]), (41, base[8]), (None, base[9]), (None, "a b"), (None, None), (-5, base[1]),
    ]
    return items


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(rows(documents), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
