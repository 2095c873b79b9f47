import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as c
    from logfathom.llm._shared import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, seen = docs.columns, []
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, f in c.STAGES[:-1]:
        docs = stage(f(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, near, cut, mixed = seen
    assert sum(r.toxic == 0 for i, r in labels.items() if i in toxic) == sum(r.toxic == 0 for r in labels.values())
    assert len({r.text for r in near.values()}) == len(near) and {r.text for r in toxic.values()} >= {r.text for r in near.values()}
    assert set(cut) == set(near) and all(len(cut[i].text.split()) <= len(near[i].text.split()) for i in cut)
    assert set(mixed) <= set(cut)
    last = c.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and {r.decoded_sha256 for r in last} == {hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.values()}
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "encoding"]


def test_edges(spark, docs, documents, empty, prose, tmp_path):
    """Every stage over nulls, empty and long texts, ties, repeated rows, clashing columns; and over an empty table."""
    import corpus_pipeline as c

    labels = [(i, 1, 0) for i in range(12)] + [(200, 0, 1), (None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    every, stages = sorted((i for i, _ in documents), key=str), dict(c.STAGES)
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == every
    near = stages["near_dedup"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns and {30, 31, 32, 33, 35}.issubset(ids(near)) and not {20, 21, 22}.intersection(ids(near)) and ids(near).count(None) == 2
    cut = stages["substring_dedup"](spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and ids(cut) == every
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[30] == texts[31] == texts[20] == "" and texts[33] == "word" and texts[32] == " \n\t "
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(every)
    assert ids(stages["encoding"](spark, docs, str(tmp_path))) == every
    for name, f in c.STAGES:
        out = f(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "encoding" or out.columns == empty.columns)
