"""Snapshots of incremental ingest: what becomes of changed, emptied, removed and renamed files, and of broken calls."""

import os

import pytest
from pyspark.sql import functions as F

from logfathom.functions import predicates as P
from logfathom.operators import parsing as X
from logfathom.sources import files as S
from logfathom.sources import index as I


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, n in (("a b.log", 3), ("b.log", 2), ("c.log", 4)):
        (folder / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    return folder


def ingest(spark, logs, store, parse=X.parse_raw):
    return S.ingest_incremental(spark, f"{logs}/*.log", str(store), parse, "raw")


def texts(df):
    return sorted(r.text for r in df.collect())


def expected(logs):
    return sorted(x for p in logs.glob("*.log") for x in p.read_text().split("\n") if x)


def change(path, text, step):
    path.write_text(text)
    os.utime(path, (1_800_000_000 + step, 1_800_000_000 + step))


def test_files_come_and_go(spark, logs, tmp_path):
    store = tmp_path / "store"
    first = {r.text: r.generation for r in ingest(spark, logs, store).collect()}
    assert sorted(first) == expected(logs)
    change(logs / "b.log", "", 1)  # emptied
    (logs / "c.log").unlink()  # removed
    (logs / "a b.log").rename(logs / "d.log")  # renamed
    change(logs / "e.log", "new\n", 2)
    got = ingest(spark, logs, store)
    assert texts(got) == expected(logs) == ["a b.log 0", "a b.log 1", "a b.log 2", "new"]
    change(logs / "b.log", "back\n", 3)
    again = {r.text: r.generation for r in ingest(spark, logs, store).collect()}
    assert sorted(again) == expected(logs) and again["new"] == {r.text: r.generation for r in got.collect()}["new"] != again["back"]
    assert texts(S.snapshot(spark, str(store))) == expected(logs)
    assert S.vacuum(spark, str(store)) > 0 and texts(S.snapshot(spark, str(store))) == expected(logs) and S.vacuum(spark, str(store)) == 0


def test_nothing_new_writes_nothing(spark, logs, tmp_path):
    store = tmp_path / "store"
    ingest(spark, logs, store)
    before = sorted(str(p) for p in store.rglob("*"))
    assert texts(ingest(spark, logs, store)) == expected(logs) and sorted(str(p) for p in store.rglob("*")) == before


@pytest.mark.parametrize("broken", ["lines", "manifest"])
def test_a_broken_call_changes_nothing(spark, logs, tmp_path, broken):
    """Broken off after its lines, and in the middle of its manifest: readers see the version before, and the next call
    does the work again."""
    store = tmp_path / "store"
    ingest(spark, logs, store)
    old = expected(logs)
    change(logs / "b.log", "changed\n", 1)
    ingest(spark, logs, store)
    if broken == "lines":
        for p in (store / "manifest" / "v0000000002").iterdir():
            p.unlink()
        (store / "manifest" / "v0000000002").rmdir()
    else:
        (store / "manifest" / "v0000000002" / "_SUCCESS").unlink()
    assert texts(S.snapshot(spark, str(store))) == old
    assert texts(ingest(spark, logs, store)) == expected(logs)


def test_all_files_empty(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("")
    got = ingest(spark, folder, tmp_path / "store")
    assert got.count() == 0 and {"stream", "line_no", "text", "ts", "level"} <= set(got.columns)
    change(folder / "a.log", "x\n", 1)
    assert ingest(spark, folder, tmp_path / "store").select(F.col("text")).collect()[0][0] == "x"


def test_index_is_kept_up(spark, tmp_path):
    """Searches of the index find what a scan finds, in few of the files, through all rounds of a table."""
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    for i in range(60):
        (folder / f"{i:02}.log").write_text("".join(f"user_{i * 10 + j} did Café-work {j}\n" for j in range(10)) + ("needle42 in Größe\n" if i == 17 else ""))
    terms = [("needle4", False), ("needle42", True), ("needle4", True), ("cafe", False), ("user_17", False), ("did café work", True), ("work 7", False), ("grosse", False), ("größe", True), ("nowhere", False), ("!!", False), ("x" * 80, False)]

    def agree():
        table = S.snapshot(spark, store)
        for value, whole in terms:
            want = texts(table.filter(P.phrase(value) if whole else P.term(value)))
            assert texts(I.indexed_search(spark, store, value, whole)) == want, value

    S.ingest_incremental(spark, f"{folder}/*.log", store, X.parse_raw, "raw", index=True)
    agree()
    files = S.snapshot(spark, store).select("stream").distinct().count()
    assert len(I.candidate_files(spark, store, "needle42")) == 1 <= 0.05 * files
    (folder / "17.log").unlink()
    change(folder / "03.log", "needle43 here\n", 1)
    change(folder / "99.log", "y" * 70 + " " + "x" * 90 + "\n", 2)
    S.ingest_incremental(spark, f"{folder}/*.log", store, X.parse_raw, "raw", index=True)
    agree()
    assert texts(I.indexed_search(spark, store, "needle4")) == ["needle43 here"] and len(texts(I.indexed_search(spark, store, "x" * 80))) == 1
    S.vacuum(spark, store)
    agree()
