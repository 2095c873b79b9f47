import base64
import hashlib
import io
import zipfile

from logfathom.llm._shared import fresh_path
from logfathom.llm.warc_zip import DATA, archive_pages, directory, read_packages, write_packages

SCHEMA = "page_id long, url string, html string, sha string, first string"


def test_records(spark):
    items = [(5, "u", "a"), (3, "u\n v", None), (1, None, "a"), (None, "x", "a"), (9, "x", ""), (1, "y", "a"), (None, "z", "q"), (None, "z", "q"), (7, "long", "é" * 200_000)]
    df = spark.createDataFrame([(*x, "s", "f") for x in items], SCHEMA)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_pages(df).collect()), key=str)
    want = []
    for i, _, html in items:
        raw = (html or "").encode()
        first = {"a": 1, "": 3}.get(html or "")
        kind = "revisit" if first is not None and i != first else "response"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    assert archive_pages(df.limit(0)).count() == 0
    assert {r.record_type for r in archive_pages(df, revisit_from=1).collect() if r.page_id in (3, 9)} == {"response"}


def test_packages_are_zip_files(spark):
    path = fresh_path(spark, "warc")
    files = write_packages(spark.createDataFrame([(i, "u", f"<p>{i}") for i in range(50)], "page_id long, url string, html string"), path, most_bytes=2000)
    names = [r.file for r in files.collect()]
    assert len(names) > 2
    for n in names:
        z = zipfile.ZipFile(n.removeprefix("file://"))
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    assert sorted(r.payload for r in read_packages(files, payloads=True).collect()) == sorted(f"<p>{i}".encode() for i in range(50))


def test_directory(monkeypatch):
    """Plain and ZIP64 directories, comments that look like an end record, compressed members left out."""
    for wide in (False, True):
        if wide:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(DATA, "some stored bytes, more than ten")
            z.writestr("b", "y" * 99, zipfile.ZIP_DEFLATED)
            z.writestr("ç", "z" * 30)
            z.comment = b"PK\5\6 not the end"
        raw = out.getvalue()
        found = directory(lambda at, n, raw=raw: raw[at : at + n], len(raw))
        assert {k: raw[a : a + n] for k, (a, n) in found.items()} == {DATA: b"some stored bytes, more than ten", "ç": b"z" * 30}
