"""Facts that follow from how small logs are made."""

import gzip
import os
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logfathom.functions import predicates as P
from logfathom.functions.dialect import BadPattern, rewrite
from logfathom.functions.redaction import find_sensitive, redact
from logfathom.functions.values import PLACEHOLDER, normalize_level, parse_timestamp, template_of, to_num
from logfathom.operators import aggregates as A
from logfathom.operators import diagnostics as D
from logfathom.operators import parsing as X
from logfathom.operators import patterns as T
from logfathom.operators import records as R
from logfathom.operators import timeline as M
from logfathom.operators import views as V
from logfathom.sources import files as S
from logfathom.streaming import tail as W

LEVELS = ["INFO", "INFO", "INFO", "WARN", "ERROR", "DEBUG"]


def app_log(n):
    at = lambda i: (datetime(2024, 1, 1) + timedelta(seconds=i)).strftime("%Y-%m-%d %H:%M:%S")
    return [f"{at(i)} [{LEVELS[i % 6]}] worker-{i % 7} request {i} took {i % 900}ms" for i in range(n)]


def raw(spark, lines, stream="a"):
    return spark.createDataFrame([(stream, i, x) for i, x in enumerate(lines)], "stream string, line_no long, text string")


def lines_of(spark, lines, parse=X.parse_timestamped):
    return T.with_templates(R.assign_records(parse(raw(spark, lines))))


def one(df):
    return df.collect()[0]


def values(spark, f, items, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def test_app_log(spark):
    lines = lines_of(spark, app_log(5000)).cache()
    assert lines.filter(P.level_cmp("eq", "err")).count() == 833
    assert lines.filter(P.ts_cmp("lt", "2024-01-01T00:01Z")).count() == 60
    dur = P.Capture("dur", r"(\d+)ms")
    assert lines.filter(P.capture_cmp(dur, "gt", 500)).count() == sum(i % 900 > 500 for i in range(5000))
    facet = A.capture_facet(lines, dur).collect()
    assert len(facet) == 25 and facet[0]["distinct_count"] == 900 and facet[0]["covered"] == 5000
    assert sum(r["total"] for r in A.time_histogram(lines).collect()) == 5000
    assert lines.filter(P.term("request 49")).count() == sum(str(i).startswith("49") for i in range(5000))
    assert lines.filter(P.phrase("request 49")).count() == 1


def test_json(spark):
    at = lambda i: (datetime(2024, 6, 1) + timedelta(minutes=i)).isoformat() + "Z"
    rows = []
    for i in range(1000):
        user = f',"user":"u{i}"' if i % 3 == 0 else ""
        rows.append(f'{{"timestamp":"{at(i)}","level":"{"error" if i % 10 == 0 else "info"}","message":"m","http":{{"status":{503 if i % 20 == 0 else 200},"path":"{"/api/x" if i % 2 else "/web"}"}}{user}}}')
    lines = lines_of(spark, rows, X.parse_json).cache()
    count = lambda p: lines.filter(p).count()
    assert count(P.field_eq("http.status", "503")) == 50
    assert count(P.field_cmp("http.status", "lt", 500)) == 950
    assert count(P.field_like("http.path", "/API/*")) == 500
    assert count(P.field_exists("user")) == 334
    both = P.any_of(P.level_cmp("eq", "error"), P.field_eq("http.status", "503"))
    assert count(P.all_of(both, P.negate(P.field_exists("user")))) == 66
    assert one(X.detect_format(raw(spark, rows)))["format"] == "json"


def test_json_corners():
    assert dict(X.flatten_json('{"a":1.0,"b":[1,{"c":null}],"d":1e21,"e":{},"f":true,"a":2.50,"g":1e-7,"h":0.00001}')) == {"a": "2.5", "b[0]": "1", "b[1].c": "", "d": "1e+21", "f": "true", "g": "1e-7", "h": "0.00001"}
    assert X.flatten_json('{"a":NaN}') is None and X.flatten_json("[1]") is None and X.flatten_json("{") is None


def test_levels_and_numbers(spark):
    assert values(spark, normalize_level, ["warning", " SEVERE ", "crit", "vrb", "what", None]) == ["WARN", "ERROR", "FATAL", "TRACE", None, None]
    assert values(spark, to_num, ["5", "-1.5e3", "5d", "NaN", "", "1."]) == [5.0, -1500.0, None, None, None, None]


def test_timestamps(spark):
    ms = lambda c: F.unix_millis(parse_timestamp(c, 2023))
    got = values(spark, ms, ["2024-01-31T13:45:01.123Z", "2024-01-31 13:45:01,5+02:00", "31/Jan/2024:13:45:01 +0200", "Jan 31 13:45:01", "1706708701", "1706708701.25", "1706708701123", "2024-02-31 00:00:00", "junk", None])
    assert got == [1706708701123, 1706701501500, 1706701501000, 1675172701000, 1706708701000, 1706708701250, 1706708701123, 1709337600000 - 86400000 + 86400000, None, None]


def test_ts_precision():
    day = 86400000
    assert P.ts_range("2024-01")[1] - P.ts_range("2024-01")[0] == 31 * day
    assert P.ts_range("2024-01-31") == (1706659200000, 1706659200000 + day)
    assert P.ts_range("2024-01-31T10:30")[1] - P.ts_range("2024-01-31T10:30")[0] == 60000
    assert P.ts_range("2024-01-31 10:30:15+01:00") == (1706693415000, 1706693416000)
    with pytest.raises(ValueError):
        P.ts_range("soon")


def test_stack_trace(spark):
    text = ["2024-01-01 00:00:00 [INFO] a - start", "2024-01-01 00:00:01 [ERROR] a - failed", "java.lang.X: boom", "\tat a.b(C.java:1)", "Caused by: y", "\t... 3 more", "2024-01-01 00:00:02 [INFO] a - end"]
    lines = lines_of(spark, text)
    assert [(r["head"], r["span"]) for r in R.records(lines).orderBy("head").collect()] == [(0, 1), (1, 5), (6, 1)]
    hit = one(R.grouped(lines, P.line_regex("caused")))
    assert (hit["head"], hit["level"], hit["text"]) == (1, "ERROR", "\n".join(text[1:6]))
    assert one(V.count_matches(lines, P.line_regex("java|y$"), grouped=True))["n"] == 1
    assert {r["line_no"]: r["record"] is not None for r in R.record_detail(lines, lines.filter("line_no in (0, 1, 4)")).collect()} == {0: False, 1: True, 4: False}


def test_clusters(spark):
    text = [f"GET /a/{i} took {i}ms" for i in range(30)] + [f"connection {i} failed" for i in range(10)] + ["OOM now"] * 5
    got = T.clusters(lines_of(spark, text, X.parse_raw)).collect()
    assert [(r["pattern"], r["count"]) for r in got] == [("GET <*> took <*>", 30), ("connection <*> failed", 10), ("OOM now", 5)]
    assert (got[0]["distinct_count"], got[0]["covered"]) == (3, 45)


def test_templates(spark):
    long = " ".join(["w"] * 100)
    got = values(spark, template_of, ["id 1 2 3 done", "x deadbeefdeadbeef y", "deadbeef", long, ""])
    assert got == ["id <*> done", "x <*> y", "deadbeef", " ".join(["w"] * 80) + " …", ""]


def test_templates_token_by_token(spark):
    """Against the rule itself: split, mask, merge, cut."""
    import random

    rng, parts = random.Random(7), ["a", "b1", "<*>", "<*>x", "x<*>", "7", "deadbeefdeadbeef", "DEADBEEFDEADBEEFg", "é٣", "deadbeef", "$1", "\\", "", "\t", "\u00a0"]
    lines = ["".join(rng.choice(parts) + rng.choice([" ", " ", "  ", "\t", "\u3000", ""]) for _ in range(rng.choice([3, 9, 300]))) for _ in range(400)] + ["<*> " * 3 + "<*>x", "1 " * 3000, None, " "]

    def rule(line):
        masked = [PLACEHOLDER if re.search(r"[0-9]|^[0-9a-fA-F]{12,}$", t) else t for t in re.split("[ \t\u00a0\u3000]+", line[:4096]) if t]
        kept = [t for i, t in enumerate(masked) if not (t == PLACEHOLDER and i and masked[i - 1] == PLACEHOLDER)]
        return " ".join([*kept[:80], "…"] if len(kept) > 80 else kept)

    assert values(spark, template_of, lines) == [None if x is None else rule(x) for x in lines]


def test_a_line_s_template_is_computed_once(spark):
    """A template stands in one step of the plan and has no function that runs token by token there."""
    lines = T.with_templates(spark.createDataFrame([("a", 0, "x 1", True)], "stream string, line_no long, text string, is_head boolean"))
    counted = lines.select("stream", "line_no", F.inline(F.array(F.struct(F.col("template").alias("pattern"))))).filter("pattern is not null")
    assert T.templates(lines).collect() == [(0, "x <*>", 1)] and counted.count() == 1
    plan = lines.select("template")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3 and "split(" not in plan and "filter(" not in plan


def test_numeric_facet(spark):
    lines = lines_of(spark, [f"level=INFO duration={i} status={200 if i % 5 else 500} msg=req{i}" for i in range(100)], X.parse_logfmt)
    got = A.numeric_facet(lines, "duration", 10).collect()
    assert len(got) == 10 and sum(r["n"] for r in got) == 100 and (got[0]["min"], got[0]["max"], got[0]["p50"]) == (0, 99, 50)
    assert A.numeric_facet(lines, "msg", 10).count() == 0
    assert one(D.duration_field(lines))["key"] == "duration"


def test_logfmt(spark):
    got = one(X.parse_logfmt(raw(spark, [r'time=2024-01-01T00:00:00Z level=warn msg="a \"b\" c" k=1 k=2 e="" f=']))).fields
    assert got == {"time": "2024-01-01T00:00:00Z", "level": "warn", "msg": 'a "b" c', "k": "2", "e": "", "f": ""}


def test_correlate(spark):
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        host = ("web-01" if i % 25 == 0 else "web-03") if bad else f"web-0{i % 4}"
        rows.append(f"level={'error' if bad else 'info'} host={host} status={503 if bad else 200} msg=m{i}")
    got = {r["field"]: r for r in D.correlate(lines_of(spark, rows, X.parse_logfmt), P.level_cmp("eq", "ERROR")).collect()}
    assert got["host"]["value"] == "web-03" and abs(got["host"]["share"] - 0.8) < 1e-9 and got["host"]["lift"] > 1.5
    assert got["status"]["value"] == "503" and "msg" not in got


def test_aggregate(spark):
    rows = []
    for i in range(60):
        bad = i % 10 == 0
        rows.append(f'{{"timestamp":"2024-01-01T00:{i:02d}:00Z","level":"{"error" if bad else "info"}","service":"{["api", "web", "db"][i % 3]}","status":{500 if bad else 200},"duration_ms":{i}}}')
    lines = lines_of(spark, rows, X.parse_json).cache()
    value = lambda *spec: {(r["group"], r["series"]): r["value"] for r in A.aggregate(lines, *spec).collect()}
    assert value(A.Group("field", "service")) == {("api", "all"): 20, ("web", "all"): 20, ("db", "all"): 20}
    assert value(A.Group(), A.Split("field", "status")) == {("all", "200"): 54, ("all", "500"): 6}
    assert [value(A.Group(), None, A.Metric(m, "duration_ms"))[("all", "all")] for m in ("sum", "avg", "p50", "p95", "min", "max")] == [1770, 29.5, 30, 56, 0, 59]
    assert value(A.Group("field", "service"), A.Split("level"))[("api", "ERROR")] == 2
    assert A.aggregate(lines.filter("false")).count() == 0
    with pytest.raises(ValueError):
        A.aggregate(lines, A.Group("field"))


def test_case_folding(spark):
    lines = lines_of(spark, ['{"host":"Web-01"}', '{"host":"web-01"}', '{"host":"É"}', '{"host":"é"}'], X.parse_json)
    assert lines.filter(P.field_eq("host", "WEB-01")).count() == 2
    got = A.facet(lines, "host").collect()
    assert [(r["value"], r["n"]) for r in got] == [("Web-01", 2), ("É", 1), ("é", 1)]
    assert lines.filter(P.negate(P.level_cmp("eq", "ERROR"))).count() == 0  # level is null on all lines
    assert lines.filter(P.negate(P.field_eq("nothing", "x"))).count() == 4


def test_terms(spark):
    lines = raw(spark, ["user_42 Café", "Xtimeout9", "connection failed", "failed connection", None])
    n = lambda p: lines.filter(p).count()
    assert (n(P.term("user_4")), n(P.term("cafe")), n(P.term("timeout")), n(P.term("!!"))) == (1, 1, 0, 0)
    assert (n(P.phrase("connection failed")), n(P.term("connection"))) == (1, 2)


def test_accents(spark):
    """Folded as a full-text index folds them: one mark on a Latin letter, precomposed or not; not two, not other scripts."""
    lines = raw(spark, ["Đà Nẵng phở", "ca\u0301fe\u0323 x", "ǎ ẏ ạ", "ộ", "ά", "αλφα"])
    n = lambda value, whole=True: lines.filter((P.phrase if whole else P.term)(value)).count()
    assert [n("a y a"), n("ạ Ẏ ǎ"), n("cafe x"), n("café x"), n("o"), n("ộ"), n("α"), n("ά"), n("Ά"), n("nang"), n("αλ", False)] == [1, 1, 1, 1, 0, 1, 0, 1, 1, 0, 1]


def test_captures(spark):
    lines = raw(spark, ["k=5 user_id=a", "none"])
    get = lambda c: [r[0] for r in lines.orderBy("line_no").select(c).collect()]
    assert get(P.capture("user_id", r"k=(\d) user_id=(?<user_id>\w+)")) == ["a", None]
    assert get(P.capture("x", r"k=(\d)")) == ["5", None]
    assert get(P.capture("x", r"k=\d")) == ["k=5", None]
    with pytest.raises(BadPattern):
        P.Capture("x", "(")
    with pytest.raises(BadPattern):
        P.Capture("1x", "a")


def test_dialect():
    assert rewrite(r"(?<req_id>\d+)(?: (?<opt>a*))?", sentinels=True).groups == (("req_id", 1, 0), ("opt", 3, 2))
    for bad in ("[a", "a)", r"(a)\1", "a\\"):
        with pytest.raises(BadPattern):
            rewrite(bad)


def test_dot_and_marks(spark):
    """The dot takes U+0085; a text may have the character that groups are told apart by."""
    for text, message in (("a\x85b", "a\x85b"), ("a\x01b", "a\x01b"), ("\x01", "\x01"), ("a\u2028b", None)):
        row = one(X.parse_timestamped(raw(spark, [f"2024-01-01 00:00:00 [INFO] {text}"])))
        assert (row.message == message and row.level == "INFO" and row.starts_record) if message else row.fields is None
    row = one(X.parse_pattern(raw(spark, ["x\x01=1 y"]), "p", r"(?<k>.+?)=(?<v>\d)(?: (?<w>y))?(?<z>q)?"))
    assert row.fields == {"k": "x\x01", "v": "1", "w": "y"}
    assert raw(spark, ["a\x85b", "a\nb", "a.b"]).filter(P.line_regex(r"a.b")).count() == 2 and raw(spark, ["a\x85b", "a.b"]).filter(P.line_regex(r"a[.]b")).count() == 1


@pytest.mark.parametrize("space", [" ", "\t", "\u00a0", "\ufeff", "\u2003", "\u2028", "\x0b"])
def test_guards_let_all_matches_through(spark, space):
    """A text that a category's pattern finds is masked, whatever kind of space it has."""
    texts = {"secret": [f"Bearer{space}abcdefghijkl", f"password{space}={space}hunter2", f"BEARER{space}{space}abcdefghijkl"], "card": ["4111 1111 1111 1111"], "ipv6": ["a::1", "fe80:0:0:0:1"], "ipv4": ["1.2.3.4"], "email": ["a@b.co"], "jwt": ["eyJa.b.c"], "token": ["a1" * 10]}
    for category, items in texts.items():
        found = values(spark, lambda c: find_sensitive(c), [f"x{space}{t}{space}y" for t in items])
        masked = values(spark, redact, [f"x{space}{t}{space}y" for t in items])
        assert all(category in f for f in found) and not any(t in m for t, m in zip(items, masked, strict=True))
    assert "abcdefghijkl" not in values(spark, redact, [f"Bearer{space}abcdefghijkl"])[0]


def test_redaction(spark):
    cases = {
        "mail a.b@example.com": "mail [email]", "at 10.0.0.1 and 300.1.1.1": "at [ip] and 300.1.1.1", "password=hunter2 x": "password=[secret] x",
        "Authorization: Bearer abcdefgh12": "Authorization: [secret] abcdefgh12", "card 4111 1111 1111 1111.": "card [card].", "card 4111 1111 1111 1112.": "card 4111 1111 1111 1112.",
        "fe80::1 up": "[ip] up", "eyJhbGci.eyJzdWIi.abc": "[jwt]", "key abcdefghij0123456789xyz": "key [token]", "nothing": "nothing",
    }
    assert values(spark, redact, list(cases)) == list(cases.values())
    assert values(spark, lambda c: redact(c, ["email"], [("who", "bob"), ("bad", "(")]), ["bob@example.com bob"]) == ["[who]@example.com [who]"]
    assert values(spark, find_sensitive, ["a@b.co 10.0.0.1", "x"]) == [["email", "ipv4"], []]


def test_context_and_neighbours(spark):
    lines = lines_of(spark, app_log(50))
    errors = P.level_cmp("eq", "ERROR")  # 4, 10, ... 46
    around = V.context(lines, errors, 2, 1).collect()
    assert sorted(r["line_no"] for r in around) == sorted({j for i in range(4, 50, 6) for j in range(i - 2, i + 2)})
    near = {r["line_no"]: (r["prev_hit"], r["next_hit"]) for r in V.adjacent_hits(lines, errors).collect()}
    assert (near[0], near[4], near[5], near[49]) == ((46, 4), (46, 10), (4, 10), (46, 4))
    assert [r["n"] for r in V.funnel(lines, [errors, P.term("worker-4")]).orderBy("step").collect()] == [50, 8, sum(i % 6 == 4 and i % 7 == 4 for i in range(50))]
    assert {r["delta_ms"] for r in V.delta(lines.filter(errors)).collect()} == {None, 6000}


def test_merge(spark):
    a = lines_of(spark, [f"2024-01-01 00:00:0{s} [INFO] x - a" for s in (0, 2, 4)])
    b = lines_of(spark, [f"2024-01-01 00:00:0{s} [ERROR] x - b" for s in (1, 3, 5)])
    tl = M.merge_timeline({"A": a, "B": b})
    assert [r["source"] for r in tl.orderBy(*M.ORDER).collect()] == list("ABABAB")
    assert one(M.seek(tl, 1704067203000))["n"] == 3
    assert M.merged_search({"A": a, "B": b}, P.level_cmp("eq", "ERROR")).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "svc.log.1").write_bytes("\n".join(app_log(100)).encode())
    with gzip.open(tmp_path / "svc.log.2.gz", "wb") as f:
        f.write(b"first\r\nsecond\n")
    (tmp_path / "svc.log").write_bytes(("\n".join(app_log(100)) + "\n\nlast").encode())
    now = time.time()
    for i, name in enumerate(["svc.log.2.gz", "svc.log.1", "svc.log"]):
        os.utime(tmp_path / name, (now + i * 10, now + i * 10))
    got = S.read_rotation_group(spark, str(tmp_path)).orderBy("line_no").collect()
    assert len(got) == 204 and [r["line_no"] for r in got] == list(range(204)) and len({r["stream"] for r in got}) == 1
    assert [got[i]["text"] for i in (0, 1, 202, 203)] == ["first", "second", "", "last"] and got[2]["text"] == app_log(1)[0]
    per_file = S.read_lines(spark, str(tmp_path / "svc.log"))
    assert per_file.count() == 102


def test_split_invariance(spark, tmp_path):
    """Numbers and heads are the same, however small the splits of a file are."""
    text = []
    for i in range(400):
        text.append(f"2024-01-01 00:00:{i % 60:02d} [INFO] x - line {i}")
        text += ["  more"] * (i % 4)
    (tmp_path / "a.log").write_text("\n".join(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = S.read_lines(spark, str(tmp_path / "a.log"))
        assert rows.rdd.getNumPartitions() >= 1
        got = R.assign_records(X.parse_timestamped(rows)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["text"] for r in got] == text
    head, want = 0, []
    for i, x in enumerate(text):
        head = head if x.startswith("  ") else i
        want.append(head)
    assert [r["head"] for r in got] == want


def test_carry_over_splits(spark):
    lines = spark.createDataFrame([("s", i, i % 37 == 0) for i in range(500)], "stream string, line_no long, hit boolean")
    got, value = R.carried(lines, F.when(F.col("hit"), F.col("line_no")), split_lines=16)
    assert all(r[1] == r[0] // 37 * 37 for r in got.select("line_no", value).collect())
    got, value = R.carried(lines, F.when(F.col("hit"), F.col("line_no")), backward=True, own=False, split_lines=16)
    assert all(r[1] == (r[0] // 37 * 37 + 37 if r[0] // 37 * 37 + 37 < 500 else None) for r in got.select("line_no", value).collect())


def test_export(spark, tmp_path):
    lines = lines_of(spark, ['2024-01-01 00:00:00.5 [INFO] x - say "hi", a@b.co', "no time"])
    S.write_csv(lines, str(tmp_path / "csv"), redact)
    got = spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').orderBy("line").collect()
    assert [tuple(r) for r in got] == [("1", "2024-01-01T00:00:00.500Z", "INFO", '2024-01-01 00:00:00.5 [INFO] x - say "hi", [email]'), ("2", None, None, "no time")]
    S.write_json(lines, str(tmp_path / "json"))
    assert "null" in "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))


def test_watch_rate(spark, tmp_path):
    """Two, then one, then one matches within the window: fires once, at three."""
    for i, n in enumerate((2, 1, 1)):
        rows = [("a", 10 * i + j, datetime(2024, 1, 1, 0, 0, i), "ERROR", f"e{i}{j}") for j in range(n)]
        spark.createDataFrame(rows, "stream string, line_no long, ts timestamp, level string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema("stream string, line_no long, ts timestamp, level string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = W.run_available(W.watch_rate(stream, [W.Rule("r", P.level_cmp("eq", "ERROR"), 3, 60)]), "update").collect()
    assert [(r["rule"], r["n"]) for r in fired] == [("r", 3)]
    assert [(r.name, r.threshold, r.window) for r in W.sane_rules([W.Rule("a", P.match_all(), 0, 10**9), W.Rule("", P.match_all()), W.Rule("b", P.match_all(), enabled=False)])] == [("a", 1, 86400), ("rule-1", 1, 60)]


def test_spikes_and_gaps(spark):
    totals = [5, 6, 5, 6, 5, 6, 5, 6, 50, 5, 6, 5]
    hist = spark.createDataFrame([(i, i * 10, 10, t) for i, t in enumerate(totals)] + [(16, 160, 10, 5)], "bucket long, start_ms long, bucket_ms long, total long")
    assert [(r["bucket"], r["ratio"]) for r in D.spikes(hist).collect()] == [(8, 10.0)]
    assert [(r["start_ms"], r["end_ms"], r["missing"]) for r in D.gaps(hist).collect()] == [(120, 160, 4)]


def test_triage(spark):
    rows = [f'{{"level":"{"ERROR" if i % 5 == 0 else "INFO"}","duration_ms":{i}}}' for i in range(1000)]
    got = D.triage(lines_of(spark, rows, X.parse_json))
    assert one(got["summary"])["errors"] == 200 and one(got["slowest"])["n"] == 1000


def test_watch_rate_without_ts(spark, tmp_path):
    """A matching line without ts is counted at the time of the batch; what is as old as the window still counts; a rule
    with a blank name has its place for a name."""
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "stream string, line_no long, text string, ts timestamp, level string"
    rules = lambda: [W.Rule("off", P.match_all(), enabled=False), W.Rule(" ", P.line_regex("boom"), 3, 60), W.Rule("late", P.line_regex("tick"), 2, 60)]
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    spark.createDataFrame([("a", i, "boom", None, None) for i in range(3)] + [("a", 9, "tick", at(0), None), ("a", 10, "tick later", at(60), None), ("a", 11, "tick", None, None)], schema).write.mode("append").parquet(str(folder))
    got = {r.rule: r for r in W.run_available(W.watch_rate(spark.readStream.schema(schema).parquet(str(folder)), rules()), "update").collect()}
    assert set(got) == {"rule-1", "late"} and got["rule-1"].n == 3 and got["rule-1"].at_ms > 1_700_000_000_000
    assert got["late"].n == 2 and got["late"].sample == "tick later"  # the tick without ts comes when it has fired already
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live = tmp_path / "live"
    for second in (0, 60, 121, 200, 201):  # one after another: the second is just in the window of the first, the third not
        spark.createDataFrame([("a", second, "tick", at(second), None)], schema).coalesce(1).write.mode("append").parquet(str(live))
        query = W.watch_rate(spark.readStream.schema(schema).parquet(str(live)), rules()).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    fired = sorted((r.at_ms - 1704067200000, r.n) for r in spark.read.parquet(out).collect())
    assert fired == [(60_000, 2), (201_000, 2)]


def test_js_numbers(spark):
    items = ["5", "+5", "-5", ".5", "5.", "1e3", " 7 ", "0x1F", "0b101", "0o17", "", "5d", "Infinity", "NaN", "1e999", "--5", "0x", None]
    got = values(spark, P.js_number, items)
    assert got == [5.0, 5.0, -5.0, 0.5, 5.0, 1000.0, 7.0, 31.0, 5.0, 15.0, 0.0, None, None, None, None, None, None, None]
    lines = lines_of(spark, ["v=ÄB x", "v=äb y", "v=+7 z"], X.parse_raw)
    cap = P.Capture("v", r"v=(\S+)")
    assert lines.filter(P.capture_eq(cap, "äB")).count() == 2 and lines.filter(P.capture_cmp(cap, "gte", 7)).count() == 1


def test_lines_are_parsed_once(spark):
    """However the parsed columns are used, a format's pattern stands in the plan once."""
    df = X.parse_timestamped(raw(spark, app_log(10)))
    for used in (df, df.filter("ts is not null and level = 'INFO'").select("ts", "level"), A.time_histogram(df)):
        plan = used._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert sum("[A-Z]{3,12}" in step for step in plan) <= (2 if "bucket_ms" in used.columns else 1)
    plan = df.select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert "__ts" not in plan and "__level" not in plan and "timestamp_millis" not in plan  # nobody asks for them
    text = redact(F.col("text"))
    plan = raw(spark, ["x"]).select(text.alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 10


def test_packed_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gzip", "wb") as f:
        f.write(b"one\r\n\ntwo")
    with gzip.open(tmp_path / "b.log", "wb") as f:
        f.write(b"x\n")
    (tmp_path / "c.log").write_bytes(b"plain\xff\n")
    (tmp_path / "d.log").write_bytes(b"")
    got = sorted((r.stream.rsplit("/", 1)[1], r.line_no, r.text) for r in S.read_packed_lines(spark, str(tmp_path)).collect())
    assert got == [("a.log.gzip", 0, "one"), ("a.log.gzip", 1, ""), ("a.log.gzip", 2, "two"), ("b.log", 0, "x"), ("c.log", 0, "plain�")]


def test_rotation_names(spark):
    names = {"app.log": "app.log", "app.log.2.gz": "app.log", "app.log.1": "app.log", "app-2024-01-31.log": "app.log", "app.log-20240131": "app.log", "app.2024-01-31.log.3.bz2": "app.log", "x.GZIP": "x", "a.b": "a.b"}
    assert values(spark, S.rotation_base, list(names)) == list(names.values())


def test_detected_lines_are_computed_once(spark, monkeypatch):
    """Lines are made once, however many formats they have; few streams and many give the same rows."""
    made, texts = spark.sparkContext.accumulator(0), {"a": app_log(150), "j": [f'{{"level":"error","n":{i}}}' for i in range(120)], "l": [f"level=warn n={i}" for i in range(130)], "r": ["what", "  ever"], None: ["lost"]}

    def count(x):
        made.add(1)
        return x

    raw = spark.createDataFrame([(s, i, t) for s, ts in texts.items() for i, t in enumerate(ts)], "stream string, line_no long, text string")
    raw = raw.withColumn("text", F.udf(count, "string")("text"))
    got = X.parse_logs(raw)
    rows = sorted(repr(r) for r in got.select("stream", "line_no", "format", "level", "ts", F.map_entries("fields").alias("f"), "message", "starts_record").collect())
    assert made.value == 403 and len(rows) == 402
    assert {(r.stream, r.format): r.n for r in got.groupBy("stream", "format").agg(F.count("*").alias("n")).collect()} == {("a", "timestamped"): 150, ("j", "json"): 120, ("l", "logfmt"): 130, ("r", "raw"): 2}
    monkeypatch.setattr(X, "FEW_STREAMS", 1)
    many = X.parse_logs(raw).select("stream", "line_no", "format", "level", "ts", F.map_entries("fields").alias("f"), "message", "starts_record").collect()
    assert sorted(repr(r) for r in many) == rows
    assert X.parse_logs(raw.filter("line_no < 0")).count() == 0


def test_json_keys_as_paths(spark):
    """Wanted keys are those that a search for each path finds, and a line is not searched for each."""
    texts = [
        '{"a": 1.50, "b": {"c": "x", "d": [1, {"e": 2}]}, "level": "error", "msg": "m"}', '{"a": "{\\"c\\": 1}", "b": "{\\"c\\": 1}"}', '{"a": null, "b": {"c": null}, "c": "t\\u00e9\\n"}', '{"b": [{"c": 1}], "a": {"x": [1, 2]}}', "{}", "not JSON", '{"a": 1', None,
        '{"a": 1, "a": 2}', '{"a": 1e400, "b": {"c": {"f": 1E5}}}', '  {"a": true, "b": {"c": ""}, "event": {"message": "below", "severity": "warn"}}', "[1]", '{"a.b": 1, "A": 2}', '{"a":-0.0,"b":{"c":12345678901234567890}}',
    ]
    keys, raw = ["a", "b", "b.c", "b.d", "c", "b.c.f"], spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "stream string, line_no long, text string")
    parsed = X.parse_json(raw, keys)
    ok = F.ltrim("text").startswith("{") & F.try_parse_json("text").isNotNull()
    plain = raw.select("line_no", *[F.when(ok, F.get_json_object("text", "$" + "".join(f"['{p}']" for p in k.split(".")))).alias(k.replace(".", "_")) for k in keys])
    got = parsed.select("line_no", *[F.col("fields")[k].alias(k.replace(".", "_")) for k in keys])
    assert sorted(got.collect()) == sorted(plain.collect())
    seen = {r.line_no: (r.level, r.message) for r in parsed.collect()}
    assert seen[0] == ("ERROR", "m") and seen[10] == ("WARN", "below") and len(seen) == len(texts)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple") == 1 and plan.count("get_json_object") == 3 + len([k for k in X.LEVEL_KEYS + X.MESSAGE_KEYS if "." in k])


def test_what_patterns_need(spark):
    """Whatever a pattern finds has what its pattern needs, and texts without it are not searched."""
    import random

    from logfathom.functions import redaction as K

    rng = random.Random(3)
    parts = ["token", "Pa\u017fs", "to\u212aen", "auth", "=", ":", "::", " ", "\n", "\u00a0", "fe80", "1", "a", "12ab", "10.0.0.1", "4111 1111 1111 1111", "4111-1111", "x@y.co", "@", "Bearer", "eyJ", ".", "abcdefghij12345", "Zz9+/_=-", "é", "\""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([2, 6, 20]))) for _ in range(3000)] + [None, ""]
    every = {"secret": [rewrite(K.SECRET, ignore_case=True), rewrite(K.BEARER, ignore_case=True)], "jwt": [rewrite(K.JWT)], "email": [rewrite(K.EMAIL)], "ipv4": [rewrite(K.IPV4)], "ipv6": [rewrite(K.IPV6)], "token": [rewrite(K.TOKEN)]}
    plain = values(spark, lambda c: F.array_compact(F.array(*[F.when(F.greatest(*[c.rlike(p.java) for p in (ps * 2)[:2]]), F.lit(k)) for k, ps in every.items()])), texts)
    got = [[k for k in x if k != "card"] for x in values(spark, find_sensitive, texts)]
    assert got == plain and all(sum(k in x for x in plain) > 20 for k in every if k != "jwt")
    plan = spark.createDataFrame([("x",)], "t string").select(find_sensitive(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") + plan.lower().count("regexp_like") >= 15


def test_records_over_batches(spark, tmp_path):
    """Long records that go on in the next batch."""
    schema, folder = "stream string, line_no long, text string", str(tmp_path / "in")
    lines = [("a", i, (f"  at {i}" if i % 400 else f"head {i}")) for i in range(1200)]
    for a, b in ((0, 407), (407, 1200)):
        spark.createDataFrame(lines[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    pieces = W.run_available(W.stream_records(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), "append")
    got = {r.head: r for r in W.collect_records(pieces).collect()}
    assert {h: r.span for h, r in got.items()} == {0: 400, 400: 400, 800: 400} and {h: r.closed for h, r in got.items()} == {0: True, 400: True, 800: False}
    assert all(r.text == "\n".join(x[2] for x in lines[h : h + 400]) for h, r in got.items())


def test_a_long_record_costs_its_lines(spark, tmp_path):
    """One record over many batches: what is given out is as long as its lines, not as the record so far."""
    schema, folder, n, batches = "stream string, line_no long, text string", str(tmp_path / "in"), 20_000, 10
    for b in range(batches):
        rows = spark.range(b * n, (b + 1) * n).select(F.lit("a").alias("stream"), F.col("id").alias("line_no"), F.concat(F.when(F.col("id") == 0, "head ").otherwise("  at "), F.col("id")).alias("text"))
        rows.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    pieces = W.run_available(W.stream_records(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), "append")
    rows = sorted((r.part, r.span, len(r.text), r.batch) for r in pieces.collect())
    assert [r[:2] for r in rows] == [(i, n) for i in range(batches)] and max(r[2] for r in rows) < 15 * n
    assert one(W.collect_records(pieces)).span == n * batches


def test_a_silent_stream_closes(spark, tmp_path):
    schema, folder, out, state = "stream string, line_no long, text string", tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    spark.createDataFrame([("a", 0, "head"), ("a", 1, "  at x"), ("b", 0, "other")], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = W.stream_records(spark.readStream.schema(schema).parquet(str(folder)), idle_ms=500)
    query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).outputMode("append").option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            time.sleep(0.5)
            if os.path.exists(out) and spark.read.schema(stream.schema).parquet(out).filter("closed").count() == 2:
                break
    finally:
        query.stop()
    got = {r.stream: (r.head, r.span, r.text, r.closed) for r in W.collect_records(spark.read.parquet(out)).collect()}
    assert got == {"a": (0, 2, "head\n  at x", True), "b": (0, 1, "other", True)}


def test_segments_by_lines(spark, tmp_path):
    """Segments of several splits: numbers rise through them; those of one split have none missing."""
    big, small = "".join(f"line {i} {'x' * (i % 50)}\r\n" for i in range(4000)), "one\n\n  three"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.log").write_bytes(big.encode())
    (tmp_path / "in" / "small.log").write_text(small)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in W.run_available(W.read_lines_stream(spark, str(tmp_path / "in")), "append").collect():
                got.setdefault(r.stream.rsplit("/", 1)[1], []).append((r.line_no, r.text))
            assert sorted(got["small.log"]) == [(0, "one"), (1, ""), (2, "  three")]
            numbers = sorted(got["big.log"])
            assert [t for _, t in numbers] == [x.rstrip("\r") for x in big.split("\n")[:-1]] and len({n for n, _ in numbers}) == 4000
            assert ([n for n, _ in numbers] == list(range(4000))) == (size == old)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_segments_of_many_splits_are_numbered_without_gaps(spark, tmp_path):
    """Each split's lines go on from those of the splits before it, also where a line is longer than a split."""
    lines = {"a.log": [f"line {i} {'x' * (i % 50)}" for i in range(4000)], "b.log": ["one", "y" * 50_000, "", *[f"{i}" for i in range(9000)]]}
    (tmp_path / "in").mkdir()
    for name, texts in lines.items():
        (tmp_path / "in" / name).write_text("\n".join(texts))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        got = {}
        for r in W.run_available(W.read_lines_stream(spark, str(tmp_path / "in"), blocks=True), "append", W.dense_numbers).collect():
            got.setdefault(r.stream.rsplit("/", 1)[1], []).append((r.line_no, r.text))
        assert {name: sorted(rows) for name, rows in got.items()} == {name: list(enumerate(texts)) for name, texts in lines.items()}
        from logfathom.plans.queries import QUERIES

        assert QUERIES["x01_read_lines_stream"](spark, "/root/testdata/sf0.01").select("holes").distinct().collect() == [(0,)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
