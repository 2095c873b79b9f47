"""Ordered tables: pages, seeks, dense numbers and ranks from range partitions; contexts; panels in one pass."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logfathom.functions import predicates as P
from logfathom.operators import aggregates as A
from logfathom.operators import parsing as X
from logfathom.operators import records as R
from logfathom.operators import timeline as M
from logfathom.operators import views as V
from logfathom.sources import files as S
from logfathom.sources.ordered import in_order, numbered

LINES = "stream string, line_no long, text string"


def files_read(df):
    return len(df.inputFiles())


def test_pages_read_their_files(spark):
    rows = [(f"s{i % 3}", i // 3, "x" * (5000 if i == 7 else 5)) for i in range(3000)]
    result = V.materialize(spark.createDataFrame(rows, LINES).repartition(5))
    want = sorted(rows)
    assert result.total == 3000 and len(result.parts) > 2
    for offset, limit in ((0, 10), (1490, 20), (2995, 50), (5000, 10), (0, 9999)):
        for newest in (False, True):
            got = [(r.stream, r.line_no) for r in V.result_page(result, offset, limit, newest).collect()]
            assert got == [x[:2] for x in (want[::-1] if newest else want)][offset : offset + min(limit, 2000)]
    assert files_read(result.rows(1490, 20)) <= 2 < files_read(result.all())
    cut = [r for r in V.result_page(result, 0, 2000).collect() if r.truncated]
    assert [(len(r.text), r.line_no) for r in cut] == [(4096, 2)]
    plan = V.result_page(result, 1490, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_empty_result(spark):
    result = V.materialize(spark.createDataFrame([], LINES))
    assert result.total == 0 and V.result_page(result).count() == 0


def test_seek_reads_one_partition(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", "s", i, start + timedelta(seconds=i // 4), "t") for i in range(2000)]
    tl = spark.createDataFrame(rows, "source string, stream string, line_no long, ts timestamp, text string").repartition(3)
    result = M.materialize_timeline(tl)
    for second in (-5, 0, 1, 250, 499, 500, 9999):
        ms = int((start + timedelta(seconds=second)).timestamp() * 1000)
        assert M.seek_result(result, ms).collect()[0].n == M.seek(tl, ms).collect()[0].n == sum(i // 4 < second for i in range(2000))
    inside = [p for p in result.parts if p.low < start + timedelta(seconds=250) <= p.high]
    assert len(inside) <= 2


def test_numbers_by_any_key(spark):
    rows = [(f"k{i * 7919 % 1000:04}", None if i % 10 == 0 else f"g{i % 2}", f"text {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, g string, text string").repartition(4)
    got = {(r.stream, r.line_no): r.text for r in S.from_table(df, "text", ["key"], ["g"]).collect()}
    want = {}
    for g in ("", "g0", "g1"):
        mine = sorted(r for r in rows if (r[1] or "") == g)
        want |= {(g, n): r[2] for n, r in enumerate(mine)}
    assert got == want
    assert sorted((r.key, r.n) for r in numbered(df, ["key"], "n").collect()) == [(k, n) for n, k in enumerate(sorted(r[0] for r in rows))]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_with_an_outlier(spark, seed):
    """One value of 1e15 leaves the ranges even, and ranks exact."""
    r = random.Random(seed)
    values = [r.random() for _ in range(20_000)] + [1e15]
    rows = [("hot", v) for v in values] + [("few", v) for v in (3.0, 1.0, 2.0)] + [(None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {(x.k, x.q): x.value for x in A.nearest_rank(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for key in {k for k, _ in rows} - {"none"}:
        mine = sorted(v for k, v in rows if k == key)
        for q in (0.0, 0.5, 0.95, 1.0):
            assert got[key, q] == mine[int(q * (len(mine) - 1) + 0.5)]
    assert not any(k == "none" for k, _ in got)
    cut = in_order(df.filter("v is not null").distinct(), ["k", "v"], parts=A._RANGES)
    assert max(p.rows for p in cut.parts) <= 0.02 * len(rows)


@pytest.mark.parametrize("before,after,every", [(0, 0, 3), (2, 3, 40), (1000, 1000, 1), (1000, 0, 5000), (0, 1000, 1500), (700, 900, 2600)])
def test_context(spark, before, after, every):
    rows = [(s, i, "hit" if i % every == every // 2 else "miss") for s in ("a", "b") for i in range(6000 if s == "a" else 10)]
    df = spark.createDataFrame(rows, LINES).repartition(4)
    got = sorted((r.stream, r.line_no, r.match) for r in V.context(df, F.col("text") == "hit", before, after).collect())
    hits = {(s, i) for s, i, t in rows if t == "hit"}
    near = {(s, j) for s, i in hits for j in range(i - before, i + after + 1)}
    assert got == sorted((s, i, (s, i) in hits) for s, i, _ in rows if (s, i) in near)


def test_panels_are_one_scan(spark):
    lines = [f'{{"timestamp":"2024-01-01T00:{i % 60:02}:00Z","level":"{["ERROR", "info"][i % 2]}","service":"{["Api", "api", "web"][i % 3]}","ms":{i}{"" if i % 4 else ".5"},"v":"x{i % 5}"}}' for i in range(300)] + ["no json"]
    raw = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], LINES)
    parsed = R.assign_records(X.parse_json(raw))
    field, time, none = A.Group("field", "service", 2), A.Group("time", buckets=10), A.Group()
    level, by_field = A.Split("level"), A.Split("field", "v", 3)
    error = P.level_cmp("eq", "ERROR")
    metrics = [A.Metric(), A.Metric("unique", "v"), A.Metric("sum", "ms"), A.Metric("avg", "ms"), A.Metric("min", "ms"), A.Metric("max", "ms"), A.Metric("p50", "ms"), A.Metric("p95", "ms")]
    panels = {f"{m.kind} {i}": (scope, group, split, m) for m in metrics for i, (scope, group, split) in enumerate([(None, field, None), (error, time, level), (error, none, by_field)])}
    panels["a field that no line has"] = (None, A.Group("field", "nope"), None, A.Metric())
    round_ = lambda df: sorted((str(r.group), str(r.series), round(r.value, 6), r.truncated) for r in df.collect())
    got = A.run_panels(parsed, panels)
    assert list(got) == list(panels)
    for name, (scope, group, split, metric) in panels.items():
        assert round_(got[name]) == round_(A.aggregate(parsed if scope is None else parsed.filter(scope), group, split, metric)), name
    assert all("Scan ExistingRDD" not in df._jdf.queryExecution().optimizedPlan().toString() for df in got.values())
