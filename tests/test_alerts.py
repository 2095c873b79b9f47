"""Rate alerts in event time."""

import random
from datetime import datetime, timedelta

import pytest

from logfathom.functions import predicates as P
from logfathom.streaming import tail as W

SCHEMA = "stream string, line_no long, text string, ts timestamp, level string"
START = datetime(2024, 1, 1)


def fired(spark, folder, rules, seconds, files=1):
    rows = [("a", i, f"ERROR {i}", None if s is None else START + timedelta(seconds=s), "ERROR") for i, s in enumerate(seconds)]
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = W.run_available(W.watch_rate(stream, rules), "update").collect()
    return sorted((r.rule_id, r.rule, (r.at_ms - 1704067200000) // 1000, r.n) for r in got)


def test_days_apart_do_not_add_up(spark, tmp_path):
    rule = W.Rule("r", P.level_cmp("eq", "ERROR"), 3, 60)
    assert fired(spark, tmp_path / "a", [rule], [0, 86400, 172800]) == []
    assert fired(spark, tmp_path / "b", [rule], [0, 30, 60, 86400, 86401, 86402, 86403, 86500]) == [(0, "r", 60, 3), (0, "r", 86402, 3)]


def test_rules_of_one_name(spark, tmp_path):
    rules = [W.Rule("r", P.level_cmp("eq", "ERROR"), 3, 86400), W.Rule("off", P.match_all(), enabled=False), W.Rule("r", P.line_regex("ERROR"), 2, 60)]
    assert fired(spark, tmp_path / "a", rules, [0, 40000, 80000, 80010]) == [(0, "r", 80000, 3), (2, "r", 80010, 2)]
    assert {(r.rule_id, r.rule) for r in W.watch_match(spark.createDataFrame([("a", 0, "ERROR", START, "ERROR")], SCHEMA), rules).collect()} == {(0, "r"), (2, "r")}


def plain(times, threshold, window):
    out, was = [], False
    for t in sorted(set(times)):
        inside = [x for x in times if t - window <= x <= t]
        before = [x for x in times if t - window <= x < t]
        was = was and len(before) >= threshold
        if len(inside) >= threshold and not was:
            out.append((t, len(inside)))
        was = len(inside) >= threshold
    return out


@pytest.mark.parametrize("seed", range(20))
def test_against_all_windows(seed):
    """The short list of counts gives what looking at all matches gives."""
    r = random.Random(seed)
    threshold, window = r.randint(1, 6), r.randint(1, 20)
    times = [r.randint(0, 200) for _ in range(r.randint(1, 150))]
    rate, got = W.Rate(threshold, window), []
    for t in sorted(set(times)):
        if r.random() < 0.3:
            rate = W.Rate(threshold, window, rate.dump())  # as a new micro-batch finds it
        if (n := rate.add(t, times.count(t))) is not None:
            got.append((t, n))
        assert len(rate.times) <= max(threshold, 1)
    assert got == plain(times, threshold, window)


def test_late_matches(spark):
    rate = W.Rate(3, 10)
    assert [rate.add(t, 1) for t in (100, 95, 89, 91)] == [None, None, None, 3]  # 89 is too old by the clock, 91 isn't
