"""Diagnostics: over-represented values, slow fields, triage, spikes and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.functions.dialect import rewrite
from logfathom.functions.values import ascii_fold
from logfathom.operators.aggregates import _one_row, field_catalog, fields_long, level_counts, numeric_facet, stats
from logfathom.operators.patterns import clusters_by_level

# Keys that correlate leaves out, and names of durations (any case).
MESSAGE_LIKE = ["message", "msg", "text", "@message", "log", "raw", "exception", "stack", "stacktrace"]
DURATION_NAME = r"^(duration(_?ms|_?s)?|latency(_?ms)?|elapsed(_?ms)?|took(_?ms)?|response_?time|resp_?time|ttfb|rt|dur)$"
SPIKE_BUCKETS, SPIKES, GAPS = 8, 15, 12


def correlate(lines: DataFrame, pred: Column, limit: int = 8) -> DataFrame:
    """field, value, count, share, lift of each field's dominant value among the matching lines, if it is in half of them
    or in 15 % and 1.5 times as often as elsewhere; by share, then lift, then name."""
    hit = F.coalesce(pred, F.lit(False))
    flagged = lines.withColumn("__hit", hit)
    rows = flagged.select("__hit", "stream", "line_no", F.explode(F.map_filter("fields", lambda k, v: ~F.lower(k).isin(MESSAGE_LIKE))))
    counts = rows.groupBy("key", ascii_fold(F.col("value")).alias("folded")).agg(F.count("*").alias("all"), F.count_if("__hit").alias("count"), F.min_by("value", F.when(F.col("__hit"), F.struct("stream", "line_no"))).alias("value"))
    first = Window.partitionBy("key").orderBy(F.desc("count"), "folded")
    top = counts.filter("count > 0").withColumn("r", F.row_number().over(first)).filter("r = 1")
    sizes = flagged.agg(F.count("*").alias("lines"), F.count_if("__hit").alias("results"))
    got = _one_row(top, sizes).withColumn("share", F.col("count") / F.col("results"))
    got = got.withColumn("lift", F.col("share") / (F.col("all") / F.col("lines")))
    kept = got.filter((F.col("share") >= 0.5) | (F.col("share") >= 0.15) & (F.col("lift") >= 1.5))
    return kept.orderBy(F.desc("share"), F.desc("lift"), "key").limit(limit).select(F.col("key").alias("field"), "value", "count", "share", "lift")


def duration_field(lines: DataFrame) -> DataFrame:
    """key, n: the most frequent key whose name looks like a duration; no row if there is none."""
    return field_catalog(lines.select(F.map_filter("fields", lambda k, v: k.rlike(rewrite(DURATION_NAME, ignore_case=True).java)).alias("fields")), 1)


def triage(lines: DataFrame, error_levels: tuple[str, ...] = ("ERROR", "FATAL")) -> dict[str, DataFrame]:
    """What is wrong: summary (total, span, errors), levels, clusters of errors, and slowest (field, p50, p95, max)."""
    errors = lines.agg(F.count_if(F.col("level").isin(list(error_levels))).alias("errors"))
    found = duration_field(lines).first()  # the name of one key
    slow = None
    if found is not None:
        slow = numeric_facet(lines, found["key"], 1).select(F.lit(found["key"]).alias("field"), F.col("count").alias("n"), "p50", "p95", "max")
    return {
        "summary": _one_row(stats(lines).drop("levels"), errors),
        "levels": level_counts(lines).filter("level <> 'NONE'"),
        "clusters": clusters_by_level(lines, error_levels),
        "slowest": slow,
    }


def spikes(hist: DataFrame) -> DataFrame:
    """bucket, start_ms, total, ratio of buckets far over the median, most first; none of fewer than 8 buckets, or if more
    than a quarter qualify. hist: one row for each of at most 1,000 buckets."""
    mid = hist.agg(F.percentile("total", F.lit(0.5)).alias("median"), F.percentile("total", F.lit(0.9)).alias("q90"), F.count("*").alias("n"))
    spread = _one_row(hist, mid).groupBy("median", "q90", "n").agg((F.percentile(F.abs(F.col("total") - F.col("median")), F.lit(0.5)) * 1.4826).alias("sigma"))
    rows = _one_row(hist, spread).filter(F.col("n") >= SPIKE_BUCKETS)
    high = rows.filter((F.col("total") >= 3) & (F.col("total") > F.col("q90")) & (F.col("total") >= F.greatest(F.col("median") + 4 * F.col("sigma"), F.col("q90") * 1.8)))
    few = _one_row(high, high.agg(F.count("*").alias("found"))).filter(F.col("found") <= F.col("n") * 0.25)
    ratio = F.when(F.col("median") > 0, F.col("total") / F.col("median")).otherwise(F.lit(float("inf")))
    return few.orderBy(F.desc("total"), "bucket").limit(SPIKES).select("bucket", "start_ms", "total", ratio.alias("ratio"))


def gaps(hist: DataFrame, lo_ms: Column | None = None, hi_ms: Column | None = None) -> DataFrame:
    """start_ms, end_ms, duration_ms, missing of runs of two missing buckets or more, longest first, if buckets cover 40 %
    of the range. lo_ms and hi_ms: the first and last time; by default the starts of the first and last bucket."""
    ends = hist.agg(F.count("*").alias("n"), (lo_ms if lo_ms is not None else F.min("start_ms")).alias("lo"), (hi_ms if hi_ms is not None else F.max("start_ms")).alias("hi"), F.max("bucket_ms").alias("w"))
    dense = ends.filter((F.col("n") >= SPIKE_BUCKETS) & (F.col("n") / (F.floor((F.col("hi") - F.col("lo")) / F.col("w") + 0.5) + 1) >= 0.4)).select("w")
    rows = hist.withColumn("before", F.lag("start_ms").over(Window.orderBy("start_ms"))).filter("before is not null")  # a histogram's buckets
    got = _one_row(rows, dense).withColumn("from_ms", F.col("before") + F.col("w"))
    got = got.withColumn("duration_ms", F.col("start_ms") - F.col("from_ms")).withColumn("missing", F.floor(F.col("duration_ms") / F.col("w") + 0.5))
    return got.filter("missing >= 2").orderBy(F.desc("duration_ms"), "from_ms").limit(GAPS).select(F.col("from_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"), "duration_ms", "missing")
