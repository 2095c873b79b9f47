"""Several sources in one timeline."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.operators.aggregates import time_histogram, width_ceil
from logfathom.sources.ordered import Ordered, in_order

ORDER = ["ts", "source", "stream", "line_no"]


def merge_timeline(sources: Mapping[str, DataFrame], heads_only: bool = False) -> DataFrame:
    """The lines with a ts of all sources, with source and span (of the record that a head starts; else null). Sort by
    ORDER where an order is needed: a range-partitioned sort, never one task."""

    def part(name: str, lines: DataFrame) -> DataFrame:
        spans = lines.groupBy("stream", "head").agg(F.count("*").cast("int").alias("span")).withColumnRenamed("head", "line_no")
        rows = lines.select("stream", "line_no", "head", "is_head", "ts", "level", "text", "fields").filter("ts is not null")
        return (rows.filter("is_head") if heads_only else rows).join(spans, ["stream", "line_no"], "left").withColumn("source", F.lit(name))

    return reduce(DataFrame.unionByName, [part(n, df) for n, df in sources.items()])


def merged_search(sources: Mapping[str, DataFrame], pred: Column) -> DataFrame:
    """The heads with a ts of records that have any matching line, across sources."""
    hits = reduce(DataFrame.unionByName, [df.filter(pred).select(F.lit(n).alias("source"), "stream", "head").distinct() for n, df in sources.items()])
    heads = merge_timeline(sources, heads_only=True)
    return heads.join(hits, ["source", "stream", "head"], "left_semi")


def merged_page(tl: DataFrame, offset: int = 0, limit: int = 200, newest_first: bool = False, highlight: Column | None = None) -> DataFrame:
    rows = tl if highlight is None else tl.withColumn("match", F.coalesce(highlight, F.lit(False)))
    return rows.orderBy(*[F.col(c).desc() if newest_first else F.col(c).asc() for c in ORDER]).offset(offset).limit(min(limit, 2000))


def materialize_timeline(tl: DataFrame) -> Ordered:
    """A timeline in its order, written once, for result_page() and seek_result()."""
    return in_order(tl, ORDER, "timeline")


def seek_result(timeline: Ordered, ts_ms: int) -> DataFrame:
    """seek() of a materialized timeline: the counts of earlier partitions, and the one that has the time inside."""
    return timeline.seek(datetime.fromtimestamp(ts_ms / 1000))


def merged_histogram(tl: DataFrame, buckets: int = 100) -> DataFrame:
    return time_histogram(tl, buckets, width_ceil)


def seek(tl: DataFrame, ts_ms: int) -> DataFrame:
    """One row: how many rows are before a time (ms)."""
    return tl.filter(F.unix_millis("ts") < ts_ms).agg(F.count("*").alias("n"))
