"""Pattern mining: the templates of head lines and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.values import template_of
from logfathom.sources.ordered import numbered


def with_templates(lines: DataFrame) -> DataFrame:
    """lines with template, null on lines that aren't heads."""
    return lines.withColumn("template", F.when(F.col("is_head"), template_of(F.col("text"))))


def templates(lines: DataFrame) -> DataFrame:
    """id (by first appearance, from 0), pattern, count over head lines. The lines are read once, and a line's template is
    computed once (no filter goes through the generator); the patterns are put in order as range partitions, whose counts
    number them."""
    found = lines.select("stream", "line_no", F.inline(F.array(F.struct(F.col("template").alias("pattern"))))).filter("pattern is not null")
    counts = found.groupBy("pattern").agg(F.count("*").alias("count"), F.min(F.struct("stream", "line_no")).alias("first"))
    return numbered(counts, ["first"], "id").select(F.col("id").cast("long").alias("id"), "pattern", "count")


def clusters(lines: DataFrame, limit: int = 50, pred: Column | None = None) -> DataFrame:
    """id, pattern, count of the most frequent patterns (then by id), with distinct_count and covered of the whole view.
    ids are those of all lines, whatever the view."""
    ids = templates(lines).select("id", "pattern")
    view = lines.filter(pred) if pred is not None else lines
    counts = view.filter("template is not null").groupBy(F.col("template").alias("pattern")).agg(F.count("*").alias("count"))
    whole = counts.agg(F.count("*").alias("distinct_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("covered"))
    top = counts.join(ids, "pattern").orderBy(F.desc("count"), "id").limit(limit)
    return top.crossJoin(F.broadcast(whole)).select("id", "pattern", "count", "distinct_count", "covered")


def clusters_by_level(lines: DataFrame, levels: Sequence[str], limit: int = 6) -> DataFrame:
    return clusters(lines, limit, F.col("level").isin(list(levels)))
