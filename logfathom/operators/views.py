"""Selections over lines: search, pages, tables, context, neighbours, funnels, evidence, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.operators.records import _bare, carried, grouped as grouped_records
from logfathom.sources.ordered import Ordered, in_order

SHOWN_CHARS, PAGE_ROWS, CONTEXT_LINES, RANGE_LINES, EVIDENCE_LINES = 4096, 2000, 1000, 500, 1000
_SPLIT = 1024  # lines; no fewer than CONTEXT_LINES, so that a hit reaches the next split at most


def search(lines: DataFrame, pred: Column, grouped: bool = False) -> DataFrame:
    """Matching lines, or the records of which a line matches. Order by (stream, line_no) where an order is needed."""
    return grouped_records(lines, pred) if grouped else lines.filter(pred)


def mark_matches(lines: DataFrame, pred: Column) -> DataFrame:
    """All lines, with a flag."""
    return lines.withColumn("match", F.coalesce(pred, F.lit(False)))


def page(df: DataFrame, offset: int = 0, limit: int = 200, newest_first: bool = False) -> DataFrame:
    """A stable page of at most 2,000 rows; text cut at 4,096 characters, with a flag."""
    order = [F.col(c).desc() if newest_first else F.col(c).asc() for c in ("stream", "line_no")]
    rows = df.orderBy(*order).offset(offset).limit(min(limit, PAGE_ROWS))
    return rows.withColumn("truncated", F.char_length("text") > SHOWN_CHARS).withColumn("text", F.substring("text", 1, SHOWN_CHARS))


def materialize(df: DataFrame, order: Sequence[str] = ("stream", "line_no")) -> Ordered:
    """A view put in order once, for result_page() and, where the first of order is ``ts``, seeks."""
    return in_order(df, order, "result")


def result_page(result: Ordered, offset: int = 0, limit: int = 200, newest_first: bool = False) -> DataFrame:
    """page() of a materialized result: reads the partitions that hold its rows, however deep."""
    rows = result.page(offset, min(limit, PAGE_ROWS), newest_first)
    return rows.withColumn("truncated", F.char_length("text") > SHOWN_CHARS).withColumn("text", F.substring("text", 1, SHOWN_CHARS))


def table(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """stream, line_no, ts, level and chosen fields, null where missing."""
    return lines.select("stream", "line_no", "ts", "level", *[F.col("fields")[c].alias(c) for c in columns])


def line_range(lines: DataFrame, start: int, count: int) -> DataFrame:
    return lines.filter(F.col("line_no").between(start, start + count - 1)).select("stream", "line_no", "text")


def _merged(hits: Column, before: int, after: int) -> Column:
    """Sorted line numbers as the ranges of lines around them, those that meet made one."""

    def add(ranges: Column, hit: Column) -> Column:
        last = F.try_element_at(ranges, F.lit(-1))
        new = F.struct((hit - before).alias("low"), (hit + after).alias("high"))
        meets = last["high"] >= hit - before - 1
        wider = F.concat(F.slice(ranges, 1, F.size(ranges) - 1), F.array(F.struct(last["low"].alias("low"), (hit + after).alias("high"))))
        return F.when(F.coalesce(meets, F.lit(False)), wider).otherwise(F.concat(ranges, F.array(new)))

    return F.aggregate(hits, F.array().cast("array<struct<low:bigint,high:bigint>>"), add)


def context(lines: DataFrame, pred: Column, before: int = 3, after: int = 3) -> DataFrame:
    """All hits with their neighbours (at most 1,000 on either side), each line once, hits flagged.

    Hits are gathered by split of 1,024 lines, with the last hit of the split before and the first of the one after, the only
    ones of theirs that can matter; they become ranges, and lines meet the ranges of their split: a row a split, however
    many lines there are around a hit.
    """
    before, after = min(max(before, 0), CONTEXT_LINES), min(max(after, 0), CONTEXT_LINES)
    at = F.floor(F.col("line_no") / _SPLIT).cast("long")
    hits = lines.filter(pred).groupBy("stream", at.alias("__split")).agg(F.array_sort(F.collect_set("line_no")).alias("hits"))
    one = lambda split, found: F.struct(split.alias("split"), found.alias("hits"))
    split, found = F.col("__split"), F.col("hits")
    each = hits.select("stream", F.explode(F.array(one(split, found), one(split + 1, F.slice(found, -1, 1)), one(split - 1, F.slice(found, 1, 1)))).alias("e"))
    # (A line may be numbered from anywhere: splits before the first line just have no lines.)
    ranges = each.groupBy("stream", F.col("e.split").alias("__split")).agg(_merged(F.array_sort(F.flatten(F.collect_list("e.hits"))), before, after).alias("__ranges"))
    met = lines.withColumn("__split", at).join(ranges, ["stream", "__split"])
    inside = F.exists("__ranges", lambda r: F.col("line_no").between(r["low"], r["high"]))
    return met.filter(inside).withColumn("match", F.coalesce(pred, F.lit(False))).drop("__split", "__ranges")


def adjacent_hits(lines: DataFrame, pred: Column) -> DataFrame:
    """lines with next_hit and prev_hit, the nearest matching line after and before each one, wrapping at the ends of its
    stream; null in a stream without hits."""
    hit = F.when(F.coalesce(pred, F.lit(False)), F.col("line_no"))
    got, before = carried(lines, hit, own=False)
    got = _bare(got.withColumn("prev_hit", before))
    got, after = carried(got, F.when(F.coalesce(pred, F.lit(False)), F.col("line_no")), backward=True, own=False)
    got = _bare(got.withColumn("next_hit", after))
    ends = lines.filter(pred).groupBy("stream").agg(F.min("line_no").alias("__low"), F.max("line_no").alias("__high"))
    got = got.join(ends, "stream", "left")
    return got.withColumn("next_hit", F.coalesce("next_hit", "__low")).withColumn("prev_hit", F.coalesce("prev_hit", "__high")).drop("__low", "__high")


def count_matches(lines: DataFrame, pred: Column, grouped: bool = False) -> DataFrame:
    """One row: how many lines, or records, match."""
    hits = lines.filter(pred)
    return hits.agg(F.count("*").alias("n")) if not grouped else hits.select("stream", "head").distinct().agg(F.count("*").alias("n"))


def funnel(lines: DataFrame, preds: Sequence[Column], grouped: bool = False) -> DataFrame:
    """step, n: the whole count, then after each further clause; one pass over the lines."""
    steps = [F.lit(True)]
    for p in preds:
        steps.append(steps[-1] & F.coalesce(p, F.lit(False)))
    if grouped:  # a record counts as long as one of its lines passes all clauses so far
        lines = lines.groupBy("stream", "head").agg(*[F.max(s).alias(f"s{i}") for i, s in enumerate(steps)])
        steps = [F.col(f"s{i}") for i in range(len(steps))]
    row = lines.agg(*[F.count_if(s).alias(f"n{i}") for i, s in enumerate(steps)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"n{i}").alias("n")) for i in range(len(steps))])).alias("r")).select("r.step", "r.n")


def delta(df: DataFrame) -> DataFrame:
    """df with delta_ms, the gap to the row before in its stream's view (null if either has no ts), and its band."""
    ms = F.unix_millis("ts")
    got, before = carried(df, F.struct(ms.alias("ms")), own=False)
    got = _bare(got.withColumn("__b", before["ms"]))
    gap = F.unix_millis("ts") - F.col("__b")
    return got.withColumn("delta_ms", gap).drop("__b").withColumn("band", F.when(F.col("delta_ms") >= 60000, "60s").when(F.col("delta_ms") >= 5000, "5s").when(F.col("delta_ms") >= 1000, "1s"))


def evidence(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """The lines that refs (section, position, stream, start, end) cite: at most 500 of a range and 1,000 of all, each once
    in a section, in the order cited."""
    last = F.least(F.col("end"), F.col("start") + RANGE_LINES - 1)
    cited = refs.select("section", "position", "stream", F.explode(F.sequence("start", last)).alias("line_no")).filter(F.col("line_no") >= 0)
    once = cited.groupBy("section", "stream", "line_no").agg(F.min("position").alias("position"))
    found = once.join(lines.select("stream", "line_no", "ts", "level", "text"), ["stream", "line_no"])
    first = found.orderBy("section", "position", "stream", "line_no").limit(EVIDENCE_LINES)  # a report's citations
    return first.withColumn("rank", F.row_number().over(Window.orderBy("section", "position", "stream", "line_no")))


def annotate(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines that have a note (stream, line_no, note), with it."""
    return lines.join(notes.select("stream", "line_no", "note"), ["stream", "line_no"])

