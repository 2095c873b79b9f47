"""Multi-line records: a head line and the lines that continue it.

Windows run inside splits of a stream (ranges of line numbers); one summary row for each split is carried over to the
next ones and joined back, so that one huge stream is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT_LINES = 1 << 16


def carried(df: DataFrame, value: Column, backward: bool = False, own: bool = True, split_lines: int = SPLIT_LINES) -> tuple[DataFrame, Column]:
    """df (stream, line_no, ...) with a column that holds the nearest non-null value at or before each line of its stream
    (after it if backward; without the line itself if not own), and that column."""
    rows = df.withColumn("__v", value).withColumn("__split", F.floor(F.col("line_no") / split_lines))
    order = F.col("line_no").desc() if backward else F.col("line_no").asc()
    near = F.last("__v", ignorenulls=True).over(Window.partitionBy("stream", "__split").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    at = F.when(F.col("__v").isNotNull(), F.col("line_no"))
    summary = rows.groupBy("stream", "__split").agg((F.min_by("__v", at) if backward else F.max_by("__v", at)).alias("__end"))
    by_split = Window.partitionBy("stream").orderBy(F.col("__split").desc() if backward else F.col("__split").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = summary.withColumn("__before", F.last("__end", ignorenulls=True).over(by_split)).select("stream", "__split", "__before")
    got = rows.withColumn("__near", near).join(ends, ["stream", "__split"])
    name = F.coalesce("__near", "__before")
    return got, name


def _bare(df: DataFrame) -> DataFrame:
    return df.drop("__v", "__split", "__near", "__before")


def assign_records(parsed: DataFrame) -> DataFrame:
    """parsed with head (the last line at or before that starts a record) and is_head; line 0 always starts one."""
    starts = F.coalesce("starts_record", F.lit(False)) | (F.col("line_no") == 0)
    got, head = carried(parsed, F.when(starts, F.col("line_no")))
    return _bare(got.withColumn("head", head)).withColumn("is_head", F.col("head") == F.col("line_no"))


def records(lines: DataFrame) -> DataFrame:
    """stream, head, span, ts, level (the head's) and text, all physical lines joined by LF."""
    by_line = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    at = F.when(F.col("line_no") == F.col("head"), F.lit(0))
    got = lines.groupBy("stream", "head").agg(F.count("*").cast("int").alias("span"), F.min_by("ts", at).alias("ts"), F.min_by("level", at).alias("level"), by_line.alias("all"))
    return got.select("stream", "head", "span", "ts", "level", F.array_join(F.transform("all", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def record_detail(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """For each asked (stream, line_no): its ts, level, fields, raw text and, for a head of a longer record, record."""
    asked = keys.select("stream", "line_no").distinct()
    rows = lines.join(asked, ["stream", "line_no"], "left_semi")
    heads = rows.filter("is_head").select("stream", "head")
    full = records(lines.join(heads, ["stream", "head"], "left_semi")).filter("span > 1").select("stream", "head", F.col("text").alias("record"))
    return rows.join(full.withColumnRenamed("head", "line_no"), ["stream", "line_no"], "left").select("stream", "line_no", "ts", "level", "fields", F.col("text").alias("raw"), "record")


def grouped(lines: DataFrame, pred: Column) -> DataFrame:
    """Records of which any physical line matches, once each."""
    hits = lines.filter(pred).select("stream", "head").distinct()
    return records(lines.join(hits, ["stream", "head"], "left_semi"))
