"""The events table as logs: rendered as text in several formats, or as typed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.operators.patterns import with_templates
from logfathom.operators.records import assign_records
from logfathom.sources.files import from_columns, from_table

LEVEL_OF = {"error": "ERROR", "signup": "WARN", "purchase": "INFO", "click": "DEBUG", "view": "TRACE"}
YEAR = 2024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (to the ms), level, event, user, k, value as text and the numbers that they are."""
    e = table(spark, sf_dir, "events")
    level = F.element_at(F.create_map(*[F.lit(x) for pair in LEVEL_OF.items() for x in pair]), F.col("event_type"))
    return e.select(
        "event_id", F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), level.alias("level"), F.col("event_type").alias("event"),
        F.col("user_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user"), F.get_json_object("props", "$.k").alias("k"), F.col("value").cast("string").alias("value"),
    )


def _text(e: DataFrame, text) -> DataFrame:
    return from_table(e.select("event_id", text.alias("text")), "text", ["event_id"])


def app_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``2024-01-01 00:00:07.179 [ERROR] user.u8 - error k=69 took 6.55ms``"""
    return _text(e := events(spark, sf_dir), F.format_string("%s [%s] user.%s - %s k=%s took %sms", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), e.level, e.user, e.event, e.k, e.value))


def bracketed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(e := events(spark, sf_dir), F.format_string("[%s] [%s] %s by %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSS'Z'"), F.lower(e.level), e.event, e.user))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    agent = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(' "http://ref/'), e.k, F.lit('" "agent '), e.user, F.lit('"'))).otherwise(F.lit(""))
    protocol = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.lit(" HTTP/1.1"))
    status = F.when(e.event == "error", "500").otherwise("200")
    return _text(e, F.concat(F.lit("10.0.0.1 - "), e.user, F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), e.event, F.lit("/"), e.k, protocol, F.lit('" '), status, F.lit(" "), e.k, agent))


def syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    pid = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("["), F.col("user_id"), F.lit("]"))).otherwise(F.lit(""))
    return _text(e, F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host"), F.col("user_id") % 5, F.lit(" "), e.event, F.lit("d"), pid, F.lit(": k is "), e.k))


def python_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(e := events(spark, sf_dir), F.format_string("%s:app.%s:took %s", e.level, e.event, e.value))


def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    text = F.format_string('{"timestamp":"%s","level":"%s","event":"%s","user":{"id":%s,"name":"%s"},"value":%s,"props":{"k":%s},"tags":["a","%s"]}', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lower(e.level), e.event, F.col("user_id"), e.user, e.value, e.k, e.event)
    return _text(e, text)


def logfmt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(e := events(spark, sf_dir), F.format_string('time=%s level=%s msg="%s of \\"%s\\"" k=%s value=%s', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lower(e.level), e.event, e.user, e.k, e.value))


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines straight from the columns: fields event, user, k, duration_ms; u<user> streams of no use are avoided by one
    stream for each remainder of event_id by 4."""
    e = events(spark, sf_dir)
    text = F.format_string("%s k=%s by %s", e.event, e.k, e.user)
    lines = from_columns(e, F.col("ts"), F.col("level"), {"event": e.event, "user": e.user, "k": e.k, "duration_ms": e.value}, text, F.concat(F.lit("s"), F.col("event_id") % 4), F.floor(F.col("event_id") / 4))
    return with_templates(lines.withColumn("head", F.col("line_no")).withColumn("is_head", F.lit(True)))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as streams of raw lines, parsed as raw text and folded into records."""
    from logfathom.operators.parsing import parse_raw
    from logfathom.sources.files import explode_lines

    raw = explode_lines(table(spark, sf_dir, "documents"), "text", F.col("doc_id").cast("string"))
    return with_templates(assign_records(parse_raw(raw)))
