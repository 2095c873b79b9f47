"""A token index beside an incremental table: which of its files have which tokens, so that a search reads those files alone.

It is a table of (token, file) in the order of tokens, written for each generation of lines before the manifest names it, so
a version of the table always has its index. A lookup reads the row groups whose tokens it asks for.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfathom.functions.predicates import phrase, term
from logfathom.functions.values import folded_tokens, tokens_of
from logfathom.sources.files import live_files, snapshot

_CHARS = 64  # of a token that are indexed; a longer one is found by them, and then checked on the lines
_ROW_GROUP = 1 << 20  # bytes


def write_index(spark: SparkSession, table: str, generation: str) -> None:
    """Index the lines of a generation. Each task counts a token of its files once; only (token, file) pairs are shuffled."""
    lines = spark.read.schema("text string").parquet(f"{table}/lines/generation={generation}")
    tokens = F.array_distinct(F.transform(F.split(F.trim(tokens_of(F.col("text"))), " "), lambda t: F.substring(t, 1, _CHARS)))
    pairs = lines.select(F.explode(tokens).alias("token"), F.col("_metadata.file_path").alias("file")).filter("token <> ''").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionByRange(parts, "token", "file").sortWithinPartitions("token", "file")
    ordered.write.option("parquet.block.size", _ROW_GROUP).mode("append").parquet(f"{table}/index/generation={generation}")


def _wanted(value: str, whole: bool) -> list[Column]:
    """A condition on the index for each token that a line must have."""
    tokens = [t[:_CHARS] for t in folded_tokens(value).split()]
    if not tokens:
        return []
    return [*(F.col("token") == t for t in tokens[:-1]), F.col("token") == tokens[-1] if whole else F.col("token").startswith(tokens[-1])]


def candidate_files(spark: SparkSession, table: str, value: str, whole: bool = False) -> list[str]:
    """The data files of the last whole version that have all tokens of value (the last as a prefix, unless whole)."""
    wanted = _wanted(value, whole)
    generations = [r["generation"] for r in live_files(spark, table).select("generation").distinct().collect()]
    if not wanted or not generations:
        return []
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("file", T.StringType()), T.StructField("generation", T.StringType())])
    index = spark.read.schema(schema).parquet(f"{table}/index").filter(F.col("generation").isin(generations))
    any_ = wanted[0]
    for w in wanted[1:]:
        any_ = any_ | w
    has = index.filter(any_).groupBy("file").agg(*[F.max(w).alias(f"t{i}") for i, w in enumerate(wanted)])
    return sorted(unquote(r["file"]) for r in has.filter(" and ".join(f"t{i}" for i in range(len(wanted)))).select("file").collect())  # names of files that are read next


def indexed_search(spark: SparkSession, table: str, value: str, whole: bool = False) -> DataFrame:
    """The lines of an indexed table that term(value), or phrase(value) if whole, finds: the rows of the filter over
    snapshot(), read from the files that have the tokens."""
    files = candidate_files(spark, table, value, whole)
    if not files:
        return snapshot(spark, table).filter(F.lit(False))
    lines = spark.read.option("basePath", f"{table}/lines").parquet(*files)
    return lines.join(live_files(spark, table), ["stream", "generation"]).filter(phrase(value) if whole else term(value))
