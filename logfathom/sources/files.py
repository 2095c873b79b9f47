"""Sources and sinks: log files, rotation groups and tables as numbered lines; CSV, JSON and incremental tables out."""

from __future__ import annotations

import gzip
import io
import itertools
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfathom.sources.ordered import numbered, scratch

LINE_CHARS, SHOWN_CHARS = 1 << 20, 4096
LEVEL_TS = ["ts", "level"]
# What rotation adds to a name, and the endings of compressed files.
_GZIP = b"\x1f\x8b"
_DATE, _PACKED = r"[._-]\d{4}-?\d{2}-?\d{2}", "gz|gzip|bz2|xz|zip"


def with_line_numbers(df: DataFrame, stream: Sequence[str], split: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """line_no, dense from 0 in each stream, by numbering inside splits.

    Splits are ordered by the ``split`` columns inside a stream; rows inside a split by ``order``. A window never holds
    more than a split; the splits' row counts, one row each, are summed up and joined back. Rows with null streams or
    splits are numbered like others.
    """
    keys = [*stream, *split]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*stream).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*[F.col(k).alias(f"__{k}") for k in keys], "__start")
    numbered = df.withColumn("__at", inside)
    on = [numbered[k].eqNullSafe(starts[f"__{k}"]) for k in keys]
    return numbered.join(starts, on).withColumn("line_no", (F.col("__start") + F.col("__at")).cast("long")).drop("__at", "__start", *[f"__{k}" for k in keys])


def clean_line(c: Column) -> Column:
    """A physical line: one trailing CR dropped, at most 1 MiB of characters."""
    return F.substring(F.regexp_replace(c, r"\r\z", ""), 1, LINE_CHARS)


def _read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the file and split they come from and their place in it (the scan's own order)."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    meta = "_metadata"
    return lines.select(clean_line(F.col("value")).alias("text"), F.col(f"{meta}.file_path").alias("path"), F.col(f"{meta}.file_name").alias("name"), F.col(f"{meta}.file_block_start").alias("block"), F.col(f"{meta}.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("place"))


def _numbered(rows: DataFrame, split: Sequence[str]) -> DataFrame:
    """stream, line_no, text of scanned lines. Places rise by one inside a split, so a line's number is its place less the
    split's first, plus the lines of the splits before; only a row a split is shuffled, texts stay where they are read."""
    keys = ["stream", *split]
    ends = rows.groupBy(*keys).agg(F.min("place").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("stream").orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__add", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    return rows.join(starts, keys).select("stream", (F.col("place") + F.col("__add")).alias("line_no"), "text")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """stream, line_no, text of text files; a stream is a file. Lines end at LF alone and lose one CR; blank lines stay;
    a last line needs no LF. ``.gz`` files are decompressed by their codec, as one split each."""
    rows = _read(spark, path).withColumn("stream", F.col("path"))
    return _numbered(rows, ["block"])


def read_packed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As read_lines(), for files that are gzip by their content, whatever they are called (``.gzip``, no ending), and
    others. Such a file can't be split, so each is one task's; it is unpacked as its lines are read."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == _GZIP else io.BytesIO(content)
                number = 0
                while lines := list(itertools.islice(data, 10_000)):
                    texts = [x.removesuffix(b"\n").decode("utf-8", "replace") for x in lines]
                    yield pa.RecordBatch.from_arrays([pa.array([stream] * len(texts)), pa.array(range(number, number + len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["stream", "line_no", "text"])
                    number += len(texts)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "stream string, line_no long, text string").withColumn("text", clean_line(F.col("text")))


def rotation_base(name: Column) -> Column:
    """A file name without compression, rotation number and date."""
    # Either a date before a plain extension, or a date and a number at the end, each of which may be missing.
    found = rf"(?i)^(.+?)(?:{_DATE}(\.[a-z][a-z0-9]*))?(?:{_DATE})?(?:\.\d+)?(?:\.(?:{_PACKED}))?\z"
    return F.regexp_replace(name, found, "$1$2")


def read_rotation_group(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As read_lines(), but files of one folder whose names share a rotation base are one stream, oldest first by
    modification time (then by name). A stream is named by folder and base."""
    rows = _read(spark, path).withColumn("stream", F.concat(F.regexp_extract("path", r"^(.*/)[^/]*$", 1), rotation_base(F.col("name"))))
    return _numbered(rows, ["modified", "name", "block"])


def from_table(df: DataFrame, text_col: str, order_cols: Sequence[str], stream_cols: Sequence[str] = (), split_rows: int = 1 << 14) -> DataFrame:
    """stream, line_no, text of any table's text column, numbered by order_cols within stream_cols (joined by ``/``).

    A first order column that is a number or a time also cuts a stream into splits, of ``split_rows`` units or an hour,
    so that no window holds a whole stream; by any other column the rows are written as range partitions, whose counts give
    the numbers. Null texts are empty lines; nulls sort first.
    """
    stream = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stream_cols]) if stream_cols else F.lit("table")
    first, kind = F.col(order_cols[0]), df.schema[order_cols[0]].dataType
    if isinstance(kind, T.IntegralType):
        split = F.floor(first / split_rows)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        split = F.date_trunc("hour", first)
    else:
        keys = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order_cols)]
        bare = df.select(stream.alias("stream"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keys)
        return numbered(bare, ["stream", *[f"__o{i}" for i in range(len(keys))]], "line_no", F.col("stream")).select("stream", "line_no", "text")
    rows = df.withColumn("stream", stream).withColumn("__split", split).withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
    return with_line_numbers(rows, ["stream"], ["__split"], [F.col(c) if c != "text" else F.col(text_col) for c in order_cols]).select("stream", "line_no", "text")


def explode_lines(df: DataFrame, text_col: str, stream: Column) -> DataFrame:
    """stream, line_no, text with each row of df as a stream of its own, its text split at LF."""
    parts = df.select(stream.alias("stream"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_no", "text"))
    return parts.select("stream", F.col("line_no").cast("long").alias("line_no"), clean_line(F.col("text")).alias("text"))


def from_columns(df: DataFrame, ts: Column, level: Column, fields: dict[str, Column], text: Column, stream: Column, line_no: Column) -> DataFrame:
    """Parsed lines straight from typed columns; every row starts a record. A null field is absent from the map."""
    pairs = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))) for k, c in fields.items()])
    ms = F.timestamp_millis(F.unix_millis(ts.cast("timestamp")))
    return df.select(stream.alias("stream"), line_no.cast("long").alias("line_no"), text.alias("text"), F.lit("columns").alias("format"), ms.alias("ts"), level.alias("level"), text.alias("message"), F.map_from_entries(F.array_compact(pairs)).alias("fields"), F.lit(True).alias("starts_record"))


def export_rows(lines: DataFrame, redactor=None) -> DataFrame:
    """line (from 1), timestamp (ISO, ms), level, content (4,096 characters at most, redacted if asked for)."""
    content = F.substring("text", 1, SHOWN_CHARS)
    return lines.select((F.col("line_no") + 1).alias("line"), F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "level", (redactor(content) if redactor else content).alias("content"))


def write_csv(lines: DataFrame, path: str, redactor=None) -> None:
    export_rows(lines, redactor).write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json(lines: DataFrame, path: str, redactor=None) -> None:
    """JSON lines; null timestamps and levels are written as null."""
    export_rows(lines, redactor).write.json(path, ignoreNullFields=False)


def _versions(spark: SparkSession, table: str) -> tuple[int, int | None]:
    """The highest version of a table's manifest, begun or whole, and the highest that is whole (Spark marks it last)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/manifest")
    where = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not where.exists(path):
        return 0, None
    found = {int(x.getPath().getName()[1:]): x.getPath() for x in where.listStatus(path) if x.getPath().getName().startswith("v")}
    whole = [v for v, at in found.items() if where.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))]
    return max(found, default=0), max(whole, default=None)


def _manifest_at(table: str, version: int) -> str:
    return f"{table}/manifest/v{version:010d}"


def live_files(spark: SparkSession, table: str) -> DataFrame:
    """stream, generation of the files in the last whole version of a table."""
    _, version = _versions(spark, table)
    if version is None:
        raise ValueError(f"no whole version of {table}")
    return spark.read.parquet(_manifest_at(table, version)).select("stream", "generation")


def snapshot(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    """The lines of the last whole version of a table that ingest_incremental() keeps, each with the generation that its
    file was parsed in. Streams and generations are folders, so those that the manifest does not name are not read."""
    live, reader = live_files(spark, table), spark.read
    if schema is not None:
        names = [f for f in schema.fields if f.name not in ("stream", "generation")]
        reader = reader.schema(T.StructType([*names, T.StructField("generation", T.StringType()), T.StructField("stream", T.StringType())]))
    return reader.parquet(f"{table}/lines").join(live, ["stream", "generation"])


def ingest_incremental(spark: SparkSession, paths: str | list[str], table: str, parse, parser_set: str = "", index: bool = False) -> DataFrame:
    """Bring a table up to date with the files that ``paths`` name now, parsing only those whose fingerprint (path, size,
    modification time, parser set) its manifest lacks. ``parse(raw)`` turns stream, line_no, text into the rows to keep.
    Returns the whole table, see snapshot().

    ``table`` is a folder. Lines are Parquet by generation (one for each call) and stream; a version of the manifest says
    which generation each file's lines are of. A call first writes its generation, then the next version; until that is
    whole, readers see the one before, and a call that was broken off leaves only files that no manifest names. Files that
    are gone, renamed or empty now leave no lines. Two calls at once can't write the same version: one of them fails. With
    index, the new lines' tokens are indexed too (see indexed_search()); give it in all calls on a table or in none.
    """
    from logfathom.sources.index import write_index

    listing = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("stream"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(parser_set).alias("parsers"))
    begun, whole = _versions(spark, table)
    keys = ["file", "size", "modified", "parsers"]
    known = None if whole is None else spark.read.parquet(_manifest_at(table, whole))
    fresh = listing if known is None else listing.join(known, keys, "left_anti")
    files = fresh.collect()  # a row for each changed file, which is to be read now: as it was before it is read
    raw = read_lines(spark, [r["file"] for r in files]) if files else spark.createDataFrame([], "stream string, line_no long, text string")
    parsed = parse(raw)
    kept = None if known is None else known.join(listing, keys, "left_semi")
    gone = known is not None and kept.count() < known.count()
    if files or gone or known is None:
        generation = f"g{uuid.uuid4().hex}"
        parsed.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation", "stream").parquet(f"{table}/lines")
        if index:
            write_index(spark, table, generation)
        read = spark.createDataFrame(files, fresh.schema).withColumn("generation", F.lit(generation))
        (read if kept is None else kept.unionByName(read)).coalesce(1).write.parquet(_manifest_at(table, begun + 1))
    return snapshot(spark, table, parsed.schema)


def vacuum(spark: SparkSession, table: str) -> int:
    """Remove what no reader of the last whole version needs: older versions, and generations that it does not name. Gives
    the number of folders removed. Not to be run beside ingest_incremental() on the same table."""
    _, version = _versions(spark, table)
    if version is None:
        return 0
    live = {r["generation"] for r in spark.read.parquet(_manifest_at(table, version)).select("generation").distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    where, removed = path.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    names = [f"manifest/v{v:010d}" for v in range(1, version)]
    for kind in ("lines", "index"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{kind}")
        found = [x.getPath().getName() for x in where.listStatus(at) if x.isDirectory()] if where.exists(at) else []
        names += [f"{kind}/{name}" for name in found if name.removeprefix("generation=") not in live]
    for name in names:
        removed += bool(where.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{name}"), True))
    return removed
