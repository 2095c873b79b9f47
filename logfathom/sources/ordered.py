"""Tables written to the shared folder: as they are, or in an order, as range partitions with known row counts.

An ordered table answers a page or a seek from the one or two partitions that hold its rows, numbers rows densely, and
gives running sums, without a window or a sort that sees all rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = "__at"  # (number of the partition << 33) + place in it


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one
    in local mode; on a cluster that is an error, since executors don't see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, however often it is used."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Part:
    """A range partition: its number and files, the rows before it, its rows, and the least and greatest value of the first
    order column with the number of rows that have one."""

    number: int
    files: tuple[str, ...]
    before: int
    rows: int
    low: object
    high: object
    valued: int


@dataclass(frozen=True)
class Ordered:
    """A table in ascending order, nulls first, in files of its own for each range partition. parts is what its manifest has,
    one small row a partition."""

    spark: SparkSession
    path: str
    schema: T.StructType
    order: tuple[str, ...]
    parts: tuple[Part, ...]

    @property
    def total(self) -> int:
        return sum(p.rows for p in self.parts)

    def read(self, parts: Sequence[Part]) -> DataFrame:
        """The rows of some partitions, with ``__part`` and ``row``, their place in the whole order."""
        schema = T.StructType([*self.schema.fields, T.StructField(_ROW, T.LongType())])
        if not parts:
            files = self.spark.createDataFrame([], schema)
        elif len(parts) == len(self.parts):
            files = self.spark.read.schema(schema).parquet(self.path)
        else:
            files = self.spark.read.schema(schema).parquet(*[f for p in parts for f in p.files])
        files = files.withColumn("__part", F.shiftright(_ROW, 33).cast("int"))
        if len(parts) == 1:
            before = F.lit(parts[0].before)
        else:
            starts = self.spark.createDataFrame([(p.number, p.before) for p in parts], "__part int, __before long")
            files, before = files.join(F.broadcast(starts), "__part"), F.col("__before")
        return files.withColumn("row", before + F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1))).drop(_ROW, "__before")

    def all(self) -> DataFrame:
        return self.read(self.parts)

    def rows(self, first: int, count: int) -> DataFrame:
        """The rows first .. first + count - 1 of the order, in no order themselves; only partitions that have some are read."""
        last = first + count
        hit = [p for p in self.parts if p.before < last and p.before + p.rows > first]
        return self.read(hit).filter(F.col("row").between(first, last - 1)).drop("__part")

    def page(self, offset: int = 0, limit: int = 200, newest_first: bool = False) -> DataFrame:
        """A page of the order, or of its reverse, sorted."""
        first = max(self.total - offset - limit, 0) if newest_first else offset
        count = max(min(limit, self.total - offset), 0)
        return self.rows(first, count).orderBy(F.col("row").desc() if newest_first else F.col("row")).drop("row")

    def seek(self, value: object) -> DataFrame:
        """One row: n, how many rows have a first order column under a value; reads the partitions that have it inside."""
        valued = [p for p in self.parts if p.valued]
        known = sum(p.valued for p in valued if p.high < value)
        inside = self.read([p for p in valued if p.low < value <= p.high])
        return inside.filter(F.col(self.order[0]) < F.lit(value)).agg((F.count("*") + F.lit(known)).alias("n"))


def in_order(df: DataFrame, order: Sequence[str], label: str = "ordered", parts: int | None = None) -> Ordered:
    """Write df in the order of some columns as range partitions, which Spark chooses from a sample of the rows."""
    spark, order = df.sparkSession, list(order)
    n, path = parts or int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(df.sparkSession, label)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(_ROW, F.monotonically_increasing_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_ROW, T.LongType())])).parquet(path)
    by_part = rows.groupBy(F.shiftright(_ROW, 33).cast("int").alias("part")).agg(F.collect_set("_metadata.file_path").alias("files"), F.count("*").alias("n"), F.min(order[0]).alias("low"), F.max(order[0]).alias("high"), F.count(order[0]).alias("valued"))
    found = by_part.orderBy("part").collect()
    made, before = [], 0
    for r in found:
        made.append(Part(r["part"], tuple(map(unquote, r["files"])), before, r["n"], r["low"], r["high"], r["valued"]))
        before += r["n"]
    return Ordered(spark, path, df.schema, tuple(order), tuple(made))


def numbered(df: DataFrame, order: Sequence[str], name: str, within: Column | None = None) -> DataFrame:
    """df with dense numbers from 0 by the order, or inside each value of ``within``, which must be the first of order."""
    got = in_order(df, order, "numbered").all().drop("__part")
    if within is None:
        return got.withColumnRenamed("row", name)
    keyed = got.withColumn("__key", within)
    first = keyed.groupBy("__key").agg(F.min("row").alias("__first")).withColumnRenamed("__key", "__of")
    return keyed.join(first, F.col("__key").eqNullSafe(F.col("__of"))).withColumn(name, F.col("row") - F.col("__first")).drop("row", "__key", "__of", "__first")
