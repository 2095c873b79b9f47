"""The folder that the driver and all executors share, and tables staged there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARTS = 256


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder becomes it in local mode (tests); on
    a cluster that is an error, since executors don't see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and kept when executors go. Results are lazy and may
    read staged tables at any time, so nothing here removes them: who owns the shared folder clears it when a job ends."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_least(rows: DataFrame, key: str, by: str, value: str, name: str) -> DataFrame:
    """rows with ``name``, the smallest ``value`` of all rows of their key. A key's rows are dealt over parts by ``by``: one
    task sees a part's rows or the (at most 256) least values of a key's parts, never all rows of a hot key. The key and
    ``by`` must not be null."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(_PARTS)))
    parts = dealt.groupBy(key, "__part").agg(F.min(value).alias(name))
    least = parts.withColumn(name, F.min(name).over(Window.partitionBy(key)))
    return dealt.join(least, [key, "__part"]).drop("__part")
