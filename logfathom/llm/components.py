"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm._shared import stage, with_least

_FEW = 20_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of all nodes of the links that this task has, which are all there are."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in list(up)], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, most_rounds: int = 50, few: int = _FEW) -> DataFrame:
    """(node, root) for every node of edges (u, v: long); root is the component's smallest node.

    Each half round is a minimum by node and a join with it, never a gathered neighbourhood; both deal the links of a node
    over parts, so that a node with very many of them is not one task's. Every half round is written to the shared folder.
    At most ``few`` distinct links are united in one task instead, whose memory that number bounds. Loops and repeated links
    are fine; without links there are no rows.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    if now.count() <= few:
        return now.repartition(1).mapInArrow(_united, "node long, root long")
    mark = None
    for _ in range(most_rounds):
        large = with_least(now.union(now.select("v", "u")), "u", "v", "v", "m").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        now = stage(large.filter("u > v").distinct(), "large")
        small = with_least(now, "u", "v", "v", "m").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stage(small.filter("u > v").distinct(), "small")
        was, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == was or mark[0] == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
