"""Near-duplicate classes by ProbMinHash over weighted five-word shingles.

A shingle's weight is how often the text has it. Each shingle is a Poisson process with its weight as rate; every
arrival picks one of the signature's registers, a register keeps its earliest arrival's shingle, and a shingle stops
once its next arrival is later than all registers. The share of equal registers of two texts estimates their
probability Jaccard similarity, the sum over common shingles x of 1 / sum over y of max(a(y)/a(x), b(y)/b(x)).

Equal texts are one node. Nodes that share a band of registers are compared exactly, in two steps: every node with its
bucket's leader, the one that shares most bands; then, where buckets still hold several components, the nodes outside
the leader's component with all nodes of their bucket (of all their buckets at once, where those hold few nodes). The
second step works inside tasks, through an inverted index of the nodes' shingles, and emits only links that connect
components; pairs are never rows, and a node goes to its buckets at most. So no connection between candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm._shared import stage, with_least
from logfathom.llm._words import mix, slices, text_bytes, window_hashes, word_hashes, word_spans
from logfathom.llm.components import components

_SALTS = 64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, counts and each text's first one; a text of 1 to size - 1 words is one shingle."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    h, doc, _ = window_hashes(words, first, size)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = np.diff(first)[short] > j
            extra[has] = mix(extra[has] + words[first[short[has]] + j])
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(offsets)))


def signatures(h: np.ndarray, weight: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """One row of m registers for each text; texts without shingles get zeros."""
    docs = len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    time, keep = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    now, live, turn = np.zeros(len(h)), np.arange(len(h)), 0
    while len(live):
        turn += 1
        r = mix(h[live] + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        now = now - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[live]
        slot = doc[live] * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, slot, now)
        won = time[slot] == now
        keep[slot[won]] = h[live[won]]
        if turn == 1 or turn % 4 == 0:
            active = np.unique(doc[live])
            end = np.zeros(docs)
            end[active] = time.reshape(docs, m)[active].max(axis=1)
            more = now < end[doc[live]]
            live, now = live[more], now[more]
    return keep.reshape(docs, m)


def similarity(ha: np.ndarray, na: np.ndarray, hb: np.ndarray, nb: np.ndarray) -> float:
    """Exact probability Jaccard of two sorted sets of hashes with counts."""
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    common = hb[at] == ha
    a, b = na[common].astype(float), nb[at[common]].astype(float)
    only_a, only_b = float(na.sum() - a.sum()), float(nb.sum() - b.sum())
    pairs, n = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True)
    return float(sum(k / (only_a / x + only_b / y + np.maximum(a / x, b / y).sum()) for (x, y), k in zip(pairs.tolist(), n.tolist(), strict=True)))


def link_outside(h: np.ndarray, n: np.ndarray, first: np.ndarray, roots: list[int], outside: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (index, index) of similarity ``threshold`` or more that connect what such pairs with an outside text connect,
    beyond the components in ``roots``. One pass over an inverted index for each outside text finds the shares of weight
    that it has in common with all texts; those bound the similarity, and give it where no shingle is repeated."""
    docs = len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    total = np.maximum(np.add.reduceat(np.append(n, 0), first[:-1]).astype(float), 1)
    single = np.array([n[a:b].max(initial=1) == 1 for a, b in zip(first, first[1:], strict=False)])
    order = np.argsort(h, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(h))))
    begins = np.append(begins, len(h))
    by_shingle, weight = doc[order], n[order].astype(float)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links = []
    for a in np.flatnonzero(outside).tolist():
        spans = rank[first[a] : first[a + 1]]
        lengths = begins[spans + 1] - begins[spans]
        at = np.repeat(begins[spans] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
        mine = np.bincount(by_shingle[at], np.repeat(n[first[a] : first[a + 1]], lengths), docs) / total[a]
        theirs = np.bincount(by_shingle[at], weight[at], docs) / total
        for b in np.flatnonzero((mine >= threshold - 1e-9) & (theirs >= threshold - 1e-9)).tolist():
            if a == b or find(roots[a]) == find(roots[b]):
                continue
            if single[a] and single[b]:
                common = mine[b] * total[a]
                sim = common / (total[a] + total[b] - common)
            else:
                sim = similarity(h[first[a] : first[a + 1]], n[first[a] : first[a + 1]], h[first[b] : first[b + 1]], n[first[b] : first[b + 1]])
            if sim >= threshold - 1e-9:
                parent[find(roots[a])] = find(roots[b])
                links.append((a, b))
    return links


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 25, rows: int = 4, block: int = 1024, block_bytes: int = 8_000_000) -> DataFrame:
    """The class of every document: doc_id, class_id, text_key, class_key; one row for each row of docs.

    Documents are linked if their probability Jaccard is at least the threshold; classes are the components of all
    links, equal texts always in one. A class is named by its smallest doc_id (class_id; null doc_ids come last) and by
    the MD5 of that document's text (class_key; the smaller for a tie). With 25 bands of 4 registers, two texts of
    similarity 0.8 are missed as candidates once in 500,000. A text without words (null, empty, blank) is alike to none:
    class_id is its own doc_id and class_key is null. A text of 1 to 4 words is a single shingle. Repeated rows are
    copies of each other. Extra columns are ignored; an empty table gives no rows.

    A leader's bucket is dealt over tasks by ``block`` members. What leaders leave over goes to tasks by cluster of buckets or
    by bucket, whichever takes fewer rows; of more than about ``block`` nodes or ``block_bytes`` bytes of text pairs of blocks
    go, so that no task holds a whole group.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for x in batches for part in slices(x, "text")):
            h, n, first = shingles(*text_bytes(batch.column("text")), size)
            full = np.flatnonzero(np.diff(first))
            sig = signatures(h, n.astype(float), first, bands * rows)[full].reshape(-1, bands, rows)
            band = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]) * np.uint64(0x9E3779B97F4A7C15))
            for r in range(rows):
                band = mix(band + sig[:, :, r])
            take = pa.array(full)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands), pa.int32()), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(take), batch.column("doc_id").take(take), lists], names=["text_key", "doc_id", "bands"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            columns = [batch.column("text_key"), pa.array(map(len, raw), pa.int64()), pa.array(map(z.compress, raw), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "bytes", "z"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = pa.array([z.decompress(x) for x in batch.column("zv").to_pylist()], pa.large_binary())
            batch = batch.append_column("raw", raw)
            last, own = None, None
            for part in slices(batch, "raw"):
                h, n, first = shingles(*text_bytes(part.column("raw")), size)
                out = []
                for i, (u, zu) in enumerate(zip(part.column("u").to_pylist(), part.column("zu"), strict=True)):
                    if u != last:
                        data = np.frombuffer(z.decompress(zu.as_py()), np.uint8)
                        last, own = u, shingles(data, np.array([0, len(data)]), size)
                    out.append(similarity(own[0], own[1], h[first[i] : first[i + 1]], n[first[i] : first[i + 1]]))
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), pa.array(out, pa.float64())], names=["u", "v", "sim"])

    def link_block(key: tuple, table: pa.Table) -> pa.Table:
        """Links enough to join what is alike among a block's outside nodes and all of its nodes."""
        z = zstandard.ZstdDecompressor()
        nodes, roots_, out_ = table.column("node").to_numpy(), table.column("root").to_pylist(), table.column("outside").to_numpy(zero_copy_only=False)
        order = np.lexsort((~out_, nodes))  # a node that is on both sides counts once, as an outside one
        order = order[np.concatenate(([True], nodes[order][1:] != nodes[order][:-1]))]
        texts_ = [z.decompress(table.column("z")[i].as_py()) for i in order.tolist()]
        parts, firsts = [], [0]
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts_, pa.large_binary())], names=["raw"]), "raw"):
            h, n, first = shingles(*text_bytes(part.column("raw")), size)
            parts.append((h, n))
            firsts += (first[1:] + firsts[-1]).tolist()
        links = link_outside(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array(firsts), [roots_[i] for i in order.tolist()], out_[order], threshold)
        return pa.table({"u": pa.array([int(nodes[order[a]]) for a, _ in links], pa.int64()), "v": pa.array([int(nodes[order[b]]) for _, b in links], pa.int64())})

    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    signed = keyed.mapInArrow(sign, "text_key string, doc_id long, bands array<long>")
    nodes = signed.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("band"))
    sizes = stage(spread.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")  # as a table, so that Spark may split the join
    members = stage(spread.join(sizes, "band"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    texts = keyed.select("text_key", "text").mapInArrow(squeeze, "text_key string, bytes long, z binary").groupBy("text_key").agg(F.first("bytes").alias("bytes"), F.first("z").alias("z"))
    texts = stage(texts.join(wanted.hint("merge"), "text_key").select("node", "bytes", "z"), "texts")

    def compared(pairs: DataFrame, label: str) -> DataFrame:
        """The similarity of each pair (u, v, part); rows come grouped by u, whose shingles are kept from row to row. A u with
        many pairs has them in several parts, each with a copy of its text."""
        with_v = pairs.join(texts.select(F.col("node").alias("v"), F.col("z").alias("zv")), "v")
        copies = pairs.select("u", "part").distinct().join(texts.select(F.col("node").alias("u"), F.col("z").alias("zu")), "u")
        with_u = with_v.join(copies.hint("merge"), ["u", "part"])
        return stage(with_u.select("u", "v", "zu", "zv").mapInArrow(compare, "u long, v long, sim double"), label)

    shared = members.groupBy("node").agg(F.sum("n").alias("shared"))
    ranked = members.join(shared, "node")
    leaders = stage(ranked.groupBy("band").agg(F.max(F.struct("shared", (-F.col("node")).alias("least"))).alias("top")).select("band", (-F.col("top.least")).alias("u")), "leaders")
    led = members.select("band", "n", F.col("node").alias("v")).join(leaders, "band").filter("u <> v")
    led = led.groupBy("u", "v").agg(F.max("n").alias("n"))
    first = compared(led.select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / block)).alias("part")), "with-leaders")
    links = first.filter(F.col("sim") >= threshold - 1e-9).select("u", "v")
    roots = stage(components(links), "components")

    # Buckets that still hold several components: in each the nodes outside its leader's component are compared with all of
    # its nodes. Buckets whose nodes fall into one small cluster (linked through the components of bucket leaders) are done together.
    placed = members.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = stage(placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band"), "mixed-buckets")
    leader_of = leaders.join(roots, leaders.u == roots.node, "left").select("band", "u", F.coalesce("root", "u").alias("leader_root"))
    placed = stage(placed.join(mixed, "band").join(leader_of, "band"), "mixed")
    if not placed.isEmpty():
        clusters = components(placed.select(F.col("leader_root").alias("u"), F.col("root").alias("v")))  # of components: far fewer links than nodes have
        status = placed.groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("leader_root")).alias("outside"))
        status = stage(status.join(clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root").join(texts.select("node", "bytes"), "node"), "clusters")
        # A cluster goes to tasks as a whole, by pairs of its blocks if it has several, or else by its buckets, whichever takes
        # fewer rows. By buckets a node goes to those it is in, one for each band at most, however large the cluster.
        blocks = lambda rows, size: F.ceil(F.greatest(rows / block, size / block_bytes))

        def sized_by(rows: DataFrame, *keys: str) -> DataFrame:
            """The blocks of all and of outside nodes, and the rows that dealing them out takes."""
            out = F.coalesce(blocks(F.count_if("outside"), F.sum(F.when(F.col("outside"), F.col("bytes")))), F.lit(0))
            sizes = rows.groupBy(*keys).agg(blocks(F.count("*"), F.sum("bytes")).alias("all_blocks"), out.alias("out_blocks"), F.count("*").alias("n"), F.count_if("outside").alias("n_out"))
            return sizes.withColumn("cost", F.col("n") * F.col("out_blocks") + F.col("n_out") * F.col("all_blocks"))

        in_buckets = stage(placed.select(F.col("band").alias("unit"), "node", (F.col("root") != F.col("leader_root")).alias("outside"), F.col("root").alias("own_root")).join(status.select("node", "cluster", "bytes"), "node"), "in-buckets")
        by_bucket = sized_by(in_buckets, "cluster", "unit").groupBy("cluster").agg(F.sum("cost").alias("by_bucket"))
        large = stage(sized_by(status, "cluster").join(by_bucket, "cluster").filter("all_blocks > 1 and by_bucket < cost").select("cluster"), "large-clusters")
        whole = status.join(large, "cluster", "left_anti").select(F.lit("cluster").alias("kind"), F.col("cluster").alias("unit"), "node", "root", "outside", "bytes")
        parts = in_buckets.join(large, "cluster", "left_semi").select(F.lit("bucket").alias("kind"), "unit", "node", F.col("own_root").alias("root"), "outside", "bytes")
        units = stage(whole.union(parts), "units")
        unit = ["kind", "unit"]
        sizes = sized_by(units, *unit).select(*unit, "all_blocks", "out_blocks")
        # The numbers of units with several blocks go to salted parts of the unit, so that none is one task's.
        several = sizes.filter("all_blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
        salted = units.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(_SALTS)).cast("long")).join(several, [*unit, "salt"], "left")
        sized = salted.withColumns({"all_blocks": F.coalesce("all_blocks", F.lit(1).cast("long")), "out_blocks": F.coalesce("out_blocks", F.lit(1).cast("long"))})
        at = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        row = ["node", "root", "outside"]
        outer = sized.filter("outside").select(*unit, at("o", "out_blocks").alias("i"), every("all_blocks").alias("j"), *row)
        inner = sized.filter("out_blocks > 0").select(*unit, every("out_blocks").alias("i"), at("m", "all_blocks").alias("j"), "node", "root", F.lit(False).alias("outside"))
        dealt = outer.union(inner).join(texts.select("node", "z"), "node").repartition(*unit, "i", "j")  # or Spark would keep a unit's blocks together
        more = stage(dealt.groupBy(*unit, "i", "j").applyInArrow(link_block, "u long, v long"), "across")
        if not more.isEmpty():
            roots = stage(components(roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "components")

    named = nodes.join(roots, "node", "left").select("text_key", F.coalesce("root", "node").alias("root"), F.struct(F.col("least").isNull(), "least", "text_key").alias("name"))
    of_text = with_least(named, "root", "text_key", "name", "top").select("text_key", F.col("top.least").alias("class_id"), F.col("top.text_key").alias("class_key"))
    out = keyed.select("doc_id", "text_key").join(of_text, "text_key", "left")
    return out.select("doc_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "text_key", "class_key")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without near-duplicates: of each class the row that names it stays (one of them if it is repeated), with all
    its columns. Texts without words are alike to none and all stay. Takes near_duplicates()'s parameters."""
    key = lambda text_key: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_key).alias("__row_key")
    found = near_duplicates(docs, **how).filter(F.col("text_key") == F.col("class_key")).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(~wordless).select(*docs.columns, key(F.md5(F.col("text").cast("binary"))))
    one = rows.join(found.select(key(F.col("text_key"))).distinct(), "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return one.select(*docs.columns).union(docs.filter(wordless))
