"""The trie of conversations' beginnings, by an Euler tour.

1. Turns are numbered inside range partitions of (conversation, turn), with counts carried over, so that a conversation of
   any length is many tasks' work; the beginnings that conversations take from another are joined in.
2. A beginning is named by the XOR of 128-bit hashes of (place, role, text), again by range partitions with carries. Equal
   names are a node.
3. Each node has an enter and an exit arc. A node's enter arc goes on to its first child's or to its own exit arc; its exit
   arc to its next sibling's enter arc or its parent's exit arc. Arcs are linked up inside range partitions of the nodes,
   which leaves a short list of segments, and that is ranked: by random mates while it is long (an arc whose coin is heads
   takes in its follower with tails), then by pointer jumping in one task.
4. Ranks carry weights: leaves entered, and tokens saved. What a node's subtree has is the difference of the sums at its
   exit and its enter arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm._shared import stage

_CHUNK = 64_000  # bytes of ids that are joined before they are sent
_FEW = 100_000  # segments that one task ranks
_MOST = 5  # turns taken from another conversation at most
_WEIGHTS = ["pos", "leaves", "saved"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in its conversation's run inside this partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        begin = _runs(conv)
        at = np.arange(len(conv)) - np.repeat(begin, np.diff(np.append(begin, len(conv))))
        if last == conv[0]:
            at[: begin[1] if len(begin) > 1 else len(conv)] += seen
        last, seen = int(conv[-1]), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(conv), part)), pa.array(at), batch.column("turn_key"), batch.column("chars")], names=["conv_id", "part", "at", "turn_key", "chars"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running XORs of a and b in each conversation's run inside this partition; kind 1 has those of the whole first and
    last run."""
    part, state, first = TaskContext.get().partitionId(), None, None
    names = ["kind", "part", "conv_id", "depth", "last", "ka", "kb", "a", "b", "chars"]

    def edge(of: tuple[int, int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([1, part, of[0], 0, False, of[1], of[2], 0, 0, 0], kinds, strict=True)], names=names)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        begin = _runs(conv)
        size = np.diff(np.append(begin, len(conv)))
        keys = []
        for lane, name in enumerate("ab"):
            own = batch.column(name).to_numpy().copy()
            if state is not None and state[0] == conv[0]:
                own[0] ^= state[1 + lane]
            run = np.bitwise_xor.accumulate(own)
            keys.append(run ^ np.repeat(np.where(begin > 0, run[begin - 1], 0), size))
        ends = begin + size - 1
        runs = [(int(conv[i]), int(keys[0][i]), int(keys[1][i])) for i in (ends if len(ends) < 3 else ends[[0, -1]])]
        if first is None and state is not None and state[0] != conv[0]:
            first = state  # the first run ended with the batch before
        elif first is None and len(begin) > 1:
            first = runs[0]
        state = runs[-1]
        depth = batch.column("pos").to_numpy() + 1
        columns = [np.zeros(len(conv), np.int32), np.full(len(conv), part), conv, depth, depth == batch.column("length").to_numpy(), *keys, batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("chars").to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)
    for of in (first, state):
        if of is not None:
            yield edge(of)


def _siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next node of the same parent; kind 1 is a partition's last node, whose next one may be in another partition, and
    kind 2 its first."""
    part, held, names = TaskContext.get().partitionId(), None, ["kind", "part", "id", "parent", "next"]

    def one(kind: int, row: tuple[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([row[0]]), pa.array([row[1]]), pa.nulls(1, pa.int64())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        id_, parent = batch.column("id").to_numpy(), batch.column("parent").to_numpy()
        if held is None:
            yield one(2, (int(id_[0]), int(parent[0])))
        else:
            id_, parent = np.append(held[0], id_), np.append(held[1], parent)
        held = int(id_[-1]), int(parent[-1])
        n = len(id_) - 1
        following = pa.array(id_[1:], mask=parent[1:] != parent[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part)), pa.array(id_[:-1]), pa.array(parent[:-1]), following], names=names)
    if held is not None:
        yield one(1, held)


def linked(follower: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of lists (follower: index, or -1 at an end) the first of its list and the sum of the weights before
    it (a row for each kind), by pointer jumping."""
    n = len(follower)
    to = np.arange(n)
    has = np.flatnonzero(follower >= 0)
    to[follower[has]] = has
    before = np.where(to == np.arange(n), 0, weights[:, to])
    while True:
        further = to[to]
        if (further == to).all():
            return to, before
        before = before + before[:, to]
        to = further


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link up the arcs of this partition's nodes. kind 0: the nodes, with the segments of both arcs and the sums in them;
    kind 1: the segments, with the arc that follows."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks().sort_by("id")
    ids, n = table.column("id").to_numpy(), table.num_rows
    filled = lambda c: table.column(c).fill_null(-1).to_numpy()
    child, sibling, parent = filled("first_child"), filled("next"), filled("parent")
    follower = np.empty(2 * n, np.int64)
    follower[0::2] = np.where(child >= 0, 2 * child, 2 * ids + 1)
    follower[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))
    place = np.minimum(np.searchsorted(ids, follower >> 1), n - 1)
    inner = np.where((follower >= 0) & (ids[place] == follower >> 1), 2 * place + (follower & 1), -1)
    weights = np.zeros((3, 2 * n), np.int64)
    weights[0], weights[1, 0::2], weights[2, 0::2] = 1, child < 0, (table.column("n_convs").to_numpy() - 1) * table.column("chars").to_numpy()
    head, before = linked(inner, weights)
    arc = lambda i: 2 * ids[i // 2] + i % 2
    none = lambda k: pa.nulls(k, pa.int64())
    carried = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ka", "kb"]
    names = ["kind", *carried, "enter", *(f"enter_{w}" for w in _WEIGHTS), "exit", *(f"exit_{w}" for w in _WEIGHTS), "next"]
    sides = [x for side in (0, 1) for x in (pa.array(arc(head[side::2])), *(pa.array(w[side::2]) for w in before))]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *(table.column(c).combine_chunks() for c in carried), *sides, none(n)], names=names)
    tail = np.flatnonzero(inner < 0)
    whole = before[:, tail] + weights[:, tail]
    k = len(tail)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), *(none(k) for _ in carried), pa.array(arc(head[tail])), *(pa.array(w) for w in whole), *(none(k) for _ in range(4)), pa.array(follower[tail])], names=names)


def _rank_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums before each segment of the one list of which this task has all segments."""
    got = [b for b in batches if b.num_rows]
    if got:
        table = pa.Table.from_batches(got).combine_chunks().sort_by("segment")
        ids, following = table.column("segment").to_numpy(), table.column("next").to_numpy()
        place = np.minimum(np.searchsorted(ids, following), len(ids) - 1)
        _, before = linked(np.where(ids[place] == following, place, -1), np.stack([table.column(w).to_numpy() for w in _WEIGHTS]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, before)], names=["segment", *_WEIGHTS])


def rank_segments(segments: DataFrame, few: int = _FEW) -> DataFrame:
    """segment, pos, leaves, saved: the sums of these weights over all segments of a list before each of its segments.
    segments: segment, next (-1 at the end), pos, leaves, saved; no segment twice, one list.

    While there are more than ``few`` segments, those with heads take in followers with tails, about a quarter of all each
    round; what was taken in gets its rank from the one that took it, in reverse order.
    """
    rounds: list[DataFrame] = []
    while segments.count() > few:
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(len(rounds))), F.lit(2))  # noqa: B023, E731
        second = segments.select(F.col("segment").alias("taken"), F.col("next").alias("then"), *[F.col(w).alias(f"t_{w}") for w in _WEIGHTS])
        pairs = segments.filter(coin("segment") == 1).join(second.filter(coin("taken") == 0), F.col("next") == F.col("taken"))
        pairs = stage(pairs, "mates")
        rounds.append(pairs.select(F.col("taken").alias("segment"), F.col("segment").alias("into"), *_WEIGHTS))
        grown = pairs.select("segment", F.col("then").alias("next"), *[(F.col(w) + F.col(f"t_{w}")).alias(w) for w in _WEIGHTS])
        gone = pairs.select("segment").union(pairs.select("taken"))
        segments = stage(segments.join(gone, "segment", "left_anti").select("segment", "next", *_WEIGHTS).union(grown), "segments")
    ranks = segments.repartition(1).mapInArrow(_rank_all, "segment long, pos long, leaves long, saved long")  # of ``few`` rows at most
    for taken in reversed(rounds):
        base = ranks.select(F.col("segment").alias("into"), *[F.col(w).alias(f"b_{w}") for w in _WEIGHTS])
        added = taken.join(base, "into").select("segment", *[(F.col(w) + F.col(f"b_{w}")).alias(w) for w in _WEIGHTS])
        ranks = stage(ranks.union(added), "ranks")
    return ranks


def _ends(rows: DataFrame) -> DataFrame:
    """depth, ka, kb, ends_sha256: of each node's conv_ids, ascending. Ids are joined where range partitions hold them, and
    only those pieces meet in a node's task, which hashes them one after another."""
    key = ["ka", "kb", "depth"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [*key, "low", "ids"], None
        for batch in batches:
            out = []
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in [*key, "conv_id"]), strict=True):
                if held is None or held[0] != node or held[3] > _CHUNK:
                    if held is not None:
                        out.append((*held[0], held[1], ",".join(held[2])))
                    held = [node, conv, [], 0]
                held[2].append(str(conv))
                held[3] += len(held[2][-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held[0], held[1], ",".join(held[2]))], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, sha = [*key, "ends_sha256"], None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in [*key, "ids"]), strict=True):
                if node == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.select(*key, "conv_id").repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(join, "ka long, kb long, depth long, low long, ids string")
    return pieces.repartition(parts, *key).sortWithinPartitions(*key, "low").mapInArrow(digest, "ka long, kb long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, few: int = _FEW) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and enter and exit, the ranks of the node's arcs in the tour; one row for each node.

    conversations: conv_id, turn, role, text. A conversation's turns are ordered by turn, null first; rows of one turn by the
    MD5 of role and text. Null role or text is empty. Conversation c is rebuilt as the first h turns of conversation c - c % 100
    (all if it has fewer, none if it isn't there) and its own turns after its first h, h = crc32(c in decimal) % 6. A node is
    a distinct sequence of first turns (role, text), the root that of none; conversations that begin with it are its members,
    also those without any turn left. conv_id is the smallest member, parent_conv_id the parent's (root: null);
    n_leaves counts childless nodes of the subtree, saved_tokens sums its nodes' (n_convs - 1) times the code points of their
    last text, ends_sha256 is of the members that end here, ascending, joined by commas. Rows without a conv_id are of no
    conversation and left out. Repeated rows are turns like any others; extra columns are ignored; an empty table gives no
    rows. ``few``: see rank_segments().
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key.alias("turn_key"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_key")]
    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stage(dealt.mapInArrow(_number, "conv_id long, part long, at long, turn_key string, chars long"), "turns")

    runs = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv_id").orderBy("part")  # a row for each partition that a conversation is in
    runs = runs.withColumns({"before": F.sum("n").over(own) - F.col("n"), "turns": F.sum("n").over(Window.partitionBy("conv_id"))})
    heads_from = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    runs = stage(runs.withColumns({"h": heads_from, "base": F.col("conv_id") - F.col("conv_id") % 100}), "runs")
    convs = runs.filter("before = 0").select("conv_id", "turns", "h", "base")
    based = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns")), "base", "left")
    k = F.least("h", F.coalesce("base_turns", F.lit(0)))
    info = stage(based.select("conv_id", "base", "h", k.alias("k"), (k + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    placed = numbered.join(runs.select("conv_id", "part", "before").join(info, "conv_id"), ["conv_id", "part"]).withColumn("r", F.col("before") + F.col("at"))
    placed = stage(placed.select("conv_id", "r", "h", "k", "length", "turn_key", "chars"), "placed")
    kept = placed.filter("r >= h").select("conv_id", (F.col("k") + F.col("r") - F.col("h")).alias("pos"), "length", "turn_key", "chars")
    heads = placed.filter((F.col("conv_id") % 100 == 0) & (F.col("r") < _MOST)).select(F.col("conv_id").alias("base"), F.col("r").alias("pos"), "turn_key", "chars")
    taken = info.filter("k > 0").join(heads, "base").filter("pos < k").select("conv_id", "pos", "length", "turn_key", "chars")
    rebuilt = kept.union(taken).select("conv_id", "pos", "length", F.xxhash64("pos", "turn_key").alias("a"), F.xxhash64(F.lit("b"), "pos", "turn_key").alias("b"), "chars")

    dealt = rebuilt.repartitionByRange(parts, "conv_id", "pos").sortWithinPartitions("conv_id", "pos")
    local = stage(dealt.mapInArrow(_prefixes, "kind int, part long, conv_id long, depth long, last boolean, ka long, kb long, a long, b long, chars long"), "beginnings")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = local.filter("kind = 1").select("conv_id", "part", "ka", "kb").distinct()  # two rows a partition at most
    carried = edges.select("conv_id", "part", F.bit_xor("ka").over(earlier).alias("ca"), F.bit_xor("kb").over(earlier).alias("cb")).filter("ca is not null")
    joined = local.filter("kind = 0").join(F.broadcast(carried), ["conv_id", "part"], "left")
    keyed = joined.withColumns({"ka": F.col("ka").bitwiseXOR(F.coalesce("ca", F.lit(0))), "kb": F.col("kb").bitwiseXOR(F.coalesce("cb", F.lit(0)))})
    zero = F.lit(0).cast("long")
    paths = keyed.select("conv_id", "depth", "last", "ka", "kb", F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "chars").union(info.select("conv_id", zero, F.col("length") == 0, zero, zero, zero, zero, zero))

    # A node's id orders it by (conv_id, depth), and has the number of the range partition that it is in.
    nodes = paths.groupBy("depth", "ka", "kb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("chars").alias("chars"))
    nodes = stage(nodes.repartitionByRange(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth").withColumn("id", F.monotonically_increasing_id()), "nodes")
    columns = ["id", "conv_id", "depth", "n_convs", "chars", "ka", "kb"]
    root = nodes.filter("depth = 0")  # one row
    of_root = nodes.filter("depth = 1").select(*columns).join(F.broadcast(root.select(F.lit(1).cast("long").alias("depth"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))), "depth").select(*columns, "parent", "parent_conv_id")
    above = nodes.filter("depth > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"))
    deeper = nodes.filter("depth > 1").join(above, ["depth", "pa", "pb"]).select(*columns, "parent", "parent_conv_id")
    none = F.lit(None).cast("long")
    tree = stage(deeper.union(of_root).union(root.select(*columns, none, none)), "tree")
    walked = stage(tree.filter("parent is not null").select("id", "parent").repartitionByRange(parts, "parent", "id").sortWithinPartitions("parent", "id").mapInArrow(_siblings, "kind int, part long, id long, parent long, next long"), "siblings")
    firsts = walked.filter("kind = 2").withColumn("part", F.lag("part").over(Window.orderBy("part")))  # one row a partition
    crossing = walked.filter("kind = 1").join(F.broadcast(firsts.select("part", F.col("parent").alias("p"), F.col("id").alias("n"))), "part", "left")
    siblings = walked.filter("kind = 0").select("id", "next").union(crossing.select("id", F.when(F.col("p") == F.col("parent"), F.col("n"))))
    children = tree.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.min("id").alias("first_child")).withColumnRenamed("parent", "id")
    arcs = tree.join(siblings, "id", "left").join(children, "id", "left").withColumns({"n_children": F.coalesce("n_children", zero), "part": F.pmod(F.shiftright("id", 33), F.lit(parts)).cast("int")})
    sums = lambda side: ", ".join(f"{side}_{w} long" for w in _WEIGHTS)
    ddl = f"kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ka long, kb long, enter long, {sums('enter')}, exit long, {sums('exit')}, next long"
    toured = stage(arcs.repartitionById(parts, F.col("part")).mapInArrow(_contract, ddl), "tour")
    segments = toured.filter("kind = 1").select(F.col("enter").alias("segment"), "next", *[F.col(f"enter_{w}").alias(w) for w in _WEIGHTS])
    ranks = stage(rank_segments(segments, few), "ranks")

    out = toured.filter("kind = 0").drop("kind", "next")
    for side in ("enter", "exit"):
        out = out.join(ranks.select(F.col("segment").alias(side), *[F.col(w).alias(f"{side}_base_{w}") for w in _WEIGHTS]), side)
    at = lambda side, w: F.col(f"{side}_{w}") + F.col(f"{side}_base_{w}")
    out = out.join(_ends(paths.filter("last")), ["ka", "kb", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (at("exit", "leaves") - at("enter", "leaves")).alias("n_leaves"), (at("exit", "saved") - at("enter", "saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), at("enter", "pos").alias("enter"), at("exit", "pos").alias("exit"),
    )
