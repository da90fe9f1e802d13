"""Prefix trie of conversations (12), with subtree sums by centroid decomposition of the parent-edge forest.

A conversation's turns are numbered and become pairs of hashes of role and text; the key of a prefix is the running
exclusive-or of the hashes of (place, turn), 128 bits, so a conversation of any length is keyed range by range. A node is
a group of equal keys. Nobody collects the members of a node: counts, least members and last texts' bytes are sums.

Subtree sums: a component is a connected part of the forest of parent edges. In each component of more than PIECE nodes the
centroid is the deepest node with over half of the component below it. The total of what is below it is added to every
node on the path from the centroid to the component's top; then the centroid goes, each of its children's subtrees becomes
a component, and what is left above it another one. Components halve at least each time. A path is read off a conversation
that goes through the centroid (its rows are its ancestors, and name the child that a node below it belongs to), so no
edge is followed step by step, however deep the trie is. Components of at most PIECE nodes are decomposed in the same way
within one task each, many at once. Each node's sum is what was added to it.

Digests of the members that end in a node: members are sorted by range, strung together piece by piece, and a node's
pieces go through the digest one after the other.

Defined cases: rows without conv_id are of no conversation and left out; null roles and texts are empty; a null turn comes
first; turns that are equal in number are ordered by hashes of role and text, so that repeated rows are turns of their own
and the order doesn't depend on the table's; without conversations there are no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanpura.llm.common import Rows, small_batches, small_side, stored
from tanpura.operators import ranges

#: Conversations of a family and heads of its first one: conversation c starts with the first crc32(c) % HEADS turns of c - c % FAMILY.
FAMILY, HEADS = 5, 9
#: Nodes of a component that is decomposed within a task.
PIECE = 256
#: Bytes of joined members that a task hands on at once.
JOINED_BYTES = 1 << 20
#: Nodes that a task decomposes at once, about.
CHUNK = 4096


def numbered_turns(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, pos (from 1), a and b (hashes of role and text) and bytes (of the text), written."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = [F.col("turn").asc_nulls_first(), "a", "b"]
    return stored(ranges.running(rows, "conv_id", "turn", order, {"pos": ranges.numbering()}, most).select("conv_id", "pos", "a", "b", "bytes"), "trie-turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with the head of its family's first one: conv_id, depth, a, b, bytes, length (of the whole)."""
    own = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-lengths")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    firsts = own.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    known = own.select("conv_id", "n", family.alias("base"), head.alias("h")).join(firsts, "base", "left")
    known = known.withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0).cast("long"))))
    known = stored(known.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("length")), "trie-conversations")
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base").join(known, "base").where("pos <= taken")
    tails = turns.join(known, "conv_id").where("pos > h")
    pick = lambda rows, depth: rows.select("conv_id", depth.alias("depth"), "a", "b", "bytes", "length")
    none = F.lit(None).cast("long")
    roots = known.select("conv_id", F.lit(0).cast("long").alias("depth"), none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("bytes"), "length")
    return pick(heads, F.col("pos")).union(pick(tails, F.col("pos") - F.col("h") + F.col("taken"))).union(roots)


def running_xor(value: Column) -> tuple:
    zero = F.lit(0).cast("long")
    fold = lambda v, w: F.coalesce(F.bit_xor(v).over(w), zero)
    return lambda w: fold(value, w), F.bit_xor(value), fold, lambda before, here: here.bitwiseXOR(F.coalesce(before, zero))


def paths(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Each rebuilt conversation's nodes from the root down: conv_id, depth, node (16 bytes), parent, bytes, length. Written."""
    placed = rows.withColumns({"a": F.when(F.col("depth") > 0, F.xxhash64("depth", "a")), "b": F.when(F.col("depth") > 0, F.xxhash64("b", "depth"))})
    keyed = ranges.running(placed, "conv_id", "depth", ["depth"], {"ka": running_xor(F.col("a")), "kb": running_xor(F.col("b"))}, most)
    key = lambda a, b: F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    parent = F.when(F.col("depth") > 0, key(F.col("ka").bitwiseXOR(F.col("a")), F.col("kb").bitwiseXOR(F.col("b"))))
    return stored(keyed.select("conv_id", "depth", key(F.col("ka"), F.col("kb")).alias("node"), parent.alias("parent"), "bytes", "length"), "trie-paths")


def nodes_of(made: DataFrame) -> DataFrame:
    """node, depth, parent, conv_id (least member), n_convs, n_children, leaf, saved (of the node alone). Written."""
    nodes = stored(made.groupBy("node", "depth").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes")), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaf = (F.col("n_children") == 0).cast("long")
    return stored(whole.select("node", "depth", "parent", "conv_id", "n_convs", "n_children", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie-nodes")


def decomposed(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of a forest of small components: parent has -1 for tops, depth counts from the top, values has a row for each node."""
    up, alive, sums = parent.copy(), np.ones(len(parent), bool), np.zeros_like(values)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    while alive.any():
        size, total, top = alive.astype(np.int64), np.where(alive[:, None], values, 0), np.arange(len(up))
        for level in reversed(levels):
            below = level[up[level] >= 0]
            np.add.at(size, up[below], size[below])
            np.add.at(total, up[below], total[below])
        for level in levels:
            below = level[up[level] >= 0]
            top[below] = top[up[below]]
        heavy = order[(alive & (2 * size > size[top]))[order]]  # one chain in each component, its deepest node last
        centroid = np.full(len(up), -1)
        centroid[top[heavy]] = heavy
        centroid = centroid[centroid >= 0]
        now, below = centroid, total[centroid]
        while len(now):  # from the centroids to the tops
            sums[now] += below
            higher = up[now] >= 0
            now, below = up[now][higher], below[higher]
        gone = np.zeros(len(up), bool)
        gone[centroid] = True
        up[(up >= 0) & gone[up]] = -1
        up[centroid], alive[centroid] = -1, False
    return sums


def within_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, comp_depth, node, parent, depth, leaf, saved) sorted by comp to (node, leaves, saved) of whole components."""
    names, held = ("comp", "node", "parent", "depth", "leaf", "saved"), []

    def make(rows: list[tuple]) -> pa.RecordBatch:
        place = {(r[0], r[1]): i for i, r in enumerate(rows)}
        parent = np.array([place.get((r[0], r[2]), -1) for r in rows])
        sums = decomposed(parent, np.array([r[3] for r in rows]), np.array([r[4:] for r in rows], np.int64))
        return pa.record_batch([pa.array([r[1] for r in rows], pa.binary()), *(pa.array(sums[:, i]) for i in range(2))], names=["node", "leaves", "saved"])

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        if len(held) >= CHUNK:
            last = next(i for i in range(len(held) - 1, -2, -1) if i < 0 or held[i][0] != held[-1][0]) + 1
            if last:
                yield make(held[:last])
                held = held[last:]
    if held:
        yield make(held)


def subtree_sums(nodes: DataFrame, made: DataFrame, piece: int = PIECE) -> DataFrame:
    """node, n_leaves and saved_tokens of the whole subtree of each node."""
    # Below a node on the path of the conversation that owns it: the owner's own nodes, each conversation's last ones.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"))
    below = F.greatest(F.lit(0).cast("long"), F.col("length") - F.greatest("depth", "from") + 1)
    sizes = made.join(owned, "conv_id").groupBy("node").agg(F.sum(below).alias("size"))
    live = nodes.join(sizes, "node").select("node", "parent", "depth", "conv_id", "leaf", "saved", "size", F.unhex(F.lit("0" * 32)).alias("comp"), F.lit(0).cast("long").alias("comp_depth"))
    live, local, added = stored(live, "trie-live"), [], []
    line = made.select(F.col("conv_id").alias("through"), F.col("depth").alias("at"), "node")
    while True:
        large = stored(live.groupBy("comp").agg(F.count("*").alias("many")).where(F.col("many") > piece), "trie-large")
        if large.isEmpty():
            local.append(live)
            break
        sized = live.join(small_side(large), "comp", "left")
        local.append(sized.where("many is null").drop("many"))
        big = sized.where("many is not null")
        deepest = F.max_by(F.struct("node", "conv_id", "depth", "comp_depth", "size"), "depth")
        centroids = big.where("2 * size > many").groupBy("comp").agg(deepest.alias("c"))
        centroids = stored(centroids.select("comp", F.col("c.node").alias("c_node"), F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.comp_depth").alias("c_top"), F.col("c.size").alias("c_size")), "trie-centroids")
        held = big.drop("many").join(small_side(centroids.select("comp", "c_node", "c_depth")), "comp")
        # The node at the centroid's depth on the way to a node, and the one after it.
        at = line.select(F.col("through").alias("conv_id"), F.col("at").alias("c_depth"), F.col("node").alias("way"))
        after = line.select(F.col("through").alias("conv_id"), (F.col("at") - 1).alias("c_depth"), F.col("node").alias("child"))
        deep = held.where("depth > c_depth").join(at, ["conv_id", "c_depth"]).join(after, ["conv_id", "c_depth"]).withColumn("under", F.col("way") == F.col("c_node")).drop("way")
        high = held.where("depth <= c_depth").withColumn("child", F.lit(None).cast("binary")).withColumn("under", F.col("node") == F.col("c_node"))
        marked = stored(deep.unionByName(high), "trie-marked")
        totals = marked.where("under").groupBy("comp").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
        totals = stored(centroids.join(totals, "comp"), "trie-totals")
        way = line.join(small_side(totals), (F.col("through") == F.col("c_conv")) & F.col("at").between(F.col("c_top"), F.col("c_depth")))
        way = stored(way.select("node", "leaves", F.col("saved").alias("saved_below"), "c_size"), "trie-ways")
        added.append(way.select("node", "leaves", F.col("saved_below").alias("saved")))
        rest = marked.where(F.col("node") != F.col("c_node")).join(way.select("node", "c_size"), "node", "left")
        live = rest.select(
            "node", "parent", "depth", "conv_id", "leaf", "saved",
            (F.col("size") - F.when(F.col("under"), 0).otherwise(F.coalesce("c_size", F.lit(0)))).alias("size"),
            F.when(F.col("under"), F.col("child")).otherwise(F.col("comp")).alias("comp"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("comp_depth")).alias("comp_depth"),
        )
        live = stored(live, "trie-live")
    small = local[0]
    for more in local[1:]:
        small = small.unionByName(more)
    small = small.select("comp", "node", "parent", (F.col("depth") - F.col("comp_depth")).alias("depth"), "leaf", "saved")
    sums = small.repartition("comp").sortWithinPartitions("comp").mapInArrow(within_tasks, "node binary, leaves bigint, saved bigint")
    for more in added:
        sums = sums.union(more)
    return sums.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


JOINED = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("members", pa.string())])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, conv_id) in order to pieces (node, first, members joined by commas)."""
    out, now, ids, held = Rows(JOINED), None, [], 0
    for batch in batches:
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if node != now or held > JOINED_BYTES:
                if ids:
                    yield from out.add((now, ids[0], ",".join(map(str, ids))), held)
                now, ids, held = node, [], 0
            ids.append(conv)
            held += len(str(conv)) + 1
    if ids:
        yield from out.add((now, ids[0], ",".join(map(str, ids))), held)
    yield from out.flush()


DIGEST = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (node, ends_sha256)."""
    out, now, digest = Rows(DIGEST), None, None
    for batch in batches:
        for node, members in zip(batch.column("node").to_pylist(), batch.column("members").to_pylist(), strict=True):
            if node == now:
                digest.update(b",")
            else:
                if digest:
                    yield from out.add((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256()
            digest.update(members.encode())
    if digest:
        yield from out.add((now, digest.hexdigest()))
    yield from out.flush()


def end_digests(made: DataFrame) -> DataFrame:
    """node and ends_sha256 of the nodes in which conversations end."""
    ends = made.where("depth = length").select("node", "conv_id")
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first bigint, members string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digested, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, piece: int = PIECE, most: int | None = None) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    made = paths(rebuilt(numbered_turns(conversations, most)), most)
    nodes = nodes_of(made)
    sums = stored(subtree_sums(nodes, made, piece), "trie-sums")
    ends = stored(end_digests(made), "trie-ends")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(small_side(above), "parent", "left").join(sums, "node").join(ends, "node", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
