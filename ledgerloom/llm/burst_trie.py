"""Prefix tries of conversations by bursting containers.

Method: a conversation is a sequence of turn ids (digests of role and text). The ids along a sequence chain
into node ids, so that a node is known by one id. Equal sequences become one, with its number of members
and the least of them. A container holds the suffixes below a node; one whose suffixes have more than BURST
turns bursts by the next turn id, its node becomes a trie head, and a container begins below each next turn.
As a container's size is a count of the turns below its node, all bursts of all depths come from one
aggregation over nodes, without rounds. Each container that remains is sorted and swept once, which gives
its nodes with their subtree sums; a shard (task) sweeps many. The sums of heads, of which there are few,
are those of the containers below them, added up along the paths of heads: each head and its containers
count on one path, from whose end the sums run to the root.

Bounds: a container has at most BURST turns, or is one sequence. The members that end at one node may be a
third of all: their ids go by ranges into joined pieces of PIECE ids, and only the pieces, in order, meet in
one task, which streams them through one hash, as SHA-256 over one list cannot be split. One conversation's
turns (16 bytes of digest each; texts never move) must fit in a task. Steps are cut by checkpoints.

Defined results: rows without conv_id belong to no conversation and are left out; null role or text is
empty. Of equal turn numbers (null first), order is by role, then the first TIE characters of the text, then
the digest; repeated rows are turns of their own. An empty table has no nodes, not even a root. Other
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: Turns of suffixes beyond which a container bursts.
BURST = 16_384
PIECE = 4096
TIE = 32
#: The blocks of conversations that share first turns in ``rebuild``, and how many turns at most.
BLOCK, SHARED = 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
ID = 16
ROOT = bytes(ID)
_ROOT = "unhex(repeat('00', 16))"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, block (of BLOCK ids) and turns, the ordered array of (id, size); dealt by block."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * ID)))
    rows = conversations.where("conv_id IS NOT NULL").select((F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block"), F.col("conv_id").cast("long"), F.struct(F.col("turn"), role.alias("role"), F.left(text, F.lit(TIE)).alias("head"), digest.alias("id"), F.length(text).alias("size")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size")))
    return rows.repartition("block").groupBy("block", "conv_id").agg(ordered.alias("turns"))


def rebuild(own: DataFrame) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % BLOCK (all if fewer, none if absent), h = crc32(decimal c) % SHARED, and goes on with its own after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    first = F.when(F.col("conv_id") == F.col("block"), F.slice("turns", 1, SHARED - 1))
    shared = F.coalesce(F.max(first).over(Window.partitionBy("block")), F.array().cast("array<struct<id: binary, size: int>>"))
    return own.withColumns({"h": h, "shared": shared}).select("conv_id", F.concat(F.slice("shared", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _chained(own: DataFrame) -> DataFrame:
    """conv_id, path (the node ids of a sequence, from its first turn on, joined) and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            paths = []
            for ids in batch.column("ids").to_pylist():
                node, path = ROOT, []
                for turn in ids:
                    node = hashlib.blake2b(node + turn, digest_size=ID).digest()
                    path.append(node)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), batch.column("sizes")], ["conv_id", "path", "sizes"])

    return own.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes")).mapInArrow(run, "conv_id long, path binary, sizes array<int>")


def _id(depth: str) -> str:
    """SQL for the id of a path's node at a depth."""
    return f"CASE WHEN {depth} <= 0 THEN {_ROOT} ELSE substring(path, {ID} * (CAST({depth} AS INT) - 1) + 1, {ID}) END"


def _node(depth: str) -> Column:
    return F.expr(_id(depth))


def ends_hashes(members: DataFrame) -> DataFrame:
    """node and the SHA-256 of its members' ids (node, conv_id), ascending, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["node", "first", "ids"])

        for batch in batches:
            for n, i in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (n != node or len(ids) == PIECE):
                    yield piece()
                    ids = []
                node = n
                ids.append(i)
        if ids:
            yield piece()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            yield _two(done)
        if node is not None:
            yield _two([(node, state.hexdigest())])

    def _two(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], ["node", "ends"])

    joined = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node binary, ends string")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted containers to nodes. Nodes come into being along each next path; sums run back from the last to the first."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "head"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
    nodes: list[list] = []  # conv_id, depth, parent (place), n_convs, n_children, n_leaves, saved_tokens, ends, size
    stack: list[int] = []
    container = top = before = None

    def swept() -> pa.RecordBatch:
        for at in range(len(nodes) - 1, -1, -1):
            node = nodes[at]
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[8]
            if node[2] >= 0:
                up = nodes[node[2]]
                up[0] = node[0] if up[0] is None or node[0] < up[0] else up[0]
                for k, more in ((3, node[3]), (4, 1), (5, node[5]), (6, node[6])):
                    up[k] += more
        columns = [[n[k] for n in nodes] for k in range(8)]
        columns[2] = [top[1] if p < 0 else nodes[p][0] for p in columns[2]]
        head = [top[0], *[None] * (len(nodes) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, head], kinds, strict=True)], names)

    for batch in slices(batches):
        columns = [batch.column(n).to_pylist() for n in ("container", "path", "sizes", "n", "conv_id", "ends", "depth", "head", "head_conv_id")]
        for key, path, sizes, n, conv, ends, start, head, head_conv in zip(*columns, strict=True):
            if key != container:
                if nodes:
                    yield swept()
                nodes, stack, container, top, before = [], [], key, (head, head_conv), b""
                same = start - 1
            else:
                low, high = start, min(len(before), len(path)) // ID
                while low < high:  # the deepest common node
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if before[ID * (mid - 1) : ID * mid] == path[ID * (mid - 1) : ID * mid] else (low, mid - 1)
                same = low
            del stack[same - start + 1 :]
            for depth in range(same + 1, len(path) // ID + 1):
                nodes.append([None, depth, stack[-1] if stack else -1, 0, 0, 0, 0, NO_ENDS, sizes[depth - 1] if depth else 0])
                stack.append(len(nodes) - 1)
            own = nodes[stack[-1]]
            own[0] = conv if own[0] is None else min(own[0], conv)
            own[3] += n
            own[7] = ends
            before = path
    if nodes:
        yield swept()


def trie(own: DataFrame, burst: int = BURST) -> DataFrame:
    """The nodes of the trie over own (conv_id, unique, and turns): NODES."""
    members = cut(_chained(own))
    depth = F.expr(f"CAST(octet_length(path) DIV {ID} AS INT)")
    ends = ends_hashes(members.withColumn("depth", depth).select(_node("depth").alias("node"), "conv_id"))
    distinct = members.groupBy("path", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).withColumn("length", depth).withColumn("node", _node("length"))
    seqs = cut(distinct.join(ends, "node"))

    # Which containers burst: all nodes, with the turns below them.
    each = F.expr(f"transform(sequence(0, length), d -> struct({_id('d')} AS node, {_id('(d - 1)')} AS parent, d AS depth, coalesce(get(sizes, d - 1), 0) AS size, CAST(length - d AS LONG) AS below))")
    walked = seqs.select("n", "conv_id", F.explode(each).alias("x")).groupBy("x.node", "x.parent", "x.depth", "x.size").agg(F.sum("x.below").alias("below"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
    heads = cut(walked.where(F.col("below") > burst))

    # Where each sequence leaves the heads. All that burst at all begin at the root, which needs no join.
    root = heads.where("depth = 0").agg(F.max("conv_id").alias("root_conv_id"))
    deeper = F.expr(f"transform(sequence(1, greatest(length, 1)), d -> struct(d, {_id('d')} AS node))")
    steps = seqs.where("length > 0").select(F.col("node").alias("key"), F.explode(deeper).alias("x")).select("key", "x.d", "x.node")
    deepest = steps.join(heads.where("depth > 0").select("node", F.col("conv_id").alias("head_conv_id")), "node").groupBy("key").agg(F.max(F.struct("d", "node", "head_conv_id")).alias("top"))
    placed = seqs.join(deepest.withColumnRenamed("key", "node"), "node", "left").join(F.broadcast(root))
    rooted = F.col("root_conv_id").isNotNull()
    placed = cut(
        placed.select(
            "path", "sizes", "n", "conv_id", "ends", "length", "node",
            F.coalesce(F.col("top.d") + 1, rooted.cast("int")).alias("depth"),
            F.coalesce("top.node", F.when(rooted, F.expr(_ROOT))).alias("head"),
            F.coalesce("top.head_conv_id", "root_conv_id").alias("head_conv_id"),
        )
    )

    containers = placed.where("length >= depth").withColumn("container", _node("depth"))
    swept = cut(containers.repartition("container").sortWithinPartitions("container", "path").mapInArrow(_sweep, f"{NODES}, head binary"))
    return swept.drop("head").union(_head_rows(heads, placed, swept))


def _head_rows(heads: DataFrame, placed: DataFrame, swept: DataFrame) -> DataFrame:
    """The heads as nodes. Sums below a head come from the containers under it and the heads below."""
    below = swept.where("head IS NOT NULL").groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = heads.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("heads"))
    own = heads.join(below, "node", "left").join(inner, "node", "left").select(
        *heads.columns, (F.coalesce("children", F.lit(0)) + F.coalesce("heads", F.lit(0))).alias("n_children"), F.coalesce("leaves", F.lit(0)).alias("leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("size")).alias("saved"),
    )
    # Paths of heads end at those that have no head below. Each head belongs to the least path through it.
    lowest = heads.select("node").join(inner.select("node"), "node", "left_anti")
    ways = placed.join(lowest.withColumnRenamed("node", "head"), "head", "left_semi").select(F.col("head").alias("way"), F.expr(f"substring(path, 1, {ID} * (depth - 1))").alias("path")).distinct()
    steps = ways.select("way", F.explode(F.expr(f"transform(sequence(0, octet_length(path) DIV {ID}), d -> struct(d, {_id('d')} AS node))")).alias("x")).select("way", "x.d", "x.node")
    owner = steps.groupBy("node").agg(F.min("way").alias("way"))
    values = own.select("node", "leaves", "saved").join(owner, "node")
    down = Window.partitionBy("way").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.join(values, ["node", "way"], "left").select("node", F.sum(F.coalesce("leaves", F.lit(0))).over(down).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).over(down).alias("saved"))
    sums = run.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    up = heads.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ended = placed.where("length < depth").select("node", F.col("ends"))
    out = own.join(sums, "node").join(up, "parent", "left").join(ended, "node", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def shared_prefixes(conversations: DataFrame, burst: int = BURST) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuild(sequences(conversations)), burst)
