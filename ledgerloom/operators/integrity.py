"""Log integrity: Merkle trees as in RFC 9162, roots, proofs, tampering. Hashes are lower-case hex.

A tree is a table of complete nodes (level, idx, hash); level 0 holds the leaves.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Levels folded in one group: 2^12 leaves.
CHUNK_BITS = 12
#: Paths above chunks that go to every executor, at most, of some 2 KB each; more are joined by chunk.
BROADCAST_PATHS = 1 << 15
#: Rows of a side that one task of a tamper scan meets, about.
SCAN_ROWS = 1 << 17
#: Columns of a tree.
NODES = "level int, idx long, hash string"
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def _pair_up(hashes: Column) -> Column:
    half = F.floor(F.size(hashes) / 2).cast("int")
    return F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), lambda i: node_hash(F.get(hashes, 2 * i), F.get(hashes, 2 * i + 1)))).otherwise(F.array().cast("array<string>"))


def _folded(layer: DataFrame, level: int, frontier: list[str | None]) -> DataFrame:
    """The complete nodes above a run of neighbouring nodes (idx, hash) of a level, CHUNK_BITS levels up: chunks of 4096 are folded by one group each. Where a run begins within a pair, the left half is the frontier's node of that level."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    chunks = layer.groupBy(F.shiftright("idx", CHUNK_BITS).alias("chunk")).agg(ordered.alias("run")).select("chunk", F.get("run", F.lit(0))["idx"].alias("first"), F.transform("run", lambda x: x["hash"]).alias("hashes"))
    left = F.array(*(F.lit(h).cast("string") for h in (frontier + [None] * (level + CHUNK_BITS))[level : level + CHUNK_BITS]))
    none = F.array().cast("array<struct<level:int,idx:bigint,hash:string>>")
    start = F.struct(F.col("hashes").alias("cur"), F.col("first").alias("first"), none.alias("done"))

    def step(state: Column, at: Column) -> Column:
        odd = (F.size(state["cur"]) > 0) & (state["first"].bitwiseAND(F.lit(1).cast("long")) == 1)
        whole = F.when(odd, F.concat(F.array(F.get(left, at - 1)), state["cur"])).otherwise(state["cur"])
        up = F.shiftright(state["first"], 1)
        one = lambda cur: F.struct(cur.alias("cur"), up.alias("first"), F.concat(state["done"], F.transform(cur, lambda h, i: F.struct((at + level).alias("level"), (up + i).alias("idx"), h.alias("hash")))).alias("done"))
        return F.get(F.transform(F.array(_pair_up(whole)), one), F.lit(0))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(CHUNK_BITS)), start, step, lambda s: s["done"])
    return chunks.select(F.explode(done).alias("node")).select("node.*")


def merkle_build(leaves: DataFrame) -> DataFrame:
    """All complete nodes over leaves (log_index from 0 without gaps, event_hash), layer by layer. ``append_leaves`` is for trees that are stored."""
    layer = leaves.select(F.col("log_index").alias("idx"), F.col("event_hash").alias("hash"))
    n, level = layer.count(), 0
    out = layer.select(F.lit(0).alias("level"), "idx", "hash")
    while n > 1:
        nodes = _folded(layer, level, [])
        out = out.union(nodes)
        level += CHUNK_BITS
        n >>= CHUNK_BITS
        layer = nodes.where(F.col("level") == level).select("idx", "hash")
    return out


# --- a tree that is stored and grows


def _states(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/states")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    done = [n for n in names if n.startswith("size=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/states/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("size=")) for n in done)


def stored_tree(spark: SparkSession, path: str) -> tuple[int, list[str | None], list[str]]:
    """Size of the stored tree, the hash of its complete subtree of each level (or None), and the folders of its nodes."""
    sizes = _states(spark, path)
    if not sizes:
        return 0, [], []
    row = spark.read.parquet(f"{path}/states/size={sizes[-1]}").first()
    return sizes[-1], row.frontier, row.parts


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of the stored tree."""
    _, _, parts = stored_tree(spark, path)
    return spark.read.schema(NODES).parquet(*(f"{path}/{p}" for p in parts)) if parts else spark.createDataFrame([], NODES)


def append_leaves(spark: SparkSession, leaves: DataFrame, path: str) -> int:
    """Adds leaves (log_index from the tree's size on, without gaps; event_hash) to the tree at path; returns its new size.

    The tree's state is its frontier: at most 63 complete subtrees. Only nodes that the new leaves
    complete are made and written, about twice as many as leaves, each layer of CHUNK_BITS levels once, as
    the next is folded from the nodes that are stored. The state is written last: a run that dies before
    leaves the tree as it was, and of its folder nothing is read.
    """
    size, frontier, parts = stored_tree(spark, path)
    rows = leaves.select(F.col("log_index").cast("long").alias("idx"), F.col("event_hash").alias("hash"))
    m, least, most, total = rows.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx"), F.sum(F.col("idx").cast("decimal(38,0)"))).first()
    if m == 0:
        return size
    if (least, most) != (size, size + m - 1) or 2 * int(total) != m * (least + most):
        raise ValueError(f"leaves {least} to {most} ({m} rows) do not follow a tree of {size}")
    new, level, here = size + m, 0, f"nodes-{uuid.uuid4().hex}"
    rows.select(F.lit(0).alias("level"), "idx", "hash").write.parquet(f"{path}/{here}/level=0")
    written = [f"{here}/level=0"]
    while (new >> level) > 1:
        layer = spark.read.schema(NODES).parquet(f"{path}/{written[-1]}").where(F.col("level") == level).select("idx", "hash")
        level += CHUNK_BITS
        written.append(f"{here}/level={level}")
        _folded(layer, level - CHUNK_BITS, frontier).write.parquet(f"{path}/{written[-1]}")
    ends = spark.createDataFrame([(k, (new >> k) - 1) for k in range(new.bit_length()) if new >> k & 1], "level int, idx long")
    fresh = spark.read.schema(NODES).parquet(*(f"{path}/{w}" for w in written)).join(F.broadcast(ends), ["level", "idx"]).collect()  # at most 63
    found = {r.level: r.hash for r in fresh}
    after = [(found.get(k) or frontier[k]) if new >> k & 1 else None for k in range(new.bit_length())]
    spark.createDataFrame([(new, after, parts + written)], "size long, frontier array<string>, parts array<string>").coalesce(1).write.parquet(f"{path}/states/size={new}")
    return new


def stored_root(spark: SparkSession, path: str) -> str:
    """The root of the stored tree, from its frontier alone."""
    _, frontier, _ = stored_tree(spark, path)
    root = None
    for h in (h for h in frontier if h):
        root = h if root is None else hashlib.sha256(b"\x01" + bytes.fromhex(h) + bytes.fromhex(root)).hexdigest()
    return root or EMPTY_ROOT


def stored_index(level: Column, idx: Column) -> Column:
    """Dense position of a complete node when nodes are stored in the order in which they become complete: after leaf m come all nodes that end at it."""
    last = (idx + 1) * F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
    before = 2 * last - F.bit_count(last)
    return before + level


def _set_bits(size: Column) -> Column:
    """(level, idx) of the complete subtrees that make up a tree of this size, lowest level first."""
    levels = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", size, k).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.transform(levels, lambda k: F.struct(k.alias("level"), (F.call_function("shiftright", size, k) - 1).alias("idx")))


def _fold(hashes: Column) -> Column:
    """Hashes of subtrees, lowest level first, folded right to left."""
    return F.aggregate(F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))), F.get(hashes, F.lit(0)), lambda acc, x: node_hash(x, acc))


def _ordered_hashes(by: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(by, "hash"))), lambda x: x["hash"])


def root_at_size(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """tree_size, root for each of the sizes; the empty tree has the hash of nothing."""
    distinct = sizes.select(F.col("tree_size").cast("long").alias("tree_size")).distinct()
    parts = distinct.select("tree_size", F.explode(_set_bits(F.col("tree_size"))).alias("p")).select("tree_size", "p.level", "p.idx")
    roots = parts.join(nodes, ["level", "idx"]).groupBy("tree_size").agg(_fold(_ordered_hashes("level")).alias("root"))
    return distinct.join(roots, "tree_size", "left").select("tree_size", F.when(F.col("tree_size") == 0, F.lit(EMPTY_ROOT)).otherwise(F.col("root")).alias("root"))


def checkpoint_rows(roots: DataFrame, origin: str) -> DataFrame:
    return roots.select("tree_size", "root", F.concat(F.lit(origin + "\n"), "tree_size", F.lit("\n"), "root", F.lit("\n")).alias("checkpoint_text"))


def _band_paths(nodes: DataFrame, wanted: DataFrame, band: int) -> DataFrame:
    """at, tree_size and path: the siblings of the levels of one band, for nodes ``at`` of the band's lowest level. A node is asked for by 2^(CHUNK_BITS - 1) others at most."""
    low = band * CHUNK_BITS
    m, n, k = F.col("at"), F.col("tree_size"), F.col("level")
    levels = wanted.select("at", "tree_size", F.explode(F.sequence(F.lit(low), F.lit(min(low + CHUNK_BITS, 63) - 1))).alias("level")).where(F.expr("shiftright(tree_size - 1, level) > 0"))
    own, last = F.call_function("shiftright", m, k - low), F.call_function("shiftright", n - 1, k)
    odd = own.bitwiseAND(F.lit(1).cast("long")) == 1
    needed = levels.withColumns({"own": own, "last": last, "odd": odd}).where("odd OR own < last")
    placed = needed.withColumn("idx", F.when(F.col("odd"), F.col("own") - 1).otherwise(F.col("own") + 1)).withColumn("complete", F.expr("shiftleft(idx + 1, level) <= tree_size"))
    within = nodes.where((k >= low) & (k < low + CHUNK_BITS))
    whole = placed.where("complete").join(within, ["level", "idx"]).select("at", "tree_size", "level", "hash")
    # Right siblings that are not complete: of a size's subtrees, those below a level make up the ragged node of that level.
    ragged = placed.where("NOT complete").select("at", "tree_size", "level")
    parts = ragged.select("tree_size", "level").distinct().select("tree_size", F.col("level").alias("below"), F.explode(_set_bits(n)).alias("p")).where("p.level < below").select("tree_size", "below", "p.level", "p.idx")
    frontier = parts.join(nodes, ["level", "idx"]).groupBy("tree_size", F.col("below").alias("level")).agg(_fold(_ordered_hashes("level")).alias("hash"))
    edges = ragged.join(frontier, ["tree_size", "level"]).select("at", "tree_size", "level", "hash")
    # A row of its own keeps nodes without siblings.
    every = whole.union(edges).union(wanted.select("at", "tree_size", F.lit(-1), F.lit(None).cast("string")))
    return every.groupBy("at", "tree_size").agg(F.array_compact(_ordered_hashes("level")).alias("path"))


def _chunk_rows(nodes: DataFrame) -> DataFrame:
    """chunk and hashes: the complete nodes of the lowest CHUNK_BITS levels over each chunk of 2^CHUNK_BITS leaves, as bytes, in the order in which they become complete."""
    low = nodes.where(F.col("level") < CHUNK_BITS)
    chunk = F.call_function("shiftright", F.col("idx"), CHUNK_BITS - F.col("level"))
    within = F.col("idx") - F.call_function("shiftleft", chunk, CHUNK_BITS - F.col("level"))
    placed = low.select(chunk.alias("_chunk"), F.struct(stored_index(F.col("level"), within).cast("int").alias("at"), F.unhex("hash").alias("hash")).alias("node"))
    return placed.groupBy("_chunk").agg(F.transform(F.array_sort(F.collect_list("node")), lambda x: x["hash"]).alias("_hashes"))


def _low_path(hashes: Column, m: Column, n: Column) -> Column:
    """The siblings of leaf m's lowest CHUNK_BITS levels in a tree of n leaves, from the nodes of its chunk."""
    one, bits = F.lit(1).cast("long"), (1 << CHUNK_BITS) - 1
    right = lambda x, k: F.call_function("shiftright", x, k)
    at = lambda k, idx: F.get(hashes, stored_index(k, idx.bitwiseAND(right(F.lit(bits).cast("long"), k))).cast("int"))

    def ragged(k: Column) -> Column:
        """The node of level k at the right edge: the complete subtrees of n below it, which lie in this chunk."""
        digits = F.filter(F.sequence(F.lit(0), k - 1), lambda j: right(n, j).bitwiseAND(one) == 1)
        parts = F.transform(digits, lambda j: at(j, right(n, j) - 1))
        fold = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda acc, x: F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), x, acc), 256)))
        return F.when(k > 0, fold)

    def sibling(k: Column) -> Column:
        own = right(m, k)
        other = own.bitwiseXOR(one)
        whole = F.call_function("shiftleft", other + 1, k) <= n
        wanted = (right(n - 1, k) > 0) & ((own > other) | (own < right(n - 1, k)))
        return F.when(wanted & whole, at(k, other)).when(wanted, ragged(k))

    found = F.transform(F.sequence(F.lit(0), F.lit(CHUNK_BITS - 1)), sibling)
    return F.transform(F.array_compact(found), lambda x: F.lower(F.hex(x)))


def inclusion_proofs(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (log_index, tree_size and any more columns) with its audit path ``proof``.

    The lowest CHUNK_BITS levels of a path come from one row that holds the nodes of the leaf's chunk, so that
    no row is made for each level of a proof, and proofs go through no shuffle while the paths above are few.
    What is above is made in bands of CHUNK_BITS levels, from the top band down: all leaves below one node
    share it, so a band has one path for each of its lowest nodes, and joins the path of the node above. So
    no key of these joins stands for more than 2^CHUNK_BITS rows of a tree size.
    """
    most = wanted.agg(F.max("tree_size")).first()[0] or 1
    paths = lambda band: _band_paths(nodes, wanted.select(F.shiftright("log_index", band * CHUNK_BITS).alias("at"), "tree_size").distinct(), band)
    above = None
    for band in reversed(range(1, -(-(most - 1).bit_length() // CHUNK_BITS))):
        here = paths(band)
        if above is not None:
            upper = above.select(F.col("at").alias("up"), "tree_size", F.col("path").alias("rest"))
            here = here.withColumn("up", F.shiftright("at", CHUNK_BITS)).join(upper, ["up", "tree_size"]).select("at", "tree_size", F.concat("path", "rest").alias("path"))
        above = here
    # Rows of one chunk and size meet its nodes as one list, so that these are not copied for every row.
    lists = wanted.withColumn("_chunk", F.shiftright(F.col("log_index").cast("long"), CHUNK_BITS)).repartition("_chunk").groupBy("_chunk", "tree_size").agg(F.collect_list(F.struct(*wanted.columns)).alias("_rows"))
    path = lambda r: F.coalesce(_low_path(F.col("_hashes"), r["log_index"].cast("long"), F.col("tree_size").cast("long")), F.array().cast("array<string>"))
    met = lists.join(_chunk_rows(nodes), "_chunk", "left").select("_chunk", F.explode(F.transform("_rows", lambda r: F.struct(r.alias("row"), path(r).alias("path")))).alias("_x"))
    low = met.select("_chunk", "_x.row.*", F.col("_x.path").alias("_path"))
    if above is None:
        return low.select(*wanted.columns, F.col("_path").alias("proof"))
    upper = above.select(F.col("at").alias("_chunk"), "tree_size", F.col("path").alias("_rest"))
    few = wanted.select(F.shiftright("log_index", CHUNK_BITS), "tree_size").distinct().count() <= BROADCAST_PATHS
    return low.join(F.broadcast(upper) if few else upper, ["_chunk", "tree_size"]).select(*wanted.columns, F.concat("_path", "_rest").alias("proof"))


def verify_inclusion(proofs: DataFrame) -> DataFrame:
    """Adds status to rows of event_hash, log_index, tree_size, proof, root: verified, or why not. No shuffle."""
    start = F.struct(F.col("event_hash").alias("r"), F.col("log_index").cast("long").alias("fn"), (F.col("tree_size").cast("long") - 1).alias("sn"), F.lit(False).alias("extra"))

    def step(s: Column, p: Column) -> Column:
        odd = s["fn"].bitwiseAND(F.lit(1).cast("long")) == 1
        left = odd | (s["fn"] == s["sn"])
        zeros = F.when(left & ~odd & (s["fn"] > 0), F.bit_count(s["fn"].bitwiseAND(-s["fn"]) - 1)).otherwise(F.lit(0))
        shift = (zeros + 1).cast("int")
        return F.struct(
            F.when(left, node_hash(p, s["r"])).otherwise(node_hash(s["r"], p)).alias("r"),
            F.call_function("shiftright", s["fn"], shift).alias("fn"),
            F.call_function("shiftright", s["sn"], shift).alias("sn"),
            (s["extra"] | (s["sn"] == 0)).alias("extra"),
        )

    done = F.aggregate(F.col("proof"), start, step)
    status = F.when(F.col("log_index") >= F.col("tree_size"), "index beyond size").when(F.col("_s.extra"), "extra hashes").when(F.col("_s.sn") > 0, "path too short").when(F.col("_s.r") == F.col("root"), "verified").otherwise("root differs")
    return proofs.withColumn("_s", done).withColumn("status", status).drop("_s")


def consistency(nodes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Whether the log at each checkpoint's size still has the root that was stored."""
    now = root_at_size(nodes, checkpoints).withColumnRenamed("root", "root_now")
    return checkpoints.join(now, "tree_size").select("tree_size", "root", F.col("root").eqNullSafe(F.col("root_now")).alias("consistent"))


def _consistency_parts(first: Column, second: Column) -> Column:
    """The ranges of leaves (lo, n) whose hashes prove that a tree of the second size begins with one of the first, in the proof's order."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), second.alias("n"), first.alias("m"), F.lit(True).alias("whole"), F.array().cast("array<struct<lo:bigint,n:bigint>>").alias("parts"))

    def step(s: Column, _: Column) -> Column:
        # The largest power of two below n.
        half = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.conv((s["n"] - 1).cast("string"), 10, 2)) - 1)
        right = s["m"] <= half
        part = F.when(right, F.struct((s["lo"] + half).alias("lo"), (s["n"] - half).alias("n"))).otherwise(F.struct(s["lo"].alias("lo"), half.alias("n")))
        on = F.struct(
            F.when(right, s["lo"]).otherwise(s["lo"] + half).alias("lo"), F.when(right, half).otherwise(s["n"] - half).alias("n"), F.when(right, s["m"]).otherwise(s["m"] - half).alias("m"), (s["whole"] & right).alias("whole"), F.concat(s["parts"], F.array(part)).alias("parts"),
        )
        return F.when(s["m"] == s["n"], s).otherwise(on)

    def finish(s: Column) -> Column:
        return F.reverse(F.when(s["whole"], s["parts"]).otherwise(F.concat(s["parts"], F.array(F.struct(s["lo"].alias("lo"), s["n"].alias("n"))))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step, finish)


def consistency_proofs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (first_size, second_size, with 0 < first_size <= second_size) with the proof that the smaller tree is a beginning of the larger: a list of hashes, empty for equal sizes."""
    wanted = pairs.select("first_size", "second_size").distinct()
    ranges = wanted.select("first_size", "second_size", F.posexplode(_consistency_parts(F.col("first_size").cast("long"), F.col("second_size").cast("long"))).alias("at", "r"))
    # A range is one complete subtree, or, at the right edge, several: by binary digit of its size, from the left.
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", F.col("r.n"), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    piece = F.transform(digits, lambda k: F.struct(k.alias("level"), (F.call_function("shiftright", F.col("r.lo") + F.col("r.n"), k) - 1).alias("idx")))
    pieces = ranges.select("first_size", "second_size", "at", F.explode(piece).alias("p")).select("first_size", "second_size", "at", "p.level", "p.idx")
    hashes = pieces.join(nodes, ["level", "idx"]).groupBy("first_size", "second_size", "at").agg(_fold(_ordered_hashes("level")).alias("hash"))
    proofs = hashes.groupBy("first_size", "second_size").agg(_ordered_hashes("at").alias("proof"))
    return pairs.join(proofs, ["first_size", "second_size"], "left").withColumn("proof", F.coalesce("proof", F.array().cast("array<string>")))


def verify_consistency(proofs: DataFrame) -> DataFrame:
    """Adds status to rows of first_size, second_size, first_root, second_root and proof: consistent, or why not. From roots and proof alone; no shuffle."""
    m, n = F.col("first_size").cast("long"), F.col("second_size").cast("long")
    one = F.lit(1).cast("long")
    # A first tree that is one complete subtree is its own first hash.
    power = m.bitwiseAND(m - 1) == 0
    path = F.when(power, F.concat(F.array("first_root"), F.col("proof"))).otherwise(F.col("proof"))
    ones = F.bit_count(m.bitwiseAND(-m) - 1).cast("int")  # digits 1 at the end of m - 1: those below the lowest 1 of m
    start = F.struct(F.get(path, F.lit(0)).alias("fr"), F.get(path, F.lit(0)).alias("sr"), F.call_function("shiftright", m - 1, ones).alias("fn"), F.call_function("shiftright", n - 1, ones).alias("sn"), F.lit(False).alias("extra"))

    def step(s: Column, c: Column) -> Column:
        odd = s["fn"].bitwiseAND(one) == 1
        left = odd | (s["fn"] == s["sn"])
        zeros = F.when(left & ~odd & (s["fn"] > 0), F.bit_count(s["fn"].bitwiseAND(-s["fn"]) - 1)).otherwise(F.lit(0))
        shift = (zeros + 1).cast("int")
        return F.struct(
            F.when(left, node_hash(c, s["fr"])).otherwise(s["fr"]).alias("fr"),
            F.when(left, node_hash(c, s["sr"])).otherwise(node_hash(s["sr"], c)).alias("sr"),
            F.call_function("shiftright", s["fn"], shift).alias("fn"),
            F.call_function("shiftright", s["sn"], shift).alias("sn"),
            (s["extra"] | (s["sn"] == 0)).alias("extra"),
        )

    done = F.aggregate(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), start, step)
    s = F.col("_s")
    proved = (
        F.when(F.size(path) == 0, "no proof").when(s["extra"], "extra hashes").when(s["sn"] > 0, "proof too short").when(~s["fr"].eqNullSafe(F.col("first_root")), "first root differs").when(~s["sr"].eqNullSafe(F.col("second_root")), "second root differs").otherwise("consistent")
    )
    same = F.when(F.size("proof") > 0, "extra hashes").when(F.col("first_root") == F.col("second_root"), "consistent").otherwise("second root differs")
    status = F.when((m < 1) | (m > n), "sizes out of order").when(m == n, same).otherwise(proved)
    return proofs.withColumn("_s", done).withColumn("status", status).drop("_s")


def tamper_scan(events: DataFrame, stored_leaves: DataFrame, width: int = 65_536) -> DataFrame:
    """Rows (log_index, problem): a leaf that differs from the stored one, a repeated index, a missing one. Both sides are dealt by index into as many tasks as keep each near SCAN_ROWS, so that a task's memory does not grow with the log."""
    rows, set_to = max(events.count(), stored_leaves.count()), int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(set_to, -(-rows // SCAN_ROWS))
    events, stored_leaves = events.repartition(tasks, "log_index"), stored_leaves.repartition(tasks, "idx")
    differs = events.join(stored_leaves.select(F.col("idx").alias("log_index"), F.col("hash").alias("stored")), "log_index", "left").where("stored IS NULL OR stored <> event_hash").select("log_index", F.lit("leaf differs").alias("problem"))
    repeated = events.groupBy("log_index").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("log_index", F.lit("duplicate").alias("problem"))
    missing = stored_leaves.select(F.col("idx").alias("log_index")).join(events, "log_index", "left_anti").select("log_index", F.lit("missing").alias("problem"))
    return differs.union(repeated).union(missing)


def index_gaps(events: DataFrame, width: int = 65_536) -> DataFrame:
    """Runs of missing log_index values as (after, before): within ranges of ``width`` indices, between neighbouring ranges, and between neighbouring groups of ``width`` ranges.

    Only the last step is one task: over a row for each ``width`` squared indices.
    """
    own = events.select("log_index", F.floor(F.col("log_index") / width).alias("part"))
    gaps = lambda rows, first: rows.where(F.col(first) - F.col("after") > 1).select("after", F.col(first).alias("before"))
    inside = own.withColumn("after", F.lag("log_index").over(Window.partitionBy("part").orderBy("log_index")))
    ends = own.groupBy("part").agg(F.min("log_index").alias("first"), F.max("log_index").alias("last")).withColumn("group", F.floor(F.col("part") / width))
    between = ends.withColumn("after", F.lag("last").over(Window.partitionBy("group").orderBy("part")))
    groups = ends.groupBy("group").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("after", F.lag("last").over(Window.orderBy("group")))
    return gaps(inside, "log_index").union(gaps(between, "first")).union(gaps(groups, "first"))


def anchors_due(checkpoints: DataFrame, anchors: DataFrame) -> DataFrame:
    return checkpoints.join(anchors.select("tree_size"), "tree_size", "left_anti")


def anchor_matches(anchors: DataFrame, checkpoints: DataFrame) -> DataFrame:
    return anchors.join(checkpoints.select("tree_size", "root"), "tree_size").select("tree_size", (F.col("message_hash") == F.col("root")).alias("matches"))


def is_hex64(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
