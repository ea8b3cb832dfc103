"""Resharding by minimum-cost flow.

Method: the bytes of each old shard flow to the new shards, whose capacities are equal to a
byte; a byte that stays costs nothing and one that moves costs one. The optimal flow says how many
bytes each old shard sends where. The rows of an old shard, largest first, are laid end to end
and its line is cut into blocks of these sizes: the block that stays comes first, so that the cuts
fall between small rows and shards end up within a few small rows of equal. Only shards that gain
or lose a block are rewritten.

Nothing but totals by (old shard, size class) reaches the driver; positions along a line come from
prefix sums in two levels, over bounded buckets of rows.

Defined results: a null text has no bytes and size 8; null ids and repeated rows are placed like
any other row; an empty table gives no rows; extra columns are ignored by ``assign``.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OLD_SHARDS, NEW_SHARDS = 16, 24
ROW_BYTES = 8
#: Size classes a doubling; and mean rows of a bucket in which rows are put in order.
CLASSES = 4
BUCKET_ROWS = 2_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Integer flow from supplies to capacities of least total cost (successive shortest paths)."""
    n, m = len(supply), len(capacity)
    left, room, flow = [*supply], [*capacity], [[0] * m for _ in range(n)]
    while any(left):
        # Cheapest paths from the supplies that are left, forth along any edge and back along used ones.
        far: list[int | None] = [0 if x else None for x in left] + [None] * m
        came: list[int | None] = [None] * (n + m)
        waiting = deque(i for i in range(n) if left[i])
        while waiting:
            u = waiting.popleft()
            edges = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in edges:
                if far[v] is None or far[u] + c < far[v]:
                    far[v], came[v] = far[u] + c, u
                    if v not in waiting:
                        waiting.append(v)
        ends = [n + j for j in range(m) if room[j] and far[n + j] is not None]
        if not ends:
            raise ValueError("the capacities are less than the supplies")
        end = min(ends, key=lambda v: far[v])
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0]], room[end - n], *(flow[v][u - n] for u, v in steps if u >= n)])
        left[path[0]] -= amount
        room[end - n] -= amount
        for u, v in steps:
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
    return flow


def plan_transfers(old_bytes: list[int], n_new: int) -> list[list[int]]:
    """Bytes from each old shard to each new one; shard i stays shard i."""
    total = sum(old_bytes)
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    return min_cost_flow(old_bytes, capacity, [[int(i != j) for j in range(n_new)] for i in range(len(old_bytes))])


def hash_shard(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def _before(values: dict[tuple[int, ...], int], group: int) -> dict[tuple[int, ...], int]:
    """Exclusive prefix sums in key order within equal first ``group`` parts of the key."""
    out, sums = {}, {}
    for key in sorted(values):
        out[key] = sums.get(key[:group], 0)
        sums[key[:group]] = out[key] + values[key]
    return out


def _map(values: dict[tuple[int, ...], int], *names: str) -> Column:
    """Look up a small driver-side table by columns; its size is bounded by shards times size classes."""
    entries = F.create_map(*(F.lit(x) for key, v in values.items() for x in (":".join(map(str, key)), v)))
    return F.coalesce(F.element_at(entries, F.concat_ws(":", *names)), F.lit(0).cast("long"))


def _measures() -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    return (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")


def assign(docs: DataFrame, old_shard: Column | None = None, n_old: int = OLD_SHARDS, n_new: int = NEW_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot; shard sizes near equal, fewest bytes moved."""
    rows = docs.select("doc_id", *_measures(), (hash_shard(n_old) if old_shard is None else old_shard).alias("old_shard"))
    shares = max(1, -(-docs.count() // (BUCKET_ROWS * n_old)))
    # Classes from the largest sizes down; sub deals the rows of a class out, copies of one text and rows without an id too.
    rows = cut(rows.withColumns({"cls": (-F.floor(F.log2("size") * CLASSES)).cast("int"), "sub": F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "size", F.lit(7)), F.lit(shares)).cast("int")}))
    buckets = rows.groupBy("old_shard", "cls", "sub").agg(F.sum("size").alias("bytes"))
    totals = {(r.old_shard, r.cls): r.bytes for r in buckets.groupBy("old_shard", "cls").agg(F.sum("bytes").alias("bytes")).collect()}
    flow = plan_transfers([sum(v for k, v in totals.items() if k[0] == i) for i in range(n_old)], n_new)

    ordered = Window.partitionBy("old_shard", "cls").orderBy("sub")
    starts = buckets.withColumn("start", F.sum("bytes").over(ordered) - F.col("bytes") + _map(_before(totals, 1), "old_shard", "cls")).drop("bytes")
    line = Window.partitionBy("old_shard", "cls", "sub").orderBy(F.desc("size"), "doc_id", "text_crc32")
    placed = rows.join(starts, ["old_shard", "cls", "sub"]).withColumn("middle", F.col("start") + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    block = F.lit(None).cast("int")
    for i, own in enumerate(flow):
        cuts, at = F.lit(None).cast("int"), 0
        for j in sorted((j for j in range(n_new) if own[j]), key=lambda j: (j != i, j)):
            cuts, at = F.coalesce(cuts, F.when(F.col("middle") < at + own[j], F.lit(j))), at + own[j]
        block = F.when(F.col("old_shard") == i, cuts).otherwise(block)
    placed = cut(placed.select("doc_id", "size", "text_crc32", "old_shard", "cls", "sub", block.alias("shard")))

    counts = placed.groupBy("shard", "old_shard", "cls", "sub").agg(F.count(F.lit(1)).alias("n"))
    held = {(r.shard, r.old_shard, r.cls): r.n for r in counts.groupBy("shard", "old_shard", "cls").agg(F.sum("n").alias("n")).collect()}
    among = Window.partitionBy("shard", "old_shard", "cls").orderBy("sub")
    first = counts.withColumn("first", F.sum("n").over(among) - F.col("n") + _map(_before(held, 1), "shard", "old_shard", "cls")).drop("n")
    within = Window.partitionBy("shard", "old_shard", "cls", "sub").orderBy("doc_id", "text_crc32", "size")
    out = placed.join(first, ["shard", "old_shard", "cls", "sub"]).withColumn("slot", F.col("first") + F.row_number().over(within) - 1)
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


def digest(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite_affected(docs: DataFrame, assigned: DataFrame, path: str, old_shard: Column | None = None) -> list[int]:
    """Write the shards whose rows change, each in slot order, to path/shard=N; returns their numbers. Other shards keep their files.

    Null and repeated doc_ids are allowed: rows and places are joined by doc_id, size and checksum,
    and equal ones by number. old_shard is what ``assign`` was given. docs must not be read from path.
    """
    moved = assigned.where("NOT shard <=> old_shard")
    touched = sorted({r[0] for r in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect()})
    measures = dict(zip(("_size", "_crc", "_old"), (*_measures(), F.lit(0) if old_shard is None else old_shard)))
    own = ["doc_id", *measures]
    rows = docs.withColumns(measures).withColumn("_nth", F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0))))
    places = assigned.select(F.col("doc_id").alias("_id"), F.col("size").alias("_own_size"), F.col("text_crc32").alias("_own_crc"), (F.lit(0) if old_shard is None else F.col("old_shard")).alias("_own_old"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    places = places.withColumn("_own_nth", F.row_number().over(Window.partitionBy("_id", "_own_size", "_own_crc", "_own_old").orderBy("_shard", "_slot"))).where(F.col("_shard").isin(touched))
    same = rows["doc_id"].eqNullSafe(places["_id"])
    for a, b in (("_size", "_own_size"), ("_crc", "_own_crc"), ("_old", "_own_old"), ("_nth", "_own_nth")):
        same = same & (rows[a] == places[b])
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    out = rows.join(places, same).select(*kept, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    # A shard that all rows have left has nothing to overwrite its files with.
    held = {r[0] for r in assigned.select("shard").distinct().collect()}
    spark = docs.sparkSession
    for shard in set(touched) - held:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return touched
