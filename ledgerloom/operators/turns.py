"""Transcript turns: blocks, sessions, variants, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import carried, islands


def first_write_wins(turns: DataFrame, key: str = "turn_uuid") -> DataFrame:
    """One row a key: the least by (file_rank, offset)."""
    order = Window.partitionBy(key).orderBy("file_rank", "offset")
    return turns.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def composite_order(turns: DataFrame) -> DataFrame:
    """turn_order = file number within the session, shifted left by 40 bits, or the offset. Only the files of a session, not its turns, are ordered in one task."""
    files = turns.select("session_id", "path").distinct()
    number = files.withColumn("_number", F.row_number().over(Window.partitionBy("session_id").orderBy("path")) - 1)
    return turns.join(number, ["session_id", "path"]).withColumn("turn_order", F.shiftleft(F.col("_number").cast("long"), 40).bitwiseOR(F.col("offset"))).drop("_number")


def session_aggregates(turns: DataFrame) -> DataFrame:
    """Counts, token sums and the sorted distinct variants (as JSON) by session; two steps, so that no set grows with a session's turns."""
    per_variant = turns.groupBy("session_id", "model_variant").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("output_tokens", "visible_bytes", "thinking_blocks", "hidden_tokens"))
    )
    return per_variant.groupBy("session_id").agg(
        F.sum("n").alias("turn_count"), *(F.sum(c).alias(c) for c in ("output_tokens", "visible_bytes", "thinking_blocks", "hidden_tokens")), F.to_json(F.array_sort(F.collect_list("model_variant"))).alias("variants")
    )


def session_attributes(turns: DataFrame) -> DataFrame:
    """Start, and the first non-null source and variant in turn order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("turn_order"))).alias(c)
    return turns.groupBy("session_id").agg(F.min("ts_ms").alias("started_ms"), first("source"), first("model_variant"))


def sessions(turns: DataFrame) -> DataFrame:
    return session_aggregates(turns).join(session_attributes(turns), "session_id")


def hidden_tokens_total(turns: DataFrame, session: str | None = None, since_ms: int | None = None) -> DataFrame:
    turns = turns if session is None else turns.where(F.col("session_id") == session)
    turns = turns if since_ms is None else turns.where(F.col("ts_ms") >= since_ms)
    return turns.agg(F.sum("hidden_tokens").alias("hidden_tokens"), F.sum("thinking_blocks").alias("thinking_blocks"), F.countDistinct("session_id").alias("sessions"))


def hidden_tokens_by_variant(turns: DataFrame) -> DataFrame:
    return turns.where("model_variant IS NOT NULL").groupBy("model_variant").agg(F.sum("hidden_tokens").alias("hidden_tokens"))


def reasoning_stats(blocks: DataFrame, turns: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Reasoning blocks joined to their turns."""
    kept = turns.select("turn_uuid", "ts_ms") if since_ms is None else turns.where(F.col("ts_ms") >= since_ms).select("turn_uuid", "ts_ms")
    return blocks.where("kind = 'reasoning'").join(kept, "turn_uuid").agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("byte_len"), F.lit(0)).alias("bytes"))


def variant_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("model_variant").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")).orderBy(F.desc("n"), "model_variant")


def sessions_with_variant(sessions: DataFrame, turns: DataFrame, variant: str) -> DataFrame:
    return sessions.join(turns.where(F.col("model_variant") == variant).select("session_id"), "session_id", "left_semi")


def variants_seen(turns: DataFrame) -> DataFrame:
    return turns.where("model_variant IS NOT NULL").select("session_id", "model_variant").distinct()


def keyset_page(sessions: DataFrame, *, source: str | None = None, since_ms: int | None = None, after: tuple[int, str] | None = None, limit: int = 20) -> DataFrame:
    """Sessions from the latest start on; ``after`` is the (started_ms, session_id) of the page before."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    if source is not None:
        sessions = sessions.where(F.col("source") == source)
    if since_ms is not None:
        sessions = sessions.where(F.col("started_ms") >= since_ms)
    if after is not None:
        sessions = sessions.where((F.col("started_ms") < after[0]) | ((F.col("started_ms") == after[0]) & (F.col("session_id") < after[1])))
    return sessions.orderBy(F.desc("started_ms"), F.desc("session_id")).limit(limit)


def session_page(sessions: DataFrame, turns: DataFrame, *, source: str | None = None, since_ms: int | None = None, variant: str | None = None, cursor: str | None = None, limit: int = 20) -> DataFrame:
    """A page of sessions from the latest start on, with next_cursor, the id of the page's last session. ``cursor`` is that of the page before; an id that is not known gives the first page. Sessions of one start are ordered by id, so that none is lost between pages. A limit beyond 1 to 100 is cut to it."""
    limit, place = max(1, min(100, limit)), F.struct("started_ms", "session_id")
    kept = sessions if source is None else sessions.where(F.col("source") == source)
    kept = kept if since_ms is None else kept.where(F.col("started_ms") >= since_ms)
    kept = kept if variant is None else sessions_with_variant(kept, turns, variant)
    if cursor is not None:
        at = sessions.where(F.col("session_id") == cursor).agg(F.max(place).alias("_at"))
        kept = kept.join(F.broadcast(at)).where(F.col("_at").isNull() | (place < F.col("_at"))).drop("_at")
    page = kept.orderBy(F.desc("started_ms"), F.desc("session_id")).limit(limit)
    return page.join(F.broadcast(page.agg(F.min_by("session_id", place).alias("next_cursor"))))


def offset_page(turns: DataFrame, session: str, limit: int, offset: int) -> DataFrame:
    """A page of a session's turns, with the total and whether more follow."""
    own = turns.where(F.col("session_id") == session)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    page = own.orderBy("turn_order").offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def needs_rescan(sessions: DataFrame, after_ms: int = 60_000) -> DataFrame:
    return sessions.where(F.col("last_scan_ms").isNull() | (F.col("updated_ms") - F.col("last_scan_ms") > after_ms))


def pending_receipts(turns: DataFrame, source: str) -> DataFrame:
    return turns.where((F.col("source") == source) & F.col("kernel_event_id").isNull()).orderBy("session_id", "turn_order")


def preserve_receipts(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """A rewrite keeps the receipt ids that are stored."""
    held = stored.where("kernel_event_id IS NOT NULL").select("turn_uuid", F.col("kernel_event_id").alias("_held"))
    return fresh.join(held, "turn_uuid", "left").withColumn("kernel_event_id", F.coalesce("_held", "kernel_event_id")).drop("_held")


def root_turns(turns: DataFrame) -> DataFrame:
    """Turns whose parent is not among the turns."""
    known = turns.select(F.col("turn_uuid").alias("parent_turn_uuid"))
    return turns.join(known, "parent_turn_uuid", "left_anti")


def with_parents(turns: DataFrame) -> DataFrame:
    parents = turns.select(F.col("turn_uuid").alias("parent_turn_uuid"), F.col("role").alias("parent_role"))
    return turns.join(parents, "parent_turn_uuid", "left")


def blocks_with_content(blocks: DataFrame, blobs: DataFrame) -> DataFrame:
    return blocks.join(blobs.withColumnRenamed("hash", "content_hash"), "content_hash", "left")


def blocks_meta(blocks: DataFrame) -> DataFrame:
    """The blocks of a turn as a JSON array with a fixed set of keys, in block order."""
    one = F.struct("idx", "kind", "byte_len", "content_hash")
    return blocks.groupBy("turn_uuid").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("blocks_meta"))


def turn_manifest(blocks: DataFrame) -> DataFrame:
    """Hash of a turn's block hashes joined by line ends, in block order."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "content_hash"))), lambda b: b["content_hash"])
    return blocks.groupBy("turn_uuid").agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(hashes, "\n"), 256)).alias("manifest"))


def capture(policy: Column) -> Column:
    """Only the exact word full, in any case, captures bodies."""
    return F.when(F.lower(policy) == "full", "full").otherwise("metadata")


def call_linkage(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Matched calls, calls without output and outputs without call, by file."""
    left = calls.select("file", "call_id").distinct().withColumn("called", F.lit(True))
    right = outputs.select("file", "call_id").distinct().withColumn("answered", F.lit(True))
    both = left.join(right, ["file", "call_id"], "full")
    return both.groupBy("file").agg(F.count_if(F.col("called") & F.col("answered")).alias("matched"), F.count_if(F.col("answered").isNull()).alias("orphan_calls"), F.count_if(F.col("called").isNull()).alias("orphan_outputs"))


def rollout_turns(items: DataFrame) -> DataFrame:
    """Gaps and islands over the items of a file (file, offset, role, ts_ms): a user or developer message is a turn of its own, everything between merges into one assistant turn; model is carried forward; turn_uuid counts emitted turns from 0. A file is many tasks."""
    own = F.coalesce(F.col("role").isin("user", "developer"), F.lit(False))
    placed = islands(items, ["file"], "offset", own, "island", lasts={"model": F.col("model")})
    got = placed.groupBy("file", "island").agg(F.count(F.lit(1)).alias("items"), F.min_by("ts_ms", "offset").alias("ts_ms"), F.when(F.bool_and(own), F.min_by("role", "offset")).otherwise("assistant").alias("role"), F.max_by("model", "offset").alias("model"))
    numbered = carried(got, ["file"], "island", sums={"turn": F.lit(1).cast("long")}).withColumn("turn", F.col("turn") - 1)
    return numbered.select("file", "turn", "items", "ts_ms", "role", "model", F.concat("file", F.lit(":t"), "turn").alias("turn_uuid"))


def turn_granularity(items: DataFrame) -> DataFrame:
    """User turns, and the most and mean items between user messages (items before the first are left out)."""
    user = F.col("role") == "user"
    numbered = carried(items, ["file"], "offset", sums={"turn": user.cast("long")}).where("turn > 0")
    per_turn = numbered.groupBy("file", "turn").agg(F.count_if(~user).alias("items"))
    return per_turn.agg(F.count(F.lit(1)).alias("user_turns"), F.max("items").alias("max_items"), F.avg("items").alias("mean_items"))


def shape_profile(items: DataFrame, dims: list[str]) -> DataFrame:
    """Counts of the values of several columns in one pass, as rows (dim, value, n)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("value")) for d in dims)))
    return items.select(pairs.alias("p")).groupBy(F.col("p.dim").alias("dim"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def last_user_images(entries: DataFrame) -> DataFrame:
    """By session, whether its last user entry has images."""
    return entries.where("role = 'user'").groupBy("session_id").agg(F.max_by("turn_uuid", "turn_order").alias("turn_uuid"), F.max_by("has_images", "turn_order").alias("has_images"))
