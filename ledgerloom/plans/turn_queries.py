"""Queries of transcripts: turns, blocks, sessions, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import turns as T
from .catalog import query
from .views import TURNS_SQL, turns

TU = "WITH " + TURNS_SQL
SESS = TU + """, ses AS (SELECT session_id, min(ts_ms) AS started_ms, arg_min(source, turn_order) AS source, arg_min(model_variant, turn_order) AS model_variant, count(*) AS turn_count FROM tu GROUP BY 1) """
T0 = 1_704_067_200_000 + 20 * 3_600_000


def _blocks(s: SparkSession, d: str) -> DataFrame:
    """Content lines of a turn are its blocks."""
    return turns(s, d).select("turn_uuid", "session_id", "kind", F.posexplode(F.split("text", "\n")).alias("idx", "text")).select(
        "turn_uuid", "session_id", F.col("idx").cast("long").alias("idx"), "kind", "text", F.octet_length("text").cast("long").alias("byte_len"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash")
    )


BLOCKS = TURNS_SQL + """, bl AS (SELECT turn_uuid, session_id, CAST(i - 1 AS BIGINT) AS idx, kind, parts[i] AS text, CAST(strlen(parts[i]) AS BIGINT) AS byte_len, concat('sha256:', sha256(parts[i])) AS content_hash
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM tu) t, unnest(generate_series(1, len(parts))) g(i)) """


@query("WITH " + BLOCKS + "SELECT turn_uuid, idx, kind, byte_len, content_hash FROM bl")
def d1_block_explode(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("turn_uuid", "idx", "kind", "byte_len", "content_hash")


@query(TU + " SELECT turn_uuid, byte_len, output_tokens, visible_bytes, thinking_blocks, hidden_tokens FROM tu")
def d6_hidden_tokens(s: SparkSession, d: str) -> DataFrame:
    """d2 byte lengths, d3 usage, d4 visible bytes, d5 thinking blocks, d6 the estimate."""
    return turns(s, d).select("turn_uuid", "byte_len", "output_tokens", "visible_bytes", "thinking_blocks", "hidden_tokens")


@query("WITH " + BLOCKS + """SELECT turn_uuid, concat('[', string_agg(concat('{"idx":', idx, ',"kind":"', kind, '","byte_len":', byte_len, ',"content_hash":"', content_hash, '"}'), ',' ORDER BY idx), ']') AS blocks_meta FROM bl GROUP BY 1""")
def d7_blocks_meta(s: SparkSession, d: str) -> DataFrame:
    return T.blocks_meta(_blocks(s, d))


@query(TU + " SELECT turn_uuid, CASE WHEN lower(p) = 'full' THEN 'full' ELSE 'metadata' END AS capture FROM (SELECT turn_uuid, CASE turn_order % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'fully' END AS p FROM tu)")
def d10_capture_policy(s: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("turn_order") % 3 == 0, "FULL").when(F.col("turn_order") % 3 == 1, "fully")
    return turns(s, d).select("turn_uuid", T.capture(given).alias("capture"))


@query("WITH " + BLOCKS + "SELECT turn_uuid, concat('sha256:', sha256(string_agg(content_hash, chr(10) ORDER BY idx))) AS manifest FROM bl GROUP BY 1")
def b5_turn_manifest(s: SparkSession, d: str) -> DataFrame:
    return T.turn_manifest(_blocks(s, d))


@query(TU + " SELECT turn_uuid, file_rank, off AS \"offset\" FROM (SELECT turn_uuid, copy AS file_rank, turn_order * 100 AS off, row_number() OVER (PARTITION BY turn_uuid ORDER BY copy) AS n FROM tu, (VALUES (0), (1)) c(copy) WHERE copy = 1 OR turn_order % 2 = 0) WHERE n = 1")
def w5_first_write_wins(s: SparkSession, d: str) -> DataFrame:
    """Two files hold the turns; the first has only every other one."""
    two = turns(s, d).select("turn_uuid", (F.col("turn_order") * 100).alias("offset"), "turn_order", F.explode(F.array(F.lit(0), F.lit(1))).alias("file_rank")).where("file_rank = 1 OR turn_order % 2 = 0")
    return T.first_write_wins(two).select("turn_uuid", "file_rank", "offset")


@query(TU + " SELECT turn_uuid, ((dense_rank() OVER (PARTITION BY session_id ORDER BY turn_order % 2) - 1) << 40) | turn_order AS turn_order FROM tu")
def w6_composite_order(s: SparkSession, d: str) -> DataFrame:
    rows = turns(s, d).select("session_id", "turn_uuid", F.concat(F.lit("f"), F.col("turn_order") % 2).alias("path"), F.col("turn_order").alias("offset"))
    return T.composite_order(rows).select("turn_uuid", "turn_order")


@query(TU + """ SELECT session_id, CAST(sum(1) AS BIGINT) AS turn_count, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(visible_bytes) AS BIGINT) AS visible_bytes, CAST(sum(thinking_blocks) AS BIGINT) AS thinking_blocks,
  CAST(sum(hidden_tokens) AS BIGINT) AS hidden_tokens, concat('[', string_agg(DISTINCT concat('"', model_variant, '"'), ',' ORDER BY concat('"', model_variant, '"')), ']') AS variants FROM tu GROUP BY 1""")
def a9_session_aggregates(s: SparkSession, d: str) -> DataFrame:
    return T.session_aggregates(turns(s, d))


@query(SESS + "SELECT session_id, started_ms, source, model_variant FROM ses")
def a10_session_attributes(s: SparkSession, d: str) -> DataFrame:
    return T.session_attributes(turns(s, d))


@query(TU + f" SELECT CAST(sum(hidden_tokens) AS BIGINT) AS hidden_tokens, CAST(sum(thinking_blocks) AS BIGINT) AS thinking_blocks, count(DISTINCT session_id) AS sessions FROM tu WHERE ts_ms >= {T0}")
def a11_hidden_tokens_total(s: SparkSession, d: str) -> DataFrame:
    return T.hidden_tokens_total(turns(s, d), since_ms=T0)


@query(TU + " SELECT model_variant, CAST(sum(hidden_tokens) AS BIGINT) AS hidden_tokens FROM tu GROUP BY 1")
def a12_hidden_tokens_by_variant(s: SparkSession, d: str) -> DataFrame:
    return T.hidden_tokens_by_variant(turns(s, d))


@query("WITH " + BLOCKS + f"SELECT count(*) AS blocks, CAST(coalesce(sum(b.byte_len), 0) AS BIGINT) AS bytes FROM bl b JOIN tu t USING (turn_uuid) WHERE b.kind = 'reasoning' AND t.ts_ms >= {T0}")
def a13_reasoning_stats(s: SparkSession, d: str) -> DataFrame:
    """Also the join j1 of reasoning blocks to turns."""
    return T.reasoning_stats(_blocks(s, d), turns(s, d), T0)


@query(TU + " SELECT model_variant, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM tu GROUP BY 1")
def a14_variant_stats(s: SparkSession, d: str) -> DataFrame:
    return T.variant_stats(turns(s, d))


@query("WITH " + BLOCKS + "SELECT 'kind' AS dim, kind AS value, count(*) AS n FROM bl GROUP BY kind UNION ALL SELECT 'session_id', session_id, count(*) FROM bl GROUP BY session_id")
def a15_shape_profile(s: SparkSession, d: str) -> DataFrame:
    return T.shape_profile(_blocks(s, d), ["kind", "session_id"])


@query("WITH " + BLOCKS + "SELECT count(*) FILTER (kind = 'reasoning') AS reasoning, count(*) FILTER (kind = 'reasoning' AND byte_len > 100) AS with_content, count(*) FILTER (kind = 'reasoning' AND idx = 0) AS with_summary FROM bl")
def a16_reasoning_profile(s: SparkSession, d: str) -> DataFrame:
    own = F.col("kind") == "reasoning"
    return _blocks(s, d).agg(F.count_if(own).alias("reasoning"), F.count_if(own & (F.col("byte_len") > 100)).alias("with_content"), F.count_if(own & (F.col("idx") == 0)).alias("with_summary"))


def _items(s: SparkSession, d: str) -> DataFrame:
    """Blocks as the items of a rollout file a session; user turns are one item, the model is known at turn starts only."""
    t = turns(s, d).select("turn_uuid", "session_id", "turn_order", "role", "ts_ms", "model_variant")
    lines = t.join(_blocks(s, d).select("turn_uuid", "idx"), "turn_uuid").where("role <> 'user' OR idx = 0")
    return lines.select(F.col("session_id").alias("file"), (F.col("turn_order") * 10_000 + F.col("idx")).alias("offset"), "role", (F.col("ts_ms") + F.col("idx")).alias("ts_ms"), F.when(F.col("idx") == 0, F.col("model_variant")).alias("model"))


ITEMS = BLOCKS + """, it AS (SELECT t.session_id AS file, turn_order * 10000 + b.idx AS off, role, ts_ms + b.idx AS ts_ms, CASE WHEN b.idx = 0 THEN model_variant END AS model FROM tu t JOIN bl b USING (turn_uuid) WHERE role <> 'user' OR b.idx = 0),
 fl AS (SELECT *, role IN ('user', 'developer') AS own, lag(role IN ('user', 'developer')) OVER (PARTITION BY file ORDER BY off) AS prev FROM it),
 isl AS (SELECT *, CAST(sum(CASE WHEN own OR coalesce(prev, true) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY off) - 1 AS BIGINT) AS turn, last_value(model IGNORE NULLS) OVER (PARTITION BY file ORDER BY off) AS m FROM fl) """


@query("WITH " + ITEMS + "SELECT file, turn, count(*) AS items, min(ts_ms) AS ts_ms, CASE WHEN arg_min(own, off) THEN arg_min(role, off) ELSE 'assistant' END AS role, arg_max(m, off) AS model, concat(file, ':t', turn) AS turn_uuid FROM isl GROUP BY file, turn")
def w2_rollout_turns(s: SparkSession, d: str) -> DataFrame:
    """Also w3 (carried model) and w4 (a turn starts with its first item)."""
    return T.rollout_turns(_items(s, d))


@query("WITH " + ITEMS + ", num AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY off) AS u FROM it) SELECT count(*) AS user_turns, max(n) AS max_items, avg(n) AS mean_items FROM (SELECT file, u, count(*) FILTER (role <> 'user') AS n FROM num WHERE u > 0 GROUP BY 1, 2)")
def a17_turn_granularity(s: SparkSession, d: str) -> DataFrame:
    return T.turn_granularity(_items(s, d))


@query(SESS + "SELECT session_id, started_ms FROM ses WHERE session_id IN (SELECT session_id FROM tu WHERE model_variant = 'v1')")
def j2_sessions_with_variant(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    return T.sessions_with_variant(T.session_attributes(t), t, "v1").select("session_id", "started_ms")


@query(TU + " SELECT DISTINCT session_id, model_variant FROM tu")
def j3_session_variants_seen(s: SparkSession, d: str) -> DataFrame:
    return T.variants_seen(turns(s, d))


@query("WITH " + BLOCKS + "SELECT b.turn_uuid, b.idx, CASE WHEN b.byte_len >= 64 THEN b.text END AS content FROM bl b")
def j4_turn_blocks_content(s: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(s, d)
    blobs = blocks.where("byte_len >= 64").groupBy("content_hash").agg(F.first("text").alias("content")).withColumnRenamed("content_hash", "hash")
    return T.blocks_with_content(blocks.select("turn_uuid", "idx", "content_hash"), blobs).select("turn_uuid", "idx", "content")


@query(TU + """, calls AS (SELECT DISTINCT source AS file, turn_order + CAST(session_id AS BIGINT) AS call_id FROM tu WHERE role = 'assistant'), outs AS (SELECT DISTINCT source AS file, turn_order + 1 + CAST(session_id AS BIGINT) AS call_id FROM tu WHERE role = 'user')
 SELECT coalesce(c.file, o.file) AS file, count(*) FILTER (c.call_id IS NOT NULL AND o.call_id IS NOT NULL) AS matched, count(*) FILTER (o.call_id IS NULL) AS orphan_calls, count(*) FILTER (c.call_id IS NULL) AS orphan_outputs FROM calls c FULL JOIN outs o ON c.file = o.file AND c.call_id = o.call_id GROUP BY 1""")
def j5_call_linkage(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    number = F.col("turn_order") + F.col("session_id").cast("long")
    return T.call_linkage(t.where("role = 'assistant'").select(F.col("source").alias("file"), number.alias("call_id")), t.where("role = 'user'").select(F.col("source").alias("file"), (number + 1).alias("call_id")))


@query(TU + " SELECT turn_uuid, coalesce(kernel_event_id, concat('new-', turn_order)) AS kernel_event_id FROM tu")
def j7_preserve_receipts(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d).select("turn_uuid", "kernel_event_id")
    fresh = turns(s, d).select("turn_uuid", F.concat(F.lit("new-"), "turn_order").alias("kernel_event_id"))
    return T.preserve_receipts(fresh, t)


@query(TU + " SELECT t.turn_uuid, t.parent_turn_uuid, p.role AS parent_role FROM tu t LEFT JOIN tu p ON t.parent_turn_uuid = p.turn_uuid")
def j11_parent_turn(s: SparkSession, d: str) -> DataFrame:
    return T.with_parents(turns(s, d)).select("turn_uuid", "parent_turn_uuid", "parent_role")


@query(TU + " SELECT t.turn_uuid FROM tu t WHERE NOT EXISTS (SELECT 1 FROM tu p WHERE p.turn_uuid = t.parent_turn_uuid)")
def j11_root_turns(s: SparkSession, d: str) -> DataFrame:
    return T.root_turns(turns(s, d)).select("turn_uuid")


@query(SESS + "SELECT session_id, started_ms, source FROM ses WHERE source = 's1' AND (started_ms, session_id) < (1704240000000, '48') ORDER BY started_ms DESC, session_id DESC LIMIT 20")
def l1_keyset_page_sessions(s: SparkSession, d: str) -> DataFrame:
    return T.keyset_page(T.session_attributes(turns(s, d)), source="s1", after=(1_704_240_000_000, "48")).select("session_id", "started_ms", "source")


@query(
    SESS
    + """SELECT * FROM (SELECT 'first' AS page, session_id, started_ms, last_value(session_id) OVER (ORDER BY started_ms DESC, session_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_cursor FROM (SELECT * FROM ses WHERE session_id IN (SELECT session_id FROM tu WHERE model_variant = 'v1') ORDER BY started_ms DESC, session_id DESC LIMIT 3))
 UNION ALL SELECT * FROM (SELECT 'unknown' AS page, session_id, started_ms, last_value(session_id) OVER (ORDER BY started_ms DESC, session_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_cursor FROM (SELECT * FROM ses WHERE session_id IN (SELECT session_id FROM tu WHERE model_variant = 'v1') ORDER BY started_ms DESC, session_id DESC LIMIT 3))
 UNION ALL SELECT * FROM (SELECT 'next' AS page, session_id, started_ms, last_value(session_id) OVER (ORDER BY started_ms DESC, session_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_cursor FROM (SELECT * FROM ses WHERE session_id IN (SELECT session_id FROM tu WHERE model_variant = 'v1') AND (started_ms < (SELECT started_ms FROM ses WHERE session_id = '9') OR started_ms = (SELECT started_ms FROM ses WHERE session_id = '9') AND session_id < '9') ORDER BY started_ms DESC, session_id DESC LIMIT 3))"""
)
def l1_session_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of the sessions of a variant: without a cursor, after one that is not known, and after session 9; each with its next cursor."""
    t = turns(s, d)
    every = T.session_attributes(t)
    pages = {"first": None, "unknown": "nobody", "next": "9"}
    rows = [T.session_page(every, t, variant="v1", cursor=c, limit=3).select(F.lit(name).alias("page"), "session_id", "started_ms", "next_cursor") for name, c in pages.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query(TU + " SELECT turn_uuid, turn_order, (SELECT count(*) FROM tu WHERE session_id = '3') AS total, (SELECT count(*) FROM tu WHERE session_id = '3') > 3 AS has_more FROM tu WHERE session_id = '3' ORDER BY turn_order LIMIT 2 OFFSET 1")
def l2_offset_page_turns(s: SparkSession, d: str) -> DataFrame:
    return T.offset_page(turns(s, d), "3", 2, 1).select("turn_uuid", "turn_order", "total", "has_more")


@query(SESS + "SELECT session_id FROM (SELECT session_id, started_ms + turn_count * 20000 AS updated, CASE WHEN CAST(session_id AS BIGINT) % 4 > 0 THEN started_ms END AS scanned FROM ses) WHERE scanned IS NULL OR updated - scanned > 60000")
def f12_needs_rescan(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    state = T.session_attributes(t).join(t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), "session_id").select("session_id", (F.col("started_ms") + F.col("n") * 20_000).alias("updated_ms"), F.when(F.col("session_id").cast("long") % 4 > 0, F.col("started_ms")).alias("last_scan_ms"))
    return T.needs_rescan(state).select("session_id")


@query(TU + " SELECT turn_uuid FROM tu WHERE source = 's1' AND kernel_event_id IS NULL")
def f13_pending_receipts(s: SparkSession, d: str) -> DataFrame:
    return T.pending_receipts(turns(s, d), "s1").select("turn_uuid")


@query(TU + " SELECT session_id, arg_max(turn_uuid, turn_order) AS turn_uuid, arg_max(byte_len % 2 = 0, turn_order) AS has_images FROM tu WHERE role = 'user' GROUP BY 1")
def w10_last_user_has_image(s: SparkSession, d: str) -> DataFrame:
    return T.last_user_images(turns(s, d).withColumn("has_images", F.col("byte_len") % 2 == 0))


@query(TU + " SELECT turn_uuid, source, CASE WHEN source = 's2' THEN NULL ELSE model_variant END AS model_variant FROM tu WHERE source IN ('s1', 's2')")
def u1_union_sources(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    return t.where("source = 's1'").select("turn_uuid", "source", "model_variant").unionByName(t.where("source = 's2'").select("source", "turn_uuid"), allowMissingColumns=True)


@query(TU + " SELECT turn_order AS k FROM tu WHERE role = 'user' INTERSECT SELECT turn_order + 1 FROM tu WHERE role = 'assistant'")
def u2_linkage_sets(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    return t.where("role = 'user'").select(F.col("turn_order").alias("k")).intersect(t.where("role = 'assistant'").select((F.col("turn_order") + 1).alias("k")))


@query(TU + " SELECT source, count(DISTINCT session_id) AS sessions, count(*) AS turns, count(DISTINCT content_hash) AS bodies FROM tu GROUP BY 1")
def a25_index_report(s: SparkSession, d: str) -> DataFrame:
    return turns(s, d).groupBy("source").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("turns"), F.countDistinct("content_hash").alias("bodies"))
