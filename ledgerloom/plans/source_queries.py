"""Queries that write raw files from the tables and read them again, normalise hooks, or run as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import rollout as R
from ..functions import signatures as G
from ..functions.scratch import scratch
from ..operators import turns as T
from ..sources import transcripts as S
from ..streaming import jobs as J
from ..streaming.queue import Queue
from .catalog import query
from .views import EVENTS_SQL, TURNS_SQL, audit_events, table, turns

EV, TU = "WITH " + EVENTS_SQL + " ", "WITH " + TURNS_SQL + " "
FILES = 16


def _write_lines(lines: DataFrame, path: str) -> str:
    """lines (file, ord, value): one file a folder, in order."""
    lines.repartition(FILES, "file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    return path


def _transcript_files(s: SparkSession, d: str) -> str:
    """A jsonl file for each conv_id % 16, with summaries, tool results, entries without ids, bad lines, and one file that starts with a bad line."""
    c = table(s, d, "conversations")
    entry = F.struct(
        F.when(F.col("turn") % 7 == 6, "summary").otherwise(F.col("role")).alias("type"),
        F.when((F.col("conv_id") % 13 != 5) | (F.col("turn") > 0), F.concat("conv_id", F.lit(":t"), "turn")).alias("uuid"),
        F.col("conv_id").cast("string").alias("sessionId"),
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
        F.struct(F.col("role").alias("role"), F.array(F.struct(F.when(F.col("conv_id") % 11 == 3, "tool_result").otherwise("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message"),
    )
    file = F.col("conv_id") % FILES
    good = c.select(file.alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.to_json(entry).alias("value"))
    bad = c.where("turn = 1 AND conv_id % 5 = 0").select(file.alias("file"), (F.col("conv_id") * 1000 + 1).alias("ord"), F.lit("{broken").alias("value"))
    first = s.range(1).select((F.lit(7)).cast("long").alias("file"), F.lit(-1).cast("long").alias("ord"), F.lit("{broken").alias("value"))
    return _write_lines(good.union(bad).union(first), scratch(s, "transcripts"))


KEPT = "role IN ('assistant', 'user') AND turn % 7 <> 6 AND NOT (conv_id % 13 = 5 AND turn = 0) AND NOT (conv_id % 11 = 3 AND role = 'user') AND conv_id % 16 <> 7"


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, concat(conv_id, ':t', turn) AS turn_uuid, role, CAST(strlen(text) AS BIGINT) AS byte_len FROM conversations WHERE {KEPT}")
def s1_scan_transcripts(s: SparkSession, d: str) -> DataFrame:
    """Also s3: bad lines are skipped, and the whole of a file that starts with one."""
    e = S.scan_transcripts(s, _transcript_files(s, d), "*.txt")
    return e.select(F.col("sessionId").alias("session_id"), F.col("uuid").alias("turn_uuid"), "role", F.octet_length(F.try_variant_get("message", "$.content[0].text", "string")).cast("long").alias("byte_len"))


@query(f"SELECT CAST(15 - (SELECT count(*) FROM generate_series(0, 15) g(f) WHERE f <> 7 AND f NOT IN (SELECT conv_id % 16 FROM conversations WHERE {KEPT})) AS BIGINT) AS files, count(DISTINCT conv_id) AS sessions, count(*) AS turns FROM conversations WHERE {KEPT}")
def s14_dry_run(s: SparkSession, d: str) -> DataFrame:
    return S.dry_run(S.scan_transcripts(s, _transcript_files(s, d), "*.txt"))


@query("SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS line_bytes, CAST(sum(strlen(concat(conv_id, '|', turn, '|', replace(replace(text, chr(10), ' '), chr(13), ' '))) + 1) OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) - strlen(concat(conv_id, '|', turn, '|', replace(replace(text, chr(10), ' '), chr(13), ' '))) - 1 AS BIGINT) AS \"offset\" FROM conversations")
def s2_line_offsets(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    flat = F.translate("text", "\n\r", "  ")
    path = _write_lines(c.select((F.col("conv_id") % FILES).alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat_ws("|", "conv_id", "turn", flat).alias("value")), scratch(s, "lines"))
    lines = S.with_offsets(S.read_lines(s, path, "*.txt"))
    parts = F.split("value", r"\|", 3)
    return lines.select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), F.octet_length(parts[2]).cast("long").alias("line_bytes"), "offset")


@query(EV + "SELECT log_index, action_type AS type, concat('{\"k\":', log_index % 5, '}') AS payload FROM ev WHERE log_index % 9 <> 4")
def s4_scan_rollouts(s: SparkSession, d: str) -> DataFrame:
    ev = audit_events(s, d)
    line = F.when(F.col("log_index") % 9 == 4, F.lit('{"type": oops')).otherwise(F.to_json(F.struct(F.col("log_index").cast("string").alias("timestamp"), F.col("action_type").alias("type"), F.struct((F.col("log_index") % 5).alias("k")).alias("payload"))))
    path = scratch(s, "rollouts")
    _write_lines(ev.select((F.col("log_index") % FILES).alias("file"), F.col("log_index").alias("ord"), line.alias("value")), path)
    items, _ = S.scan_rollouts(s, path, "*.txt")
    return items.select(F.col("timestamp").cast("long").alias("log_index"), "type", "payload")


@query("SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN concat(left(md5(CAST(conv_id AS VARCHAR)), 8), '-aaaa-bbbb-cccc-', right(md5(CAST(conv_id AS VARCHAR)), 12)) ELSE concat('plain-', conv_id) END AS session_id FROM conversations")
def s5_path_session_id(s: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("conv_id").cast("string"))
    name = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("rollout-2024-01-01T00-00-00-"), F.left(h, F.lit(8)), F.lit("-aaaa-bbbb-cccc-"), F.right(h, F.lit(12)), F.lit(".jsonl"))).otherwise(F.concat(F.lit("rollout-plain-"), "conv_id", F.lit(".jsonl")))
    return table(s, d, "conversations").select("conv_id", S.path_session_id(name).alias("session_id")).distinct()


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 16 = 3")
def s6_scan_filters(s: SparkSession, d: str) -> DataFrame:
    path = _write_lines(table(s, d, "conversations").select((F.col("conv_id") % FILES).alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat_ws("|", "conv_id", "turn").alias("value")), scratch(s, "filters"))
    parts = F.split("value", r"\|")
    return S.only_session(S.read_lines(s, path, "*.txt"), "file=3").select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"))


@query(EV + "SELECT id, action_type FROM (SELECT * FROM ev WHERE actor_id = 'u8' ORDER BY log_index DESC LIMIT 50)")
def s7_read_event_log(s: SparkSession, d: str) -> DataFrame:
    from ..operators.events import newest

    return newest(audit_events(s, d).where("actor_id = 'u8'"), 50).orderBy("log_index").select("id", "action_type")


@query(EV + "SELECT count(*) AS rows, count(*) FILTER (log_index % 9 = 4) AS failed, count(DISTINCT CASE WHEN log_index % 9 <> 4 THEN id END) AS ids FROM ev")
def s8_read_spillover(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "spill")
    audit_events(s, d).select(F.when(F.col("log_index") % 9 == 4, F.lit("{oops")).otherwise(F.to_json(F.struct("id", "action_type"))).alias("value")).write.text(path)
    rows = S.read_spillover(s, path, "id string, action_type string")
    return rows.select("id", "_corrupt_record").agg(F.count(F.lit(1)).alias("rows"), F.count("_corrupt_record").alias("failed"), F.countDistinct("id").alias("ids"))


@query(TU + "SELECT turn_uuid, CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN 2 ELSE 1 END AS version FROM tu")
def s12_index_upsert(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d).select("session_id", "turn_uuid", F.lit(1).alias("version"))
    old, new = scratch(s, "index"), scratch(s, "index")
    S.upsert_sessions(t, old)
    S.upsert_into(s, t.where("CAST(session_id AS BIGINT) % 4 = 0").withColumn("version", F.lit(2)), old, new)
    return s.read.parquet(new).select("turn_uuid", "version")


@query("SELECT 'note-v1' AS schema, 'note' AS event_type, text AS content, CASE WHEN turn % 2 = 0 THEN concat('conv-', conv_id) ELSE 'library' END AS source FROM conversations WHERE role = 'user'")
def s15_append_note(s: SparkSession, d: str) -> DataFrame:
    """Two appends to one log: notes with a source, and notes without."""
    notes, path = table(s, d, "conversations").where("role = 'user'"), scratch(s, "notes")
    S.append_notes(notes.where("turn % 2 = 0").select(F.col("text").alias("content"), F.concat(F.lit("conv-"), "conv_id").alias("source")), path)
    S.append_notes(notes.where("turn % 2 = 1").select(F.col("text").alias("content")), path)
    return s.read.parquet(path).drop("metadata")


# --- hooks

NAMES = ["Bash", "Read", "Write", "Edit", "Glob", "Grep", "WebFetch", "WebSearch", "Task", "mcp__git__log", "Other", "Shell"]
FIELD = {"Bash": "command", "Shell": "command", "Read": "file_path", "Write": "file_path", "Edit": "file_path", "Glob": "pattern", "Grep": "pattern", "WebFetch": "url", "WebSearch": "query", "Task": "subagent_type"}
HOOKS = ["PreToolUse", "PostToolUse", "PostToolUseFailure"]


def _pick(values: list[str], number: str):  # noqa: ANN202
    return F.element_at(F.array(*map(F.lit, values)), (F.col(number) % len(values) + 1).cast("int"))


def _raw_tools(s: SparkSession, d: str) -> DataFrame:
    ev = audit_events(s, d)
    tool = _pick(NAMES, "log_index")
    names = F.element_at(F.create_map(*(F.lit(x) for p in FIELD.items() for x in p)), tool)
    row = F.struct(_pick(HOOKS, "log_index").alias("hook_event_name"), tool.alias("tool_name"), F.create_map(F.coalesce(names, F.lit("x")), F.concat(F.lit("arg "), "payload")).alias("tool_input"), F.col("session_id"), F.when(F.col("log_index") % 2 == 0, F.struct((F.col("log_index") % 3).alias("exit_code"))).alias("tool_response"))
    return ev.select("log_index", F.concat(F.when(F.col("log_index") % 5 == 0, "﻿").otherwise(""), F.to_json(row)).alias("raw"))


def _case(values: list[str], number: str = "log_index") -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


ALL_TOOLS = N.TOOLS | N.MORE_TOOLS | {"mcp__git__log": "mcp_tool_call"}
PREFIX = {t: (p, w) for ts, p, w, _ in N.SUBJECTS for t in ts}
TARGETS = [f"{PREFIX[t][0]}:" if t in PREFIX else ("mcp:" if t.startswith("mcp") else "tool:") + t for t in NAMES]
WORDS = [f"{PREFIX[t][1]}: " if t in PREFIX else "Tool call: " + t for t in NAMES]
HAS = _case(["y" if t in PREFIX else "n" for t in NAMES]) + " = 'y'"


@query(
    EV
    + f"""SELECT log_index, concat({_case([ALL_TOOLS.get(t, 'tool_call') for t in NAMES])}, {_case(['_pre', '', '_failed'])}) AS event_type,
  concat({_case(TARGETS)}, CASE WHEN {HAS} THEN concat('arg ', payload) ELSE '' END) AS target, concat({_case(WORDS)}, CASE WHEN {HAS} THEN concat('arg ', payload) ELSE '' END) AS content,
  session_id AS session, CASE WHEN log_index % 2 = 0 THEN concat('{{"has_response":true,"exit_code":', log_index % 3, '}}') ELSE '{{"has_response":false}}' END AS response FROM ev"""
)
def n_tool_events(s: SparkSession, d: str) -> DataFrame:
    """n1 event type, n2 suffix, n3 target, n4 content, n7 capture mode, n8 metadata, n10 byte-order mark."""
    got = N.normalize_tool_events(_raw_tools(s, d), "raw", "agent")
    return got.select("log_index", "event_type", "target", "content", F.col("metadata")["session_id"].alias("session"), "response")


LIFE = list(N.LIFECYCLE)


@query(
    EV
    + "SELECT log_index, "
    + _case([N.LIFECYCLE[h][0] for h in LIFE])
    + " AS event_type, concat("
    + _case([N.LIFECYCLE[h][1] for h in LIFE])
    + ", CASE WHEN "
    + _case(["y" if N.LIFECYCLE[h][2] else "n" for h in LIFE])
    + " = 'y' THEN CASE WHEN log_index % 3 = 0 THEN 'unknown' ELSE concat('v', log_index % 4) END ELSE '' END) AS target, CASE WHEN log_index % 16 IN (13, 14) THEN CAST(strlen(payload) AS BIGINT) END AS byte_len FROM ev"
)
def n_lifecycle_events(s: SparkSession, d: str) -> DataFrame:
    """n5 lifecycle hooks, n6 fields of which only the length stays."""
    ends = sorted({last for _, _, last, _, _ in N.LIFECYCLE.values() if last})
    value = F.when(F.col("log_index") % 3 != 0, F.concat(F.lit("v"), F.col("log_index") % 4))
    raw = F.to_json(F.struct(_pick(LIFE, "log_index").alias("hook_event_name"), *(value.alias(e) for e in ends), F.col("payload").alias("content"), F.col("payload").alias("message")))
    got = N.normalize_lifecycle(audit_events(s, d).select("log_index", raw.alias("raw")), "raw", "agent")
    return got.select("log_index", "event_type", "target", "byte_len")


@query(EV + "SELECT log_index, concat('hook/', target) AS target, 'observe' AS action_type, log_index % 3 AS kind FROM ev WHERE log_index % 10 <> 7")
def n9_submit_shape(s: SparkSession, d: str) -> DataFrame:
    """Also n13: rows seen through the other tool are dropped."""
    ev = audit_events(s, d).select("log_index", "target", F.when(F.col("log_index") % 10 == 7, '{"cursor_version":"1"}').otherwise("{}").alias("raw"))
    return N.submit_payload(N.drop_second_hand(ev, "raw", "cursor_version")).select("log_index", "target", "action_type", (F.col("log_index") % 3).alias("kind"))


@query("SELECT event_id, concat('user_', event_type, CASE WHEN event_id % 2 = 0 THEN '_x' ELSE '' END) AS name FROM events")
def n11_snake_case(s: SparkSession, d: str) -> DataFrame:
    camel = F.concat(F.lit("User"), F.initcap("event_type"), F.when(F.col("event_id") % 2 == 0, "X").otherwise(""))
    return table(s, d, "events").select("event_id", N.snake_case(camel).alias("name"))


@query("SELECT doc_id, length(base64(encode(text))) AS b64_len, length(base64(encode(text))) * 3 // 4 AS approx_bytes FROM documents")
def n12_image_blocks(s: SparkSession, d: str) -> DataFrame:
    """Over whole texts."""
    block = lambda kind, data: F.struct(F.lit(kind).alias("type"), F.lit("image/png").alias("media_type"), data.alias("data"))
    blocks = F.array(block("text", F.lit("x")), block("image", F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")))
    return table(s, d, "documents").select("doc_id", F.explode(N.image_blocks(blocks)).alias("i")).select("doc_id", "i.b64_len", "i.approx_bytes")


def _variant(text: Column) -> Column:
    """g1 to g3 of a text as a signature without padding."""
    unpadded = F.regexp_replace(F.base64(text.cast("binary")), "[=\r\n]", "")
    return G.variant_by_priority(G.ascii_runs(G.decode_base64(unpadded)), ["[a-z]*tion", "[a-z]*ent"])


def _variant_sql(text: str) -> str:
    """Bytes of characters beyond ASCII are not printable, so runs of characters are runs of bytes."""
    first = lambda p: f"list_filter(list_transform(regexp_extract_all({text}, '[\\x20-\\x7e]{{4,}}'), lambda x: regexp_extract(x, '{p}', 0)), lambda x: x <> '')[1]"
    return f"coalesce({first('[a-z]*tion')}, {first('[a-z]*ent')})"


@query(f"SELECT doc_id, {_variant_sql('text')} AS variant FROM documents")
def g_signatures(s: SparkSession, d: str) -> DataFrame:
    """g1 to g3 over all rows and whole texts."""
    return table(s, d, "documents").select("doc_id", _variant(F.col("text")).alias("variant"))


@query(f"SELECT conv_id, arg_min(variant, turn) FILTER (variant IS NOT NULL) AS variant FROM (SELECT conv_id, turn, {_variant_sql('text')} AS variant FROM conversations) GROUP BY conv_id")
def g4_turn_variant(s: SparkSession, d: str) -> DataFrame:
    """g4: the first block with a variant names the turn; here a conversation's messages are the blocks."""
    blocks = table(s, d, "conversations").select("conv_id", "turn", _variant(F.col("text")).alias("variant"))
    return G.turn_variant(blocks, "conv_id", order="turn")


# --- streams

EVENT_SCHEMA = "log_index long, id string, event_type string, action_type string, actor_id string, session_id string, event_ms long, settled_energy long, event_time timestamp"


def _stream(s: SparkSession, d: str, copies: int = 1) -> DataFrame:
    """The events as files of a folder, in log order by file, read as a stream of several batches."""
    path = scratch(s, "events")
    rows = audit_events(s, d).withColumn("event_time", F.timestamp_millis("event_ms")).select(*(c.split()[0] for c in EVENT_SCHEMA.split(", ")))
    rows.withColumn("copy", F.explode(F.array(*map(F.lit, range(copies))))).drop("copy").repartitionByRange(4, "log_index").write.parquet(path)
    return J.read_events(s, path, EVENT_SCHEMA, 2)


@query(EV + "SELECT event_ms // 86400000 * 86400000 AS day_ms, CAST(sum(settled_energy) AS BIGINT) AS energy FROM ev GROUP BY 1")
def t4_daily_counter(s: SparkSession, d: str) -> DataFrame:
    """Also t8: event time is the client's where it is given. The watermark here is as long as the log, so no row is late."""
    sink = scratch(s, "daily")
    J.run_once(J.daily_counter(_stream(s, d), "60 days"), sink, "update")
    return J.latest(s, sink, ["day_ms"])


@query(EV + "SELECT session_id, count(*) AS n, CAST(sum(settled_energy) AS BIGINT) AS energy FROM ev GROUP BY 1")
def t5_session_state(s: SparkSession, d: str) -> DataFrame:
    sink = scratch(s, "sessions")
    J.run_once(J.session_state(_stream(s, d), late="60 days"), sink, "update")
    return J.latest(s, sink, ["session_id"]).select("session_id", "n", "energy")


@query(EV + "SELECT id, event_ms FROM ev")
def t6_spillover_replay(s: SparkSession, d: str) -> DataFrame:
    sink = scratch(s, "replay")
    J.run_once(J.without_replays(_stream(s, d, copies=2), "60 days"), sink, "append")
    return s.read.parquet(f"{sink}/rows").select("id", "event_ms")


@query(TU + "SELECT concat(source, '/turn/', turn_uuid) AS target FROM tu")
def t7_receipt_outbox(s: SparkSession, d: str) -> DataFrame:
    path, receipts, sink = scratch(s, "turns"), scratch(s, "receipts"), scratch(s, "outbox")
    t = turns(s, d).select("source", "turn_uuid")
    t.union(t).repartition(4).write.parquet(path)
    J.outbox(s, J.read_events(s, path, "source string, turn_uuid string", 2), receipts, sink)
    return s.read.parquet(receipts).select("target")


@query(EV + "SELECT CAST(count(*) FILTER (log_index % 9 <> 4) AS BIGINT) AS good, count(*) FILTER (log_index % 9 = 4) AS dead FROM ev")
def t3_dead_letter(s: SparkSession, d: str) -> DataFrame:
    """Also t2: the checkpoint is the queue."""
    path, sink = scratch(s, "lines"), scratch(s, "queue")
    audit_events(s, d).select(F.when(F.col("log_index") % 9 == 4, F.lit("{oops")).otherwise(F.to_json(F.struct("id"))).alias("value")).repartition(4).write.parquet(path)
    J.split_bad_rows(s, J.read_events(s, path, "value string", 2), "id string", sink)
    good = s.read.parquet(f"{sink}/rows").agg(F.count("id").alias("good"))
    return good.join(F.broadcast(s.read.parquet(f"{sink}/dead").agg(F.count(F.lit(1)).alias("dead"))))


@query(EV + "SELECT CASE WHEN log_index % 9 = 4 OR log_index % 5 = 3 THEN 'dead' ELSE 'done' END AS fate, CAST(CASE WHEN log_index % 9 = 4 OR log_index % 5 = 3 THEN 3 ELSE log_index % 5 END AS INTEGER) AS attempts, CASE WHEN log_index % 9 = 4 THEN 'not JSON' WHEN log_index % 5 = 3 THEN 'not there yet' WHEN log_index % 5 > 0 THEN 'not there yet' END AS last_error, count(*) AS n FROM ev WHERE log_index % 5 < 4 GROUP BY ALL")
def t3_retries(s: SparkSession, d: str) -> DataFrame:
    """Four rounds over a queue: rows that are no JSON, and rows whose subject is there only from round log_index % 5 on (3: after their last attempt)."""
    value = F.when(F.col("log_index") % 9 == 4, F.lit("{oops")).otherwise(F.to_json(F.struct("id")))
    queue = audit_events(s, d).where("log_index % 5 < 4").select("log_index", value.alias("value"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))
    done = None
    for turn in range(4):
        attempt = lambda rows, turn=turn: rows.withColumn("error", F.when(F.try_parse_json("value").isNull(), "not JSON").when(F.col("log_index") % 5 > turn, "not there yet"))
        through, left = J.drain(queue, attempt)
        path = scratch(s, "retries")
        left.write.parquet(path)
        through.write.parquet(f"{path}-done")
        queue, through = s.read.parquet(path), s.read.parquet(f"{path}-done")
        done = through if done is None else done.unionByName(through)
    fates = done.withColumn("fate", F.lit("done")).unionByName(queue.withColumn("fate", F.lit("dead")))
    return fates.groupBy("fate", "attempts", "last_error").agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT CASE WHEN log_index % 9 = 4 OR log_index % 5 = 3 THEN 'dead' ELSE 'done' END AS fate, CAST(CASE WHEN log_index % 9 = 4 OR log_index % 5 = 3 THEN 3 ELSE log_index % 5 END AS INTEGER) AS attempts, CASE WHEN log_index % 9 = 4 THEN 'not JSON' WHEN log_index % 5 = 3 THEN 'not there yet' WHEN log_index % 5 > 0 THEN 'not there yet' END AS last_error, count(*) AS n FROM ev WHERE log_index % 5 < 4 GROUP BY ALL")
def t2_durable_queue(s: SparkSession, d: str) -> DataFrame:
    """The same rounds over a queue that is only added to, compacted after the second, its entries put in by two calls."""
    log = audit_events(s, d).where("log_index % 5 < 4")
    value = F.when(F.col("log_index") % 9 == 4, F.lit("{oops")).otherwise(F.to_json(F.struct("id")))
    entries, queue, done = log.select("log_index", value.alias("value")), Queue(s, scratch(s, "queue")), None
    for half in (0, 1):
        queue.put(entries.where(F.col("log_index") % 2 == half))
    for turn in range(4):
        before = queue.pending()
        queue.drain(lambda rows, turn=turn: rows.withColumn("error", F.when(F.try_parse_json("value").isNull(), "not JSON").when(F.col("log_index") % 5 > turn, "not there yet")))
        through = before.join(queue.left().select("seq"), "seq", "left_anti")
        done = through if done is None else done.unionByName(through)
        if turn == 1:
            queue.compact()
    fates = done.withColumn("fate", F.lit("done")).unionByName(queue.dead().withColumn("fate", F.lit("dead")))
    return fates.groupBy("fate", "attempts", "last_error").agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT action_type, count(*) AS n, min(event_ms) AS first_ms, max(event_ms) AS last_ms FROM ev GROUP BY 1")
def t10_stream_stats(s: SparkSession, d: str) -> DataFrame:
    sink = scratch(s, "stats")
    J.run_once(J.running_stats(_stream(s, d)), sink, "update")
    return J.latest(s, sink, ["action_type"])


@query("SELECT conv_id, turn FROM conversations WHERE conv_id >= 40")
def t1_incremental_scan(s: SparkSession, d: str) -> DataFrame:
    """The files of the first 40 conversations are scanned already, up to their ends; the rest is new."""
    c = table(s, d, "conversations")
    path = _write_lines(c.select((F.col("conv_id") % FILES).alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat_ws("|", "conv_id", "turn").alias("value")), scratch(s, "grown"))
    lines = S.with_offsets(S.read_lines(s, path, "*.txt"))
    parts = F.split("value", r"\|")
    state = lines.where(parts[0].cast("long") < 40).groupBy("path").agg(F.max(F.col("offset") + F.octet_length("value") + 1).alias("scanned_to"))
    return S.incremental_scan(s, path, "*.txt", state).select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"))


@query(TU + "SELECT session_id, CAST(sum(1) AS BIGINT) AS turn_count, CAST(sum(hidden_tokens) AS BIGINT) AS hidden_tokens FROM tu WHERE session_id IN (SELECT session_id FROM tu WHERE turn_order = 5) GROUP BY 1")
def t9_recompute_on_batch(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    return J.recompute_touched(t, t.where("turn_order = 5"), T.session_aggregates).select("session_id", "turn_count", "hidden_tokens")


ITEMS = ["message", *R.SINGLE, "ghost_snapshot", "unknown"]
_KINDS = ["input_text", *(v[0] for v in R.SINGLE.values())]
_ROLES = ["user", *(v[1] for v in R.SINGLE.values())]
_TOOLS = ["", *(v[2] or ("shell" if v[0] == "tool_call" else "") for v in R.SINGLE.values())]
_SIZES = ["y", *("y" if v[3] else "n" for v in R.SINGLE.values())]


@query(
    EV
    + f"""SELECT log_index, {_case(_KINDS, 'k')} AS kind, {_case(_ROLES, 'k')} AS role, nullif({_case(_TOOLS, 'k')}, '') AS tool_name, CASE WHEN {_case(_SIZES, 'k')} = 'y' THEN CAST(strlen(payload) AS BIGINT) ELSE 0 END AS byte_len
  FROM (SELECT *, log_index % {len(ITEMS)} AS k FROM ev) WHERE k < {len(_KINDS)}"""
)
def d8_rollout_blocks(s: SparkSession, d: str) -> DataFrame:
    """Also d9, values as text: payload strings that are JSON themselves stay strings."""
    kind = _pick(ITEMS, "log_index")
    fields = sorted({v[3] for v in R.SINGLE.values() if v[3]})
    part = F.array(F.struct(F.lit("input_text").alias("type"), F.col("payload").alias("text")), F.struct(F.lit("other").alias("type"), F.lit("x").alias("text")))
    raw = F.to_json(F.struct(kind.alias("type"), F.lit("user").alias("role"), F.lit("shell").alias("name"), part.alias("content"), *(F.col("payload").alias(f) for f in fields)))
    return R.rollout_blocks(audit_events(s, d).select("log_index", raw.alias("payload"))).select("log_index", "kind", "role", "tool_name", "byte_len")


@query(TU + "SELECT turn_uuid, CAST(0 AS INTEGER) AS block_index, kind, CASE WHEN kind <> 'reasoning' THEN content_hash END AS content_hash, byte_len, concat('agent', CASE WHEN turn_order % 2 = 0 THEN ' 1.0' ELSE '' END) AS tag FROM tu WHERE turn_order % 3 = 0")
def d12_turn_content_rows(s: SparkSession, d: str) -> DataFrame:
    """Also d11, the source tag."""
    t = turns(s, d).withColumns({"capture": T.capture(F.when(F.col("turn_order") % 3 == 0, "full")), "blocks": F.array(F.struct("kind", "content_hash", "byte_len"))})
    tags = t.select("turn_uuid", R.source_tag(F.lit("agent"), F.when(F.col("turn_order") % 2 == 0, "1.0")).alias("tag"))
    return R.turn_content_rows(t).join(tags, "turn_uuid")
