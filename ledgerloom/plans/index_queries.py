"""Queries of the transcript index: entries as they are on disk are written from the conversations, then read, parsed and indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rollout as R
from ..functions.scratch import discard, scratch
from ..operators import indexing as X
from ..sources import transcripts as S
from ..sources.index_store import Store, Version
from .catalog import query
from .views import table

PATTERNS = ("mv-[0-9]+-long", "mv-[0-9]+")
FILES = 16


def entry_json(c: DataFrame) -> Column:
    """An entry with blocks of every kind, usage, and whatever else an entry holds."""
    conv, turn = F.col("conv_id"), F.col("turn")
    signature = F.base64(F.concat(F.unhex(F.lit("0112ff")), F.concat(F.lit("mv-"), conv % 4, F.when(turn % 2 == 0, "-long").otherwise("")).cast("binary"), F.unhex(F.lit("00fe"))))
    # Fields without a value are left out of the JSON, so each block has just its own.
    block = lambda kind, **own: F.struct(F.lit(kind).alias("type"), *(own.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("text", "string"), ("thinking", "string"), ("signature", "string"), ("name", "string"), ("input", "struct<n: bigint, path: string>"), ("content", "string"), ("is_error", "boolean"))))
    text = block("text", text=F.col("text"))
    thinking = block("thinking", thinking=F.col("text"), signature=F.when(turn % 3 < 2, F.regexp_replace(signature, "[\r\n]", "")))
    tool = block("tool_use", name=F.lit("Read"), input=F.struct(turn.cast("long").alias("n"), F.concat(F.lit("/srv/"), conv).alias("path")))
    result = block("tool_result", content=F.concat(F.lit("ok "), turn), is_error=F.when(turn % 4 == 0, True).when(turn % 4 == 1, False))
    when = lambda condition, b: F.when(condition, F.array(b)).otherwise(F.array().cast("array<struct<type: string, text: string, thinking: string, signature: string, name: string, input: struct<n: bigint, path: string>, content: string, is_error: boolean>>"))
    assistant = F.col("role") == "assistant"
    blocks = F.concat(when(assistant & (conv % 5 == 0), thinking), when((conv % 11 != 3) | assistant, text), when(assistant & (turn % 3 == 1), tool), when(assistant, block("other")), when(~assistant & ((conv % 11 == 3) | (turn % 3 == 0)), result))
    usage = F.when(assistant & (conv % 6 != 5), F.struct(F.length("text").cast("long").alias("input_tokens"), F.ceil(F.length("text") / 2).cast("long").alias("output_tokens"), turn.cast("long").alias("cache_creation_input_tokens"), F.when(turn % 3 != 1, turn.cast("long") * 2).alias("cache_read_input_tokens")))
    head = (
        F.when(turn % 7 == 6, "summary").otherwise(F.col("role")).alias("type"),
        F.when((conv % 13 != 5) | (turn > 0), F.concat(conv, F.lit(":t"), turn)).alias("uuid"),
        F.when(turn > 0, F.concat(conv, F.lit(":t"), turn - 1)).alias("parentUuid"),
        conv.cast("string").alias("sessionId"),
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad(turn.cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
        F.when(turn % 3 == 1, F.concat(F.lit("/w/"), turn)).alias("cwd"),
        F.when(turn % 4 == 2, F.concat(F.lit("b"), turn)).alias("gitBranch"),
        F.when(turn % 5 == 3, F.concat(F.lit("1."), conv % 7)).alias("version"),
    )
    message = lambda content: F.struct(F.when(turn % 2 == 0, F.col("role")).alias("role"), F.concat(F.lit("m"), conv % 3).alias("model"), content.alias("content"), usage.alias("usage"))
    # A text as content, instead of blocks, is a turn without blocks.
    return F.when(conv % 17 == 4, F.to_json(F.struct(*head, message(F.col("text")).alias("message")))).otherwise(F.to_json(F.struct(*head, message(blocks).alias("message"))))


def write_entries(s: SparkSession, d: str, blank: bool = False) -> str:
    """A file for each conv_id % 16, in order; with bad lines, and one file that starts with one. ``blank``: with lines that end in CR LF, after first lines of white space alone."""
    c = table(s, d, "conversations")
    file, place = (F.col("conv_id") % FILES).alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord")
    good = c.select(file, place, entry_json(c).alias("value"))
    bad = c.where("turn = 1 AND conv_id % 5 = 0").select(file, place, F.lit("{broken").alias("value"))
    first = s.range(1).select(F.lit(7).cast("long").alias("file"), F.lit(-1).cast("long").alias("ord"), F.lit("{broken").alias("value"))
    path, lines = scratch(s, "entries"), good.union(bad).union(first)
    if blank:
        white = F.when(F.col("id") % 3 == 0, "\r").when(F.col("id") % 3 == 1, "\t \r").otherwise("\u00a0\t")
        lines = lines.withColumn("value", F.concat("value", F.lit("\r"))).union(s.range(FILES).select(F.col("id").alias("file"), F.lit(-2).cast("long").alias("ord"), white.alias("value")))
    lines.repartition(FILES, "file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    return path


def _turns(s: SparkSession, d: str) -> DataFrame:
    return X.entry_turns(S.scan_transcripts(s, write_entries(s, d), "*.txt"), PATTERNS)


#: kept: the entries that are turns; bl: their blocks; et: turns with what is derived.
INDEX_SQL = """WITH kept AS (SELECT *, conv_id % 17 <> 4 AS has_blocks, concat(conv_id, ':t', turn) AS turn_uuid FROM conversations WHERE role IN ('assistant', 'user') AND turn % 7 <> 6
   AND NOT (conv_id % 13 = 5 AND turn = 0) AND NOT (conv_id % 11 = 3 AND role = 'user' AND conv_id % 17 <> 4) AND conv_id % 16 <> 7),
 raw AS (
  SELECT turn_uuid, 0 AS pos, 'thinking' AS kind, CAST(NULL AS VARCHAR) AS tool_name, CAST(strlen(text) AS BIGINT) AS byte_len, CAST(NULL AS BOOLEAN) AS is_error,
    CASE WHEN turn % 3 < 2 THEN concat('mv-', conv_id % 4, CASE WHEN turn % 2 = 0 THEN '-long' ELSE '' END) END AS variant FROM kept WHERE has_blocks AND role = 'assistant' AND conv_id % 5 = 0
  UNION ALL SELECT turn_uuid, 1, 'text', NULL, strlen(text), NULL, NULL FROM kept WHERE has_blocks
  UNION ALL SELECT turn_uuid, 2, 'tool_use', 'Read', 21 + strlen(CAST(turn AS VARCHAR)) + strlen(CAST(conv_id AS VARCHAR)), NULL, NULL FROM kept WHERE has_blocks AND role = 'assistant' AND turn % 3 = 1
  UNION ALL SELECT turn_uuid, 3, 'tool_result', NULL, 5 + strlen(CAST(turn AS VARCHAR)), turn % 4 = 0, NULL FROM kept WHERE has_blocks AND role = 'user' AND turn % 3 = 0),
 bl AS (SELECT turn_uuid, CAST(row_number() OVER (PARTITION BY turn_uuid ORDER BY pos) - 1 AS INTEGER) AS block_index, kind, tool_name, byte_len, is_error, variant FROM raw),
 us AS (SELECT turn_uuid, length(text) AS input_tokens, CAST(ceil(length(text) / 2.0) AS BIGINT) AS output_tokens, turn AS cache_creation_tokens, CASE WHEN turn % 3 <> 1 THEN turn * 2 END AS cache_read_tokens FROM kept WHERE role = 'assistant' AND conv_id % 6 <> 5),
 ag AS (SELECT turn_uuid, sum(byte_len) FILTER (kind = 'text') AS t, sum(byte_len) FILTER (kind = 'tool_use') AS u, count(*) FILTER (kind = 'thinking') AS k, arg_min(variant, block_index) FILTER (variant IS NOT NULL) AS model_variant FROM bl GROUP BY 1),
 et AS (SELECT turn_uuid, CAST(conv_id AS VARCHAR) AS session_id, turn, role, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, CAST(coalesce(t, 0) AS BIGINT) AS visible_text_bytes, CAST(coalesce(u, 0) AS BIGINT) AS visible_tool_bytes,
   coalesce(k, 0) AS thinking_blocks, greatest(0, coalesce(output_tokens, 0) - CAST((coalesce(t, 0) + coalesce(u, 0) + 3) AS BIGINT) // 4) AS hidden_tokens, model_variant FROM kept LEFT JOIN us USING (turn_uuid) LEFT JOIN ag USING (turn_uuid)),
 se AS (SELECT session_id, count(*) AS turn_count, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS cache_creation_tokens,
   CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(sum(hidden_tokens) AS BIGINT) AS hidden_tokens, CASE WHEN count(model_variant) > 0 THEN concat('["', string_agg(DISTINCT model_variant, '","' ORDER BY model_variant), '"]') END AS variants FROM et GROUP BY 1) """


@query(INDEX_SQL + "SELECT turn_uuid, block_index, kind, tool_name, byte_len, is_error, variant FROM bl")
def d1_content_blocks(s: SparkSession, d: str) -> DataFrame:
    """d1 blocks of content arrays, d2 their sizes, g1 to g3 on their signatures."""
    return X.block_rows(_turns(s, d)).select("turn_uuid", "block_index", "kind", "tool_name", "byte_len", "is_error", "variant")


@query(INDEX_SQL + "SELECT turn_uuid, CAST(conv_id AS VARCHAR) AS session_id FROM kept")
def s3_blank_first_lines(s: SparkSession, d: str) -> DataFrame:
    """Files with CR LF whose first lines are blank: no file is lost but the one whose first line that is not blank is bad."""
    return S.scan_transcripts(s, write_entries(s, d, blank=True), "*.txt").select(F.col("uuid").alias("turn_uuid"), F.col("sessionId").alias("session_id"))


@query("""SELECT conv_id, turn, CAST(strlen('{"a":.0,"b":.5,"c":[1e21,-0.25,"1.0 \\" 2.50"],"d":{"e":1e-7,"f":}}') + 2 * strlen(CAST(conv_id AS VARCHAR)) + strlen(CAST(turn AS VARCHAR)) AS BIGINT) AS byte_len FROM conversations WHERE role = 'assistant'""")
def d2_float_inputs(s: SparkSession, d: str) -> DataFrame:
    """Sizes of tool inputs with numbers that are not whole, some written with needless zeros or exponents."""
    c = table(s, d, "conversations").where("role = 'assistant'")
    number = F.concat(F.lit('{"type":"tool_use","input":{"a":'), "conv_id", F.lit('.00, "b":'), "conv_id", F.lit('.5, "c":[1.0E+21, -2.5e-1, "1.0 \\" 2.50"], "d":{"e":0.0000001, "f":'), "turn", F.lit("}}}"))
    line = F.concat(F.lit('{"type":"assistant","uuid":"u","sessionId":"s","timestamp":"t","message":{"content":[{"type":"text","text":"é"},'), number, F.lit("]}}"))
    e = S.entry(F.try_parse_json("line"), F.col("line"))
    blocks = c.select("conv_id", "turn", line.alias("line")).select("conv_id", "turn", e.alias("e")).select("conv_id", "turn", X.turn_of(F.col("e"), PATTERNS)["blocks"].alias("b"))
    return blocks.select("conv_id", "turn", F.get("b", F.lit(1))["byte_len"].alias("byte_len"))


@query(INDEX_SQL + "SELECT turn_uuid, session_id, role, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, visible_text_bytes, visible_tool_bytes, thinking_blocks, hidden_tokens, model_variant FROM et")
def d3_entry_turns(s: SparkSession, d: str) -> DataFrame:
    """d3 usage, d4 visible bytes, d5 reasoning blocks, d6 hidden tokens, g4 the first block's variant."""
    return _turns(s, d).select("turn_uuid", "session_id", "role", *X.TOKENS, "visible_text_bytes", "visible_tool_bytes", "thinking_blocks", "hidden_tokens", "model_variant")


@query(INDEX_SQL + """SELECT turn_uuid, CASE WHEN count(kind) = 0 THEN '[]' ELSE concat('[', string_agg(concat('{"idx":', block_index, ',"kind":"', kind, '","byte_len":', byte_len, CASE WHEN tool_name IS NULL THEN '' ELSE concat(',"tool_name":"', tool_name, '"') END, CASE WHEN is_error IS NULL THEN '' ELSE concat(',"is_error":', is_error) END, '}'), ',' ORDER BY block_index), ']') END AS blocks_meta FROM kept LEFT JOIN bl USING (turn_uuid) GROUP BY 1""")
def d7_entry_blocks_meta(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d).select("turn_uuid", X.blocks_meta(F.col("blocks")).alias("blocks_meta"))


@query(INDEX_SQL + "SELECT session_id, turn_count, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, hidden_tokens, variants FROM se")
def a9_index_sessions(s: SparkSession, d: str) -> DataFrame:
    """The whole index job: files are read, and sessions come from the tables that it writes."""
    tables = X.index_transcripts(s, write_entries(s, d), scratch(s, "index"), PATTERNS, "*.txt")
    return tables["sessions"].drop("started", "ended")


@query(INDEX_SQL + """SELECT (SELECT count(DISTINCT conv_id % 16) FROM conversations) + (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM conversations WHERE conv_id % 16 = 7) AS files_scanned, CAST(1 AS BIGINT) AS files_failed,
  (SELECT count(*) FROM conversations WHERE turn = 1 AND conv_id % 5 = 0 AND conv_id % 16 <> 7) AS parse_skipped, (SELECT count(*) FROM et) AS turns, (SELECT count(*) FROM se) AS sessions, (SELECT count(*) FROM bl WHERE variant IS NOT NULL) AS signatures,
  (SELECT string_agg(concat(model_variant, '=', n), ',' ORDER BY concat(model_variant, '=', n)) FROM (SELECT model_variant, count(*) AS n FROM et WHERE model_variant IS NOT NULL GROUP BY 1)) AS variants""")
def a25_index_run(s: SparkSession, d: str) -> DataFrame:
    return X.index_transcripts(s, write_entries(s, d), scratch(s, "index"), PATTERNS, "*.txt")["report"]


# --- the index that grows: files with names that stay, whose later lines come with the second run


def write_named(lines: DataFrame, folder: str) -> str:
    """Writes lines (file, ord, value) to one file each, whose names stay: file-<k>.jsonl. Spark writes them, no Python holds lines; the driver renames FILES files."""
    s, drafts = lines.sparkSession, f"{folder}/_drafts"
    lines.repartition(FILES, "file").sortWithinPartitions("file", "ord").select("file", "value").write.mode("overwrite").partitionBy("file").text(drafts)
    path = s._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(s._jsc.hadoopConfiguration())
    for draft in fs.globStatus(path(f"{drafts}/file=*/part-*")):
        name = path(f"{folder}/file-{draft.getPath().getParent().getName().removeprefix('file=')}.jsonl")
        fs.delete(name, False)
        if not fs.rename(draft.getPath(), name):
            raise OSError(f"{name.toString()} could not be written")
    discard(s, drafts)
    return folder


LATER = 3  # turns that come with the second run begin here


def _grown_entries(s: SparkSession, d: str, upto: int | None) -> DataFrame:
    """The entries of a file: those of turns below LATER first. One file begins with a bad line."""
    c = table(s, d, "conversations")
    place = (F.col("turn") >= LATER).cast("long") * 10**15 + F.col("conv_id") * 1000 + F.col("turn")
    good = c.select((F.col("conv_id") % FILES).alias("file"), place.alias("ord"), entry_json(c).alias("value"), "turn")
    first = s.range(1).select(F.lit(7).cast("long").alias("file"), F.lit(-1).cast("long").alias("ord"), F.lit("{broken").alias("value"), F.lit(0).cast("long").alias("turn"))
    every = good.union(first)
    return (every if upto is None else every.where(F.col("turn") < upto)).drop("turn")


def _two_runs(s: SparkSession, d: str) -> tuple[Store, Version]:
    """A run over the first lines, receipts for some of its turns, and a run over the files as they have grown."""
    files, root = scratch(s, "grown"), scratch(s, "index")
    for upto in (LATER, None):
        write_named(_grown_entries(s, d, upto), files)
        X.update_index(s, files, root, PATTERNS, buckets=8)
        if upto:
            c = table(s, d, "conversations").where(f"turn < {LATER} AND conv_id % 2 = 0")
            X.record_receipts(s, root, c.select(F.col("conv_id").cast("string").alias("session_id"), F.concat("conv_id", F.lit(":t"), "turn").alias("turn_uuid"), F.concat(F.lit("r"), "turn").alias("kernel_event_id")), 8)
    store = Store(s, root, 8)
    return store, store.version()


@query(INDEX_SQL + f"SELECT turn_uuid, session_id, role, input_tokens, output_tokens, visible_text_bytes, visible_tool_bytes, thinking_blocks, hidden_tokens, model_variant, CASE WHEN turn < {LATER} AND CAST(session_id AS BIGINT) % 2 = 0 THEN concat('r', turn) END AS kernel_event_id FROM et")
def t1_second_index_run(s: SparkSession, d: str) -> DataFrame:
    """t1 new bytes alone, w5 first by file and place, j7 receipts stay: turns after a second run over grown files."""
    store, v = _two_runs(s, d)
    return store.read(v, "turns").select("turn_uuid", "session_id", "role", "input_tokens", "output_tokens", "visible_text_bytes", "visible_tool_bytes", "thinking_blocks", "hidden_tokens", "model_variant", "kernel_event_id")


@query(
    INDEX_SQL
    + """, fi AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, arg_min(concat('/w/', turn), turn) FILTER (turn % 3 = 1) AS first_cwd, arg_min(concat('b', turn), turn) FILTER (turn % 4 = 2) AS first_git_branch, concat('m', conv_id % 3) AS first_model, CASE WHEN count(*) FILTER (turn % 5 = 3) > 0 THEN concat('1.', conv_id % 7) END AS first_version FROM kept GROUP BY conv_id)
 SELECT session_id, turn_count, input_tokens, output_tokens, hidden_tokens, variants, 'transcript' AS source, first_cwd, first_git_branch, first_model, first_version FROM se JOIN fi USING (session_id)"""
)
def t9_sessions_of_a_second_run(s: SparkSession, d: str) -> DataFrame:
    """t9 sessions are made anew where a run touches them, a10 what a session begins with."""
    store, v = _two_runs(s, d)
    return store.read(v, "sessions").select("session_id", "turn_count", "input_tokens", "output_tokens", "hidden_tokens", "variants", "source", "first_cwd", "first_git_branch", "first_model", "first_version")


# --- rollouts


def _rollout_rows(s: SparkSession, d: str) -> DataFrame:
    """Rollout lines: every conversation's turns with contexts, calls, outputs, reasoning, snapshots, items of no known type, messages without readable parts, broken and blank lines."""
    c = table(s, d, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    assistant = F.col("role") == "assistant"
    item = lambda kind, *fields: F.to_json(F.struct(F.concat(F.lit("ts"), conv * 1000 + turn).alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit(kind).alias("type"), *fields).alias("payload")))
    part = F.struct(F.when((conv + turn) % 5 == 0, "other").when(assistant, "output_text").otherwise("input_text").alias("type"), F.col("text").alias("text"))
    call = F.concat(F.lit("c"), turn).alias("call_id")
    summary = F.when(turn % 3 == 0, F.array(F.struct(F.lit("s").alias("type"), F.lit("x").alias("text")))).otherwise(F.array().cast("array<struct<type: string, text: string>>"))
    lines = (
        F.when(turn % 4 == 0, F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("m"), (conv + turn) % 3).alias("model")).alias("payload")))),
        item("message", F.when(F.col("role") == "system", "developer").otherwise(F.col("role")).alias("role"), F.array(part).alias("content")),
        F.when(assistant & (turn % 3 == 1), item("function_call", F.when(conv % 7 != 3, F.lit("shell")).alias("name"), call, F.lit('{"a":1}').alias("arguments"))),
        F.when(assistant & (turn % 3 == 1) & (conv % 2 == 0), item("function_call_output", call, F.lit("done").alias("output"))),
        F.when(conv % 3 == 0, item("ghost_snapshot")),
        F.when(conv % 4 == 1, item("mystery", F.lit("x").alias("text"))),
        F.when(assistant & (conv % 5 == 2), item("reasoning", F.when(turn % 2 == 1, "abcdef").otherwise("").alias("encrypted_content"), summary.alias("summary"))),
        F.when(turn % 2 == 0, F.lit('{"type":"event_msg","payload":{"type":"note"}}')),
        F.when(turn % 6 == 5, F.lit('{"type": oops')),
        F.when(turn % 5 == 3, F.lit(" ")),
    )
    return c.select((conv % FILES).alias("file"), conv, turn, F.posexplode(F.array(*lines)).alias("k", "value")).where("value IS NOT NULL")


def _rollout_lines(s: SparkSession, d: str) -> str:
    path = scratch(s, "rollouts")
    _rollout_rows(s, d).repartition(FILES, "file").sortWithinPartitions("file", "conv_id", "turn", "k").select("file", "value").write.partitionBy("file").text(path)
    return path


#: li: the lines with what is read of them; an assistant's turn ends with the next user or developer message.
ROLLOUT_SQL = """WITH c AS (SELECT *, CASE WHEN role = 'system' THEN 'developer' ELSE role END AS who, role = 'assistant' AS assistant, conv_id % 16 AS file, conv_id * 100000 + turn * 10 AS pos, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'other' WHEN role = 'assistant' THEN 'output_text' ELSE 'input_text' END AS part,
   concat('ts', conv_id * 1000 + turn) AS ts FROM conversations),
 li AS (
  SELECT file, pos, 'turn_context' AS envelope, NULL AS item, NULL AS own, 0 AS n, 0 AS bytes, concat('m', (conv_id + turn) % 3) AS model, NULL AS ts, NULL AS who, NULL AS part, false AS lacks FROM c WHERE turn % 4 = 0
  UNION ALL SELECT file, pos + 1, 'response_item', 'message', CASE WHEN assistant THEN NULL ELSE who END, CASE WHEN part = 'other' THEN 0 ELSE 1 END, CASE WHEN part = 'other' THEN 0 ELSE strlen(text) END, NULL, ts, who, part, false FROM c
  UNION ALL SELECT file, pos + 2, 'response_item', 'function_call', NULL, 1, 7, NULL, ts, NULL, NULL, conv_id % 7 = 3 FROM c WHERE assistant AND turn % 3 = 1
  UNION ALL SELECT file, pos + 3, 'response_item', 'function_call_output', NULL, 1, 4, NULL, ts, NULL, NULL, false FROM c WHERE assistant AND turn % 3 = 1 AND conv_id % 2 = 0
  UNION ALL SELECT file, pos + 4, 'response_item', 'ghost_snapshot', NULL, 0, 0, NULL, ts, NULL, NULL, false FROM c WHERE conv_id % 3 = 0
  UNION ALL SELECT file, pos + 5, 'response_item', 'mystery', NULL, 0, 0, NULL, ts, NULL, NULL, false FROM c WHERE conv_id % 4 = 1
  UNION ALL SELECT file, pos + 6, 'response_item', 'reasoning', NULL, 1, CASE WHEN turn % 2 = 1 THEN 6 ELSE 0 END, NULL, ts, NULL, NULL, false FROM c WHERE assistant AND conv_id % 5 = 2
  UNION ALL SELECT file, pos + 7, 'event_msg', NULL, NULL, 0, 0, NULL, NULL, NULL, NULL, false FROM c WHERE turn % 2 = 0) """


@query(ROLLOUT_SQL + """, k AS (SELECT *, envelope = 'turn_context' AS context FROM li WHERE envelope = 'turn_context' OR own IS NOT NULL OR n > 0),
 f AS (SELECT *, CASE WHEN own IS NOT NULL OR coalesce(lag(own IS NOT NULL) OVER (PARTITION BY file ORDER BY pos), true) THEN 1 ELSE 0 END AS opens, last_value(model IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS m FROM k),
 i AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY pos) AS island FROM f),
 t AS (SELECT file, island, coalesce(max(own), 'assistant') AS role, arg_min(ts, pos) FILTER (NOT context) AS timestamp, arg_max(m, pos) AS model, CAST(sum(n) AS BIGINT) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes FROM i GROUP BY 1, 2 HAVING sum(n) > 0)
 SELECT CAST(file AS VARCHAR) AS session_id, turn, concat(file, ':t', turn) AS turn_uuid, role, timestamp, model, blocks, bytes FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY island) - 1 AS turn FROM t)""")
def w2_rollout_files(s: SparkSession, d: str) -> DataFrame:
    """Whole rollout files to turns: snapshots, unknown items, messages without readable parts, models carried on."""
    items, _ = S.scan_rollouts(s, _rollout_lines(s, d), "*.txt")
    return R.grouped_turns(items, F.regexp_extract("path", "file=([0-9]+)", 1))


@query(
    INDEX_SQL.rstrip()
    + ROLLOUT_SQL.replace("WITH c AS", ", c AS", 1)
    + """, k AS (SELECT *, envelope = 'turn_context' AS context FROM li WHERE envelope = 'turn_context' OR own IS NOT NULL OR n > 0),
 f AS (SELECT *, CASE WHEN own IS NOT NULL OR coalesce(lag(own IS NOT NULL) OVER (PARTITION BY file ORDER BY pos), true) THEN 1 ELSE 0 END AS opens FROM k),
 i AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY pos) AS island FROM f),
 t AS (SELECT file, island, coalesce(max(own), 'assistant') AS role, CAST(sum(n) AS BIGINT) AS n_blocks, CAST(coalesce(sum(bytes) FILTER (item = 'message'), 0) AS BIGINT) AS visible_text_bytes, CAST(coalesce(sum(bytes) FILTER (item = 'function_call'), 0) AS BIGINT) AS visible_tool_bytes, CAST(coalesce(sum(n) FILTER (item = 'reasoning'), 0) AS BIGINT) AS thinking_blocks FROM i GROUP BY 1, 2 HAVING sum(n) > 0)
 SELECT 'rollout' AS source, concat('file-', file, ':t', row_number() OVER (PARTITION BY file ORDER BY island) - 1) AS turn_uuid, role, n_blocks, visible_text_bytes, visible_tool_bytes, thinking_blocks FROM t
 UNION ALL SELECT 'transcript', turn_uuid, role, (SELECT count(*) FROM bl WHERE bl.turn_uuid = et.turn_uuid), visible_text_bytes, visible_tool_bytes, thinking_blocks FROM et"""
)
def u1_index_of_two_sources(s: SparkSession, d: str) -> DataFrame:
    """u1 one write shape, s12 grown rollouts are replaced with all their blocks: transcripts, and rollouts of which the second run reads the whole of each file that has grown."""
    files, root = scratch(s, "grown"), scratch(s, "index")
    X.update_index(s, write_named(_grown_entries(s, d, None), f"{files}/a"), root, PATTERNS, buckets=8)
    rows = _rollout_rows(s, d).select("file", (F.col("conv_id") * 100_000 + F.col("turn") * 10 + F.col("k")).alias("ord"), "value")
    for part in (rows.where("ord < 4000000 AND ord % 20 < 10"), rows):
        write_named(part, f"{files}/b")
        X.update_rollouts(s, f"{files}/b", root, "file-*.jsonl", buckets=8)
    store = Store(s, root, 8)
    v = store.version()
    blocks = store.read(v, "blocks").groupBy("turn_uuid").agg(F.count(F.lit(1)).alias("n_blocks"))
    return store.read(v, "turns").drop("n_blocks").join(blocks, "turn_uuid", "left").select("source", "turn_uuid", "role", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "visible_text_bytes", "visible_tool_bytes", "thinking_blocks")


@query(ROLLOUT_SQL + """SELECT dim, value, count(*) AS n FROM (
  SELECT 'line' AS dim, 'parsed' AS value FROM li UNION ALL SELECT 'line', 'unparseable' FROM c WHERE turn % 6 = 5 UNION ALL SELECT 'line', 'blank' FROM c WHERE turn % 5 = 3 UNION ALL SELECT 'envelope', envelope FROM li
  UNION ALL SELECT 'item', item FROM li UNION ALL SELECT 'unknown_item', item FROM li WHERE item = 'mystery' UNION ALL SELECT 'typed_failure', item FROM li WHERE lacks UNION ALL SELECT 'role', who FROM li UNION ALL SELECT 'part', CASE WHEN part = 'other' THEN 'unknown' ELSE part END FROM li WHERE part IS NOT NULL) WHERE value IS NOT NULL GROUP BY 1, 2""")
def a15_rollout_shapes(s: SparkSession, d: str) -> DataFrame:
    return R.shape_profile(S.read_lines(s, _rollout_lines(s, d), "*.txt"))


@query("SELECT count(*) AS reasoning, count(*) FILTER (turn % 2 = 1) AS with_content, count(*) FILTER (turn % 3 = 0) AS with_summary FROM conversations WHERE role = 'assistant' AND conv_id % 5 = 2")
def a16_reasoning_items(s: SparkSession, d: str) -> DataFrame:
    return R.reasoning_profile(S.scan_rollouts(s, _rollout_lines(s, d), "*.txt")[0])
