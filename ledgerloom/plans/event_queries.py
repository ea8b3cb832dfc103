"""Queries of the event log and of session reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import events as E
from ..operators import report as R
from ..operators import rollups as U
from ..operators import segments as G
from .catalog import query
from .views import EVENTS_SQL, audit_events

EV = "WITH " + EVENTS_SQL + " "
COLS = ["log_index", "id", "actor_id", "action_type", "event_type", "target", "event_ms", "settled_energy"]
SEL = ", ".join(COLS)
T0 = 1_704_844_800_000  # 2024-01-10
T1 = 1_705_276_800_000  # 2024-01-15
CLOCK = "printf('%02d:%02d', (event_ms % 86400000) // 3600000, (event_ms % 3600000) // 60000)"
ELLIPSIS = "CASE WHEN strlen(target) > 30 THEN concat(left(target, 27), '...') ELSE target END"
DAY = "strftime(make_timestamp(event_ms * 1000), '%Y-%m-%d')"
DURATION = "printf('%dm %02ds', ({0}) // 60000, (({0}) // 1000) % 60)"


@query(EV + f"SELECT {SEL} FROM ev WHERE actor_id = 'u7' AND action_type = 'view' AND event_ms BETWEEN {T0} AND {T1} + 800000000 AND contains(lower(concat_ws(' ', id, event_hash, actor_id, action_type, target, payload)), 'srv') ORDER BY log_index DESC LIMIT 20")
def f1_event_query(s: SparkSession, d: str) -> DataFrame:
    return E.event_query(audit_events(s, d), actor="u7", action_type="view", start_ms=T0, end_ms=T1 + 800_000_000, keyword="SRV").select(*COLS)


@query(EV + f"SELECT {SEL} FROM ev WHERE contains(lower(concat_ws(' ', id, event_hash, actor_id, action_type, target, payload)), 'git push')")
def f2_keyword_search(s: SparkSession, d: str) -> DataFrame:
    return E.keyword_search(audit_events(s, d), "git PUSH").select(*COLS)


@query(EV + f"SELECT {SEL} FROM ev WHERE event_ms BETWEEN {T0} AND {T1}")
def f3_time_range(s: SparkSession, d: str) -> DataFrame:
    return E.time_range(audit_events(s, d), T0, T1).select(*COLS)


@query(EV + "SELECT log_index, CASE WHEN log_index % 4 = 3 THEN NULL WHEN log_index % 4 = 0 THEN ts_ms ELSE ts_ms // 1000 * 1000 END AS parsed_ms, log_index % 4 = 3 AS unreadable FROM ev")
def f4_parse_mixed_time(s: SparkSession, d: str) -> DataFrame:
    sec = F.floor(F.col("ts_ms") / 1000)
    iso = F.concat(E.day(F.col("ts_ms")).cast("string"), F.lit("T"), F.format_string("%02d:%02d:%02d", F.floor(F.pmod(sec, F.lit(86400)) / 3600).cast("int"), F.floor(F.pmod(sec, F.lit(3600)) / 60).cast("int"), F.pmod(sec, F.lit(60)).cast("int")))
    k = F.col("log_index") % 4
    raw = F.when(k == 0, F.col("ts_ms").cast("string")).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, iso).otherwise("not a time")
    parsed = audit_events(s, d).select("log_index", E.parse_mixed_time(raw).alias("parsed_ms"))
    return parsed.withColumn("unreadable", F.col("parsed_ms").isNull())


@query(EV + "SELECT log_index, event_ms FROM ev")
def f5_event_ts(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).select("log_index", "event_ms")


@query(EV + f"SELECT {SEL} FROM ev WHERE event_ms >= {T1}")
def f6_today_filter(s: SparkSession, d: str) -> DataFrame:
    return E.time_range(audit_events(s, d), start_ms=T1).select(*COLS)


@query(EV + f"SELECT {SEL} FROM ev WHERE session_id = '8-2024-01-01'")
def f7_session_exact(s: SparkSession, d: str) -> DataFrame:
    return E.session_exact(audit_events(s, d), "8-2024-01-01").select(*COLS)


@query(EV + f"SELECT {SEL} FROM ev WHERE session_id LIKE '14%'")
def f8_session_prefix(s: SparkSession, d: str) -> DataFrame:
    return E.session_prefix(audit_events(s, d), "14").select(*COLS)


@query(EV + f"SELECT {SEL} FROM ev WHERE id LIKE 'ev-12%' ORDER BY log_index DESC LIMIT 1")
def f9_id_prefix_lookup(s: SparkSession, d: str) -> DataFrame:
    return E.id_prefix_lookup(audit_events(s, d), "ev-12").select(*COLS)


@query(EV + f"SELECT row_number() OVER (ORDER BY log_index DESC) AS rank, {CLOCK} AS at, event_type AS kind, {ELLIPSIS} AS target, settled_energy AS energy, left(id, 8) AS short_id FROM (SELECT * FROM ev ORDER BY log_index DESC LIMIT 200)")
def f10_history_rows(s: SparkSession, d: str) -> DataFrame:
    return E.history_rows(audit_events(s, d), 200)


@query(EV + "SELECT count(*) AS scanned, count(*) FILTER (action_type = 'error') AS matched, least(count(*) FILTER (action_type = 'error'), 20) AS returned FROM ev")
def f11_scan_counts(s: SparkSession, d: str) -> DataFrame:
    return E.scan_counts(audit_events(s, d), F.col("action_type") == "error", 20)


@query(EV + "SELECT actor_id, balance, reserved FROM (SELECT actor_id, 12000 - sum(settled_energy) AS balance, CAST(count(*) AS BIGINT) AS reserved FROM ev GROUP BY actor_id) WHERE balance - reserved < 10000")
def f14_low_energy(s: SparkSession, d: str) -> DataFrame:
    actors = audit_events(s, d).groupBy("actor_id").agg((12000 - F.sum("settled_energy")).alias("balance"), F.count(F.lit(1)).alias("reserved"))
    return E.low_energy(actors, 10_000)


@query(EV + f"SELECT {SEL} FROM ev WHERE target LIKE 'hook/bash:%' AND (contains(lower(target), 'rm -rf') OR contains(lower(target), 'git push') OR contains(lower(target), 'git reset') OR contains(lower(target), 'drop table') OR contains(lower(target), 'taskkill') OR contains(lower(target), 'force'))")
def f15_flagged_commands(s: SparkSession, d: str) -> DataFrame:
    return E.flagged_commands(audit_events(s, d)).select(*COLS)


@query(EV + "SELECT action_type, count(*) AS n FROM ev GROUP BY 1")
def a1_stats_by_action(s: SparkSession, d: str) -> DataFrame:
    return E.counts(audit_events(s, d), "action_type")


@query(EV + "SELECT actor_id, count(*) AS n FROM ev GROUP BY 1")
def a1_stats_by_actor(s: SparkSession, d: str) -> DataFrame:
    return E.counts(audit_events(s, d), "actor_id")


@query(EV + "SELECT event_ms // 86400000 * 86400000 AS day_ms, count(*) AS n FROM ev GROUP BY 1")
def a2_stats_timeline_day(s: SparkSession, d: str) -> DataFrame:
    return E.timeline_day(audit_events(s, d))


@query(EV + "SELECT min(event_ms) AS earliest_ms, max(event_ms) AS latest_ms, count(*) AS total FROM ev")
def a3_stats_time_range(s: SparkSession, d: str) -> DataFrame:
    return E.time_span(audit_events(s, d))


@query(
    EV
    + f"""SELECT CAST(CAST(c.day AS DATE) AS VARCHAR) AS day, {", ".join(f"CAST(coalesce(sum(settled_energy) FILTER (event_ms % 86400000 // 3600000 = {h}), 0) AS BIGINT) AS h{h:02d}" for h in range(24))}
    FROM (SELECT unnest(generate_series(m - INTERVAL 13 DAY, m, INTERVAL 1 DAY)) AS day FROM (SELECT CAST(max(CAST({DAY} AS DATE)) AS TIMESTAMP) AS m FROM ev)) c
    LEFT JOIN ev ON {DAY} = strftime(c.day, '%Y-%m-%d') GROUP BY 1"""
)
def a4_heatmap(s: SparkSession, d: str) -> DataFrame:
    return E.heatmap(audit_events(s, d), 14).withColumn("day", F.col("day").cast("string"))


@query(
    EV
    + """SELECT *, CASE WHEN pre = 0 THEN 100.0 ELSE (post + failed) * 100.0 / pre END AS completeness FROM (
    SELECT CAST(sum(coalesce(settled_energy, 1)) AS BIGINT) AS energy, count(*) AS events, count(*) FILTER (event_type = 'user_prompt') AS decisions, count(DISTINCT session_id) AS sessions,
      count(*) FILTER (event_type LIKE '%\\_pre' ESCAPE '\\') AS pre, count(*) FILTER (event_type IN ('command_execution', 'file_read', 'file_write', 'file_edit')) AS post, count(*) FILTER (event_type LIKE '%\\_failed' ESCAPE '\\') AS failed FROM ev)"""
)
def a5_presence_totals(s: SparkSession, d: str) -> DataFrame:
    return E.presence_totals(audit_events(s, d))


@query(EV + "SELECT CAST(event_ms % 86400000 // 3600000 AS INTEGER) AS hour, CAST(sum(coalesce(settled_energy, 1)) AS BIGINT) AS energy FROM ev GROUP BY 1 ORDER BY energy DESC, hour DESC LIMIT 1")
def a6_peak_hour(s: SparkSession, d: str) -> DataFrame:
    return E.peak_hour(audit_events(s, d))


@query(
    EV
    + f"""SELECT day, hour, energy, CASE WHEN energy = 0 THEN 0 WHEN energy / top < 0.1 THEN 1 WHEN energy / top < 0.25 THEN 2 WHEN energy / top < 0.5 THEN 3 WHEN energy / top < 0.75 THEN 4 ELSE 5 END AS level
    FROM (SELECT *, max(energy) OVER () AS top FROM (SELECT {DAY} AS day, CAST(event_ms % 86400000 // 3600000 AS INTEGER) AS hour, CAST(sum(coalesce(settled_energy, 1)) AS BIGINT) AS energy FROM ev GROUP BY 1, 2))"""
)
def a7_heat_level(s: SparkSession, d: str) -> DataFrame:
    return E.heat_level(E.hourly_energy(audit_events(s, d))).withColumn("day", F.col("day").cast("string"))


@query(
    EV
    + f"""SELECT session_id, CAST(sum(n) AS BIGINT) AS events, CAST(sum(energy) AS BIGINT) AS energy, min(first_ms) AS first_ms, max(last_ms) AS last_ms, string_agg(concat(action_type, '=', n), ',' ORDER BY concat(action_type, '=', n)) AS actions, {DURATION.format("max(last_ms) - min(first_ms)")} AS duration
    FROM (SELECT session_id, action_type, count(*) AS n, sum(settled_energy) AS energy, min(event_ms) AS first_ms, max(event_ms) AS last_ms FROM ev GROUP BY 1, 2) GROUP BY session_id"""
)
def a8_session_receipt(s: SparkSession, d: str) -> DataFrame:
    return E.session_receipt(audit_events(s, d))


@query(EV + "SELECT event_type AS kind, count(*) AS n, CAST(sum(settled_energy) AS BIGINT) AS energy FROM ev GROUP BY 1")
def a18_export_type_counts(s: SparkSession, d: str) -> DataFrame:
    return E.export_type_counts(audit_events(s, d))


SEG = EVENTS_SQL + """, seg AS (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'user_prompt' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY log_index) AS BIGINT) AS turn FROM ev)
  WHERE NOT ends_with(event_type, '_pre') AND event_type NOT IN ('session_start', 'session_end'))"""


@query("WITH " + SEG + "SELECT session_id, log_index, event_type, turn FROM seg")
def w1_turn_segmentation(s: SparkSession, d: str) -> DataFrame:
    return R.segment_turns(audit_events(s, d)).select("session_id", "log_index", "event_type", "turn")


@query("WITH " + SEG + "SELECT session_id, turn, string_agg(concat(event_type, ' x', n), ' | ' ORDER BY event_type) AS actions FROM (SELECT session_id, turn, event_type, count(*) AS n FROM seg WHERE event_type <> 'user_prompt' GROUP BY ALL) GROUP BY ALL")
def a19_turn_action_summary(s: SparkSession, d: str) -> DataFrame:
    return R.turn_action_summary(R.segment_turns(audit_events(s, d)))


@query(EV + "SELECT session_id, count(DISTINCT target) FILTER (event_type = 'file_read') AS files_read, count(DISTINCT target) FILTER (event_type = 'file_write') AS files_written, count(*) FILTER (event_type = 'command_execution') AS commands, count(*) FILTER (event_type = 'command_execution_failed') AS failures FROM ev GROUP BY 1")
def a20_session_file_sets(s: SparkSession, d: str) -> DataFrame:
    return R.session_file_sets(audit_events(s, d))


@query("WITH " + SEG + "SELECT session_id, turn, count(*) AS n_files, string_agg(f, ',' ORDER BY f) AS files FROM (SELECT DISTINCT session_id, turn, replace(target, 'hook/file:', '') AS f FROM seg WHERE event_type IN ('file_write', 'file_edit')) GROUP BY 1, 2")
def a21_turn_files_changed(s: SparkSession, d: str) -> DataFrame:
    return R.turn_files_changed(R.segment_turns(audit_events(s, d)))


@query(
    "WITH " + SEG + f""", act AS (SELECT session_id, count(DISTINCT turn) AS active_turns, count(*) AS actions FROM seg WHERE event_type <> 'user_prompt' GROUP BY 1),
    tot AS (SELECT session_id, count(*) AS events, max(event_ms) - min(event_ms) AS span FROM ev GROUP BY 1)
    SELECT session_id, coalesce(active_turns, 0) AS active_turns, coalesce(actions, 0) AS actions, events, {DURATION.format("span")} AS duration FROM tot LEFT JOIN act USING (session_id)"""
)
def a22_report_totals(s: SparkSession, d: str) -> DataFrame:
    return R.report_totals(audit_events(s, d))


@query(EV + f"SELECT {DAY} AS day, CAST(sum(settled_energy) AS BIGINT) AS energy FROM ev GROUP BY 1")
def a23_daily_energy(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).groupBy(E.day(F.col("event_ms")).cast("string").alias("day")).agg(F.sum("settled_energy").alias("energy"))


@query(EV + "SELECT session_id, count(*) AS n, CAST(sum(settled_energy) AS BIGINT) AS energy FROM ev GROUP BY 1")
def a24_session_counters(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("settled_energy").alias("energy"))


@query(EV + f"SELECT log_index, {DAY} AS day, row_number() OVER (PARTITION BY {DAY} ORDER BY event_ms, log_index) = 1 AS day_header, concat({CLOCK}, ' ', event_type, ' ', target) AS line FROM ev")
def w8_export_timeline(s: SparkSession, d: str) -> DataFrame:
    return E.export_timeline(audit_events(s, d))


@query(EV + f"SELECT count(*) AS events, min(event_ms) AS first_ms, max(event_ms) AS last_ms, CAST(sum(settled_energy) AS BIGINT) AS energy, {DURATION.format('max(event_ms) - min(event_ms)')} AS duration FROM ev")
def s10_export_header(s: SparkSession, d: str) -> DataFrame:
    return E.export_header(audit_events(s, d))


@query(EV + "SELECT concat('{\"log_index\":', log_index, ',\"id\":\"', id, '\",\"event_type\":\"', event_type, '\",\"settled_energy\":', settled_energy, '}') AS value FROM ev")
def s9_export_json(s: SparkSession, d: str) -> DataFrame:
    return E.export_json(audit_events(s, d), ["log_index", "id", "event_type", "settled_energy"])


@query(EV + f"SELECT {SEL} FROM (SELECT * FROM ev WHERE actor_id = 'u7' ORDER BY log_index DESC LIMIT 50) WHERE session_id LIKE '7-2024-01-2%'")
def s11_export_scope(s: SparkSession, d: str) -> DataFrame:
    return E.export_scope(audit_events(s, d), "u7", 50, "7-2024-01-2").select(*COLS)


@query(EV + f"SELECT {SEL} FROM ev ORDER BY log_index DESC LIMIT 500")
def l3_newest_n(s: SparkSession, d: str) -> DataFrame:
    return E.newest(audit_events(s, d), 500).select(*COLS)


@query(EV + "SELECT target, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, target")
def l4_sort_counts(s: SparkSession, d: str) -> DataFrame:
    return E.sorted_counts(E.counts(audit_events(s, d), "target"), "target")


ANCHORS = EVENTS_SQL + """, cp AS (SELECT log_index + 1 AS tree_size FROM ev WHERE (log_index + 1) % 100 = 0), an AS (SELECT tree_size FROM cp WHERE tree_size % 300 = 0)"""


def _checkpoints(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).select((F.col("log_index") + 1).alias("tree_size")).where("tree_size % 100 = 0")


@query("WITH " + ANCHORS + "SELECT cp.tree_size, min(an.tree_size) AS anchored, CASE WHEN min(an.tree_size) IS NULL THEN 'none' WHEN min(an.tree_size) = cp.tree_size THEN 'exact' ELSE 'covered' END AS status FROM cp LEFT JOIN an ON an.tree_size >= cp.tree_size GROUP BY cp.tree_size")
def j8_anchor_as_of(s: SparkSession, d: str) -> DataFrame:
    points = _checkpoints(s, d)
    return E.as_of_anchor(points, points.where("tree_size % 300 = 0"))


@query(EV + "SELECT actor_id, max(log_index) AS log_index, arg_max(session_id, log_index) AS session_id FROM ev GROUP BY 1")
def w7_latest_per_key(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).groupBy("actor_id").agg(F.max("log_index").alias("log_index"), F.max_by("session_id", "log_index").alias("session_id"))


@query(EV + "SELECT action_type, count(*) FILTER (ends_with(event_type, '_pre')) AS intents, count(*) FILTER (NOT ends_with(event_type, '_pre')) AS outcomes FROM ev GROUP BY 1")
def j6_intent_completion(s: SparkSession, d: str) -> DataFrame:
    pre = F.endswith("event_type", F.lit("_pre"))
    return audit_events(s, d).groupBy("action_type").agg(F.count_if(pre).alias("intents"), F.count_if(~pre).alias("outcomes"))


@query(EV + "SELECT e.id, e.log_index, c.n FROM ev e JOIN (SELECT id, 1 AS n FROM ev WHERE log_index % 97 = 0) c USING (id)")
def j10_event_index_lookup(s: SparkSession, d: str) -> DataFrame:
    ev = audit_events(s, d)
    return ev.select("id", "log_index").join(ev.where("log_index % 97 = 0").select("id", F.lit(1).alias("n")), "id")


@query(EV + "SELECT log_index, 1 + CASE action_type WHEN 'view' THEN 0 WHEN 'signup' THEN 10 WHEN 'purchase' THEN 15 ELSE 25 + settled_energy // 256 END + strlen(payload) // 1024 AS cost FROM ev")
def m1_energy_cost(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).select("log_index", E.energy_cost(F.col("action_type"), F.col("settled_energy"), F.col("payload"), {"view": 0, "signup": 10, "purchase": 15}).alias("cost"))


@query(EV + f"SELECT log_index, {DAY} AS day, {CLOCK} AS minute, strftime(make_timestamp(event_ms * 1000), '%-m/%-d %a') AS label, concat(left(event_hash, 8), '...', right(event_hash, 8)) AS short_hash, regexp_full_match(event_hash, '[0-9a-f]{{64}}') AS is_hex, format('{{:,}}', event_ms // 1000) AS thousands FROM ev")
def m_formats(s: SparkSession, d: str) -> DataFrame:
    """m3 times, m4 thousands, m5 short hashes, m6 day labels, m7 hex check."""
    from ..operators.integrity import is_hex64

    day = E.day(F.col("event_ms"))
    return audit_events(s, d).select(
        "log_index", day.cast("string").alias("day"), E.clock(F.col("event_ms")).alias("minute"), E.day_label(day).alias("label"),
        E.short_hash(F.col("event_hash")).alias("short_hash"), is_hex64(F.col("event_hash")).alias("is_hex"), E.thousands(F.floor(F.col("event_ms") / 1000)).alias("thousands"),
    )


@query(EV + "SELECT log_index, replace(target, 'hook/', '') AS target, array_to_string(list_slice(string_split(replace(target, 'hook/', ''), '/'), -2, -1), '/') AS short FROM ev")
def n14_short_path(s: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("target", "^hook/", "")
    return audit_events(s, d).select("log_index", bare.alias("target"), R.short_path(bare).alias("short"))


@query(EV + """SELECT log_index, CASE WHEN e > b THEN CASE WHEN (e - b) // 1000 >= 60 THEN concat((e - b) // 60000, 'm ', (e - b) // 1000 % 60, 's') ELSE concat((e - b) // 1000, 's') END WHEN b IS NOT NULL AND e IS NULL THEN 'ongoing' ELSE 'unknown' END AS report,
  CASE WHEN e > b THEN concat((e - b) // 60000, 'm ', lpad(CAST((e - b) // 1000 % 60 AS VARCHAR), 2, '0'), 's') ELSE 'unknown' END AS receipt
  FROM (SELECT log_index, CASE WHEN log_index % 7 <> 3 THEN ts_ms END AS b, CASE WHEN log_index % 5 <> 2 THEN ts_ms + (log_index % 400) * 700 - 1000 END AS e FROM ev)""")
def m2_durations(s: SparkSession, d: str) -> DataFrame:
    begin, end = F.when(F.col("log_index") % 7 != 3, F.col("ts_ms")), F.when(F.col("log_index") % 5 != 2, F.col("ts_ms") + (F.col("log_index") % 400) * 700 - 1000)
    return audit_events(s, d).select("log_index", E.report_duration(begin, end).alias("report"), E.receipt_duration(begin, end).alias("receipt"))


#: Kinds of the report that the events lack: some writes are edits, some reads are searches.
_REPORTED = "CASE WHEN event_type = 'file_write' AND log_index % 3 = 0 THEN 'file_edit' WHEN event_type = 'file_read' AND log_index % 5 = 0 THEN 'content_search' WHEN event_type = 'file_read' AND log_index % 5 = 1 THEN 'network_failed' ELSE event_type END"
_PATH, _COMMAND = "replace(target, 'hook/file:', '')", "replace(target, 'hook/bash:', '')"


def _joined(kind: str, value: str) -> str:
    return f"coalesce(string_agg({value}, '|' ORDER BY {value}) FILTER ({kind}), '')"


@query(
    f"WITH {EVENTS_SQL}, k AS (SELECT session_id, {_REPORTED} AS kind, target, {_PATH} AS path, {_COMMAND} AS command FROM ev), u AS (SELECT DISTINCT session_id, kind, path FROM k WHERE kind IN ('file_read', 'file_write', 'file_edit')),"
    + f" l AS (SELECT session_id, {_joined("kind = 'command_execution'", 'left(command, 80)')} AS commands, {_joined("kind = 'content_search'", 'left(path, 60)')} AS searches, {_joined("ends_with(kind, '_failed')", "CASE WHEN kind = 'command_execution_failed' THEN left(command, 80) ELSE concat(kind, ': ', left(path, 60)) END")} AS failures FROM k GROUP BY 1)"
    + f" SELECT session_id, {_joined("u.kind = 'file_read'", 'u.path')} AS files_read, {_joined("u.kind = 'file_write'", 'u.path')} AS files_written, {_joined("u.kind = 'file_edit'", 'u.path')} AS files_edited, any_value(commands) AS commands, any_value(searches) AS searches, any_value(failures) AS failures FROM l LEFT JOIN u USING (session_id) GROUP BY 1"
)
def a20_session_lists(s: SparkSession, d: str) -> DataFrame:
    """Lists in order, joined by |."""
    ev = audit_events(s, d)
    path, command = F.regexp_replace("target", "^hook/file:", ""), F.regexp_replace("target", "^hook/bash:", "")
    kinds = ev.select("session_id", F.expr(_REPORTED).alias("event_type"), path.alias("target"), path.alias("file_path"), command.alias("command"), F.lit(None).cast("string").alias("pattern"))
    kinds = kinds.withColumn("target", F.when(F.col("event_type").startswith("command"), F.col("command")).otherwise(F.col("target")))
    lists = R.session_lists(kinds)
    return lists.select("session_id", *(F.array_join(F.array_sort(c), "|").alias(c) for c in lists.columns if c != "session_id"))


@query(EV + "SELECT action_type, count(*) AS n, CAST(sum(settled_energy) AS BIGINT) AS energy, min(event_ms) AS first_ms, max(event_ms) AS last_ms, count(DISTINCT session_id) AS sessions FROM ev, (SELECT min(event_ms // 86400000) AS d0 FROM ev) WHERE event_ms // 86400000 BETWEEN d0 + 2 AND d0 + 20 GROUP BY 1")
def a3_range_from_partials(s: SparkSession, d: str) -> DataFrame:
    """Totals and exact distinct sessions of 19 days from daily partials, which a second run brought up to date with rows that came late."""
    root, log = scratch(s, "rollups"), audit_events(s, d)
    late = F.col("log_index") % 10 == 3
    for part in (log.where(~late), log.where(late)):
        U.update_daily(s, part.select("session_id", "action_type", "event_ms", "settled_energy"), root)
    first = log.agg(F.min(F.floor(F.col("event_ms") / U.DAY_MS))).first()[0]
    return U.totals(s, root, first + 2, first + 20)


@query(EV + "SELECT count(*) AS n, CAST(sum(settled_energy) AS BIGINT) AS energy, min(event_ms) AS first_ms, max(event_ms) AS last_ms, count(DISTINCT session_id) AS sessions FROM ev")
def a5_totals_from_partials(s: SparkSession, d: str) -> DataFrame:
    """t10 over all days, from partials of as many runs as parts of the log."""
    root, log = scratch(s, "rollups"), audit_events(s, d)
    for k in range(2):
        U.update_daily(s, log.where(F.col("log_index") % 2 == k).select("session_id", "action_type", "event_ms", "settled_energy"), root)
    return U.totals(s, root, by=())


@query(EV + "SELECT log_index, id FROM ev WHERE log_index % 3 > 0 ORDER BY log_index LIMIT 25 OFFSET 311")
def l2_page_by_rank(s: SparkSession, d: str) -> DataFrame:
    """A page far into the log, from the ranges that its rank falls in."""
    log = audit_events(s, d).where("log_index % 3 > 0").select("log_index", "id")
    return G.page_by_rank(log, "log_index", 311, 25, width=128)
