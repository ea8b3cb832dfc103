"""Audit and transcript views over the driver's tables, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event. Times are milliseconds since 1970 in UTC, whatever the session's zone."""
    return as_audit_events(table(spark, sf_dir, "events"))


def as_audit_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    wall = F.col("ts").cast("timestamp_ntz")
    ts_ms = F.unix_date(F.to_date(wall)).cast("long") * DAY_MS + F.hour(wall).cast("long") * HOUR_MS + F.minute(wall) * 60_000 + F.floor(F.extract(F.lit("SECOND"), wall) * 1000)
    kind = F.expr(
        """CASE event_type WHEN 'signup' THEN 'user_prompt' WHEN 'click' THEN 'command_execution'
           WHEN 'view' THEN IF(event_id % 3 = 0, 'file_read_pre', 'file_read') WHEN 'purchase' THEN 'file_write'
           WHEN 'error' THEN 'command_execution_failed' ELSE event_type END"""
    )
    target = F.expr(
        """CASE WHEN event_type IN ('click', 'error') THEN concat('hook/bash:', CASE event_id % 6 WHEN 0 THEN 'git push origin main' WHEN 1 THEN 'rm -rf build' WHEN 2 THEN 'ls -la /srv/project/data' ELSE 'pytest -x tests' END)
           WHEN event_type IN ('view', 'purchase') THEN concat('hook/file:/srv/u', user_id, '/f', event_id % 7, '.txt') ELSE 'hook/user:prompt' END"""
    )
    return (
        events.withColumn("ts_ms", ts_ms.cast("long"))
        .withColumn("client_ms", F.when(eid % 10 == 0, F.col("ts_ms") - 300_000))
        .select(
            eid.alias("log_index"),
            F.concat(F.lit("ev-"), eid).alias("id"),
            F.sha2(F.concat_ws("|", eid, "user_id", "event_type", F.coalesce("props", F.lit(""))), 256).alias("event_hash"),
            F.concat(F.lit("u"), "user_id").alias("actor_id"),
            F.col("event_type").alias("action_type"),
            kind.alias("event_type"),
            target.alias("target"),
            "ts_ms",
            "client_ms",
            F.coalesce("client_ms", "ts_ms").alias("event_ms"),
            F.floor("value").cast("long").alias("settled_energy"),
            F.col("props").alias("payload"),
            F.concat("user_id", F.lit("-"), day_of("ts_ms").cast("string")).alias("session_id"),
        )
    )


def day_of(ms: str):  # noqa: ANN201
    """UTC date of a millisecond column."""
    return F.date_from_unix_date(F.floor(F.col(ms) / DAY_MS).cast("int"))


EVENTS_SQL = """ev AS (
  SELECT event_id AS log_index, concat('ev-', event_id) AS id,
    sha256(concat(event_id, '|', user_id, '|', event_type, '|', coalesce(props, ''))) AS event_hash,
    concat('u', user_id) AS actor_id, event_type AS action_type,
    CASE event_type WHEN 'signup' THEN 'user_prompt' WHEN 'click' THEN 'command_execution'
      WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'file_read_pre' ELSE 'file_read' END
      WHEN 'purchase' THEN 'file_write' WHEN 'error' THEN 'command_execution_failed' ELSE event_type END AS event_type,
    CASE WHEN event_type IN ('click', 'error') THEN concat('hook/bash:', CASE event_id % 6 WHEN 0 THEN 'git push origin main' WHEN 1 THEN 'rm -rf build' WHEN 2 THEN 'ls -la /srv/project/data' ELSE 'pytest -x tests' END)
      WHEN event_type IN ('view', 'purchase') THEN concat('hook/file:/srv/u', user_id, '/f', event_id % 7, '.txt') ELSE 'hook/user:prompt' END AS target,
    epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_id % 10 = 0 THEN (epoch_us(ts) // 1000) - 300000 END AS client_ms,
    CASE WHEN event_id % 10 = 0 THEN (epoch_us(ts) // 1000) - 300000 ELSE epoch_us(ts) // 1000 END AS event_ms,
    CAST(floor(value) AS BIGINT) AS settled_energy, props AS payload,
    concat(user_id, '-', strftime(ts, '%Y-%m-%d')) AS session_id
  FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn, each with one content block; conversations are sessions."""
    c = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    kind = F.when((F.col("role") == "assistant") & (cid % 5 == 0), "reasoning").otherwise("text")
    base = c.select(
        cid.cast("string").alias("session_id"),
        F.concat(cid, F.lit(":t"), turn).alias("turn_uuid"),
        F.when(turn > 0, F.concat(cid, F.lit(":t"), turn - 1)).alias("parent_turn_uuid"),
        turn.alias("turn_order"),
        "role",
        "text",
        F.octet_length("text").cast("long").alias("byte_len"),
        F.ceil(F.length("text") / 3).cast("long").alias("output_tokens"),
        F.concat(F.lit("s"), cid % 3).alias("source"),
        F.concat(F.lit("v"), cid % 4).alias("model_variant"),
        (F.lit(1_704_067_200_000) + cid * HOUR_MS + turn * 60_000).alias("ts_ms"),
        kind.alias("kind"),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"),
        F.when(turn % 2 == 0, F.concat(F.lit("r"), cid)).alias("kernel_event_id"),
    )
    return with_derived(base)


def with_derived(turns: DataFrame) -> DataFrame:
    """Visible bytes, thinking blocks and estimated hidden tokens of one-block turns."""
    visible = F.when(F.col("kind") == "text", F.col("byte_len")).otherwise(F.lit(0).cast("long"))
    return (
        turns.withColumn("visible_bytes", visible)
        .withColumn("thinking_blocks", (F.col("kind") == "reasoning").cast("long"))
        .withColumn("hidden_tokens", F.expr("greatest(0L, coalesce(output_tokens, 0L) - ((visible_bytes + 3) div 4))"))
    )


TURNS_SQL = """tu0 AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, concat(conv_id, ':t', turn) AS turn_uuid,
    CASE WHEN turn > 0 THEN concat(conv_id, ':t', turn - 1) END AS parent_turn_uuid, turn AS turn_order, role, text,
    CAST(strlen(text) AS BIGINT) AS byte_len, CAST(ceil(length(text) / 3.0) AS BIGINT) AS output_tokens,
    concat('s', conv_id % 3) AS source, concat('v', conv_id % 4) AS model_variant,
    1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms,
    CASE WHEN role = 'assistant' AND conv_id % 5 = 0 THEN 'reasoning' ELSE 'text' END AS kind,
    concat('sha256:', sha256(text)) AS content_hash, CASE WHEN turn % 2 = 0 THEN concat('r', conv_id) END AS kernel_event_id
  FROM conversations),
tu AS (SELECT *, CASE WHEN kind = 'text' THEN byte_len ELSE 0 END AS visible_bytes, CAST(kind = 'reasoning' AS BIGINT) AS thinking_blocks,
    greatest(0, coalesce(output_tokens, 0) - (CASE WHEN kind = 'text' THEN byte_len ELSE 0 END + 3) // 4) AS hidden_tokens FROM tu0)"""
