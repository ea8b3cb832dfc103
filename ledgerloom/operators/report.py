"""Session reports: turn segmentation and what happened in each turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import duration_text
from .segments import carried


def segment_turns(df: DataFrame) -> DataFrame:
    """Adds turn: a user_prompt opens one, later events join it, those before the first are turn 0. Intents (``_pre``) and session ends are dropped. A session is many tasks."""
    marked = carried(df, ["session_id"], "log_index", sums={"turn": (F.col("event_type") == "user_prompt").cast("long")})
    return marked.where(~F.endswith("event_type", F.lit("_pre")) & ~F.col("event_type").isin("session_start", "session_end"))


def turn_action_summary(segmented: DataFrame) -> DataFrame:
    """A line a turn: ``type xN`` in type order, joined by " | "."""
    per_type = segmented.where("event_type <> 'user_prompt'").groupBy("session_id", "turn", "event_type").agg(F.count(F.lit(1)).alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit(" x"), x["n"])), " | ")
    return per_type.groupBy("session_id", "turn").agg(line.alias("actions"))


def session_file_sets(df: DataFrame) -> DataFrame:
    """Distinct files read and written, commands and failures by session."""
    path = F.regexp_replace("target", "^hook/file:", "")
    command = F.regexp_replace("target", "^hook/bash:", "")
    one = lambda kind, value: F.when(F.col("event_type") == kind, value)
    return df.groupBy("session_id").agg(
        F.countDistinct(one("file_read", path)).alias("files_read"),
        F.countDistinct(one("file_write", path)).alias("files_written"),
        F.count(one("command_execution", command)).alias("commands"),
        F.count(one("command_execution_failed", command)).alias("failures"),
    )


def session_lists(actions: DataFrame) -> DataFrame:
    """By session, the files read, written and edited (each once), and the commands, searches and failures.

    actions: session_id, event_type, target, and file_path, command and pattern of the tool's input
    where there are any. A search without a pattern is named by its target, a failure by its command
    or else its kind and target. Repeated paths go before they are gathered.
    """
    kind = F.col("event_type")
    cut = lambda c, n: F.left(c, F.lit(n))
    searched = F.coalesce("pattern", F.regexp_replace("target", "^search:", ""))
    value = (
        F.when(kind.isin("file_read", "file_write", "file_edit"), F.col("file_path"))
        .when(kind == "command_execution", cut(F.col("command"), 80))
        .when(kind.isin("content_search", "web_search"), cut(searched, 60))
        .when(kind == "command_execution_failed", cut(F.coalesce("command", "target"), 80))
        .when(F.endswith(kind, F.lit("_failed")), F.concat(kind, F.lit(": "), cut(F.col("target"), 60)))
    )
    name = (
        F.when(kind == "file_read", "files_read").when(kind == "file_write", "files_written").when(kind == "file_edit", "files_edited").when(kind == "command_execution", "commands")
        .when(kind.isin("content_search", "web_search"), "searches").when(F.endswith(kind, F.lit("_failed")), "failures")
    )
    named = actions.select("session_id", name.alias("list"), value.alias("value"))
    counted = named.groupBy("session_id", "list", "value").agg(F.count(F.lit(1)).alias("n"))
    times = F.when(F.startswith("list", F.lit("files")), F.lit(1)).otherwise(F.col("n")).cast("int")
    gathered = counted.groupBy("session_id").agg(*(F.flatten(F.collect_list(F.when((F.col("list") == one) & F.col("value").isNotNull(), F.array_repeat("value", times)))).alias(one) for one in ("files_read", "files_written", "files_edited", "commands", "searches", "failures")))
    return gathered


def turn_files_changed(segmented: DataFrame) -> DataFrame:
    changed = segmented.where(F.col("event_type").isin("file_write", "file_edit")).groupBy("session_id", "turn").agg(F.collect_set(F.regexp_replace("target", "^hook/file:", "")).alias("files"))
    return changed.select("session_id", "turn", F.size("files").cast("long").alias("n_files"), F.array_join(F.array_sort("files"), ",").alias("files"))


def report_totals(df: DataFrame) -> DataFrame:
    """Turns with actions, actions, events and duration by session."""
    segmented = segment_turns(df).where("event_type <> 'user_prompt'")
    acts = segmented.groupBy("session_id").agg(F.countDistinct("turn").alias("active_turns"), F.count(F.lit(1)).alias("actions"))
    every = df.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), (F.max("event_ms") - F.min("event_ms")).alias("span_ms"))
    return every.join(acts, "session_id", "left").select("session_id", F.coalesce("active_turns", F.lit(0)).alias("active_turns"), F.coalesce("actions", F.lit(0)).alias("actions"), "events", duration_text(F.col("span_ms")).alias("duration"))


def short_path(path):  # noqa: ANN001, ANN201
    """The last two parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), -F.least(F.lit(2), F.size(F.split(path, "/"))), 2), "/")
