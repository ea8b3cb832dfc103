"""Raw hook JSON to one event schema. Two dialects of tool names are known; all work is on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.governance import cut_bytes, externalize_or_inline

#: Tool names and their event types (fixed values). The second table adds the other dialect's names.
TOOLS = {
    "Bash": "command_execution",
    "Read": "file_read",
    "Write": "file_write",
    "Edit": "file_edit",
    "Glob": "file_search",
    "Grep": "content_search",
    "WebFetch": "web_request",
    "WebSearch": "web_search",
    "Task": "subagent_spawn",
}
MORE_TOOLS = {"Shell": "command_execution", "Delete": "file_delete"}
#: What a tool acts on: tools, target prefix, text before it, input field (fixed values).
SUBJECTS = (
    (("Bash", "Shell"), "bash", "Execute command", "command"),
    (("Read",), "file", "Read file", "file_path"),
    (("Write",), "file", "Write file", "file_path"),
    (("Edit",), "file", "Edit file", "file_path"),
    (("Delete",), "file", "Delete file", "file_path"),
    (("Glob",), "glob", "Glob pattern", "pattern"),
    (("Grep",), "grep", "Grep pattern", "pattern"),
    (("WebFetch",), "url", "Fetch URL", "url"),
    (("WebSearch",), "search", "Web search", "query"),
    (("Task",), "task", "Spawn subagent", "subagent_type"),
)
#: Lifecycle hooks: event type, target, field that ends the target (if any), what it is when absent, fields kept (fixed values).
LIFECYCLE = {
    "SessionStart": ("session_start", "session:SessionStart", None, "", ("source",)),
    "SessionEnd": ("session_end", "session:SessionEnd", None, "", ("reason",)),
    "Stop": ("agent_stop", "session:Stop", None, "", ()),
    "SubagentStart": ("subagent_start", "subagent:", "agent_type", "unknown", ("agent_id", "agent_type")),
    "SubagentStop": ("subagent_stop", "subagent:", "agent_type", "unknown", ("agent_id", "agent_type")),
    "Notification": ("notification", "notification:", "notification_type", "unknown", ("message", "title")),
    "InstructionsLoaded": ("instructions_loaded", "instructions:", "memory_type", "unknown", ("file_path", "load_reason")),
    "PreCompact": ("pre_compact", "compact:pre:", "trigger", "unknown", ("trigger",)),
    "PostCompact": ("post_compact", "compact:post:", "trigger", "unknown", ("trigger",)),
    "StopFailure": ("stop_failure", "session:StopFailure:", "error_type", "unknown", ("error_type",)),
    "PermissionDenied": ("permission_denied", "permission_denied:", "tool_name", "unknown", ("tool_name", "reason")),
    "PermissionRequest": ("permission_request", "permission_request:", "tool_name", "unknown", ("tool_name",)),
    "Elicitation": ("elicitation", "elicitation:", "server", "unknown", ("server",)),
    "ElicitationResult": ("elicitation_result", "elicitation_result:", "server", "unknown", ("server",)),
    "MessageDisplay": ("message_display", "message:display", None, "", ()),
    "UserPromptSubmit": ("user_prompt", "user:prompt", None, "", ()),
}
ENRICH = ("prompt_id", "permission_mode", "agent_id", "agent_type", "effort", "model", "cwd", "session_id")


def field(raw: Column, name: str) -> Column:
    return F.get_json_object(raw, f"$.{name}")


def strip_bom(raw: Column) -> Column:
    return F.regexp_replace(raw, "^﻿", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def event_type(tool: Column, hook: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in (TOOLS | MORE_TOOLS).items() for x in pair))
    base = F.when(F.startswith(tool, F.lit("mcp__")) | F.startswith(tool, F.lit("MCP:")), "mcp_tool_call").otherwise(F.coalesce(F.element_at(known, tool), F.lit("tool_call")))
    suffix = F.when(F.lower(hook) == "pretooluse", "_pre").when(F.lower(hook) == "posttoolusefailure", "_failed").otherwise("")
    return F.concat(base, suffix)


def _by_subject(tool: Column, raw: Column, one, other: Column) -> Column:  # noqa: ANN001
    out = other
    for tools, prefix, words, name in SUBJECTS:
        value = F.coalesce(field(raw, f"tool_input.{name}"), F.lit(""))
        out = F.when(tool.isin(*tools), one(prefix, words, value)).otherwise(out)
    return out


def target(tool: Column, raw: Column) -> Column:
    other = F.when(F.startswith(tool, F.lit("mcp__")) | F.startswith(tool, F.lit("MCP:")), F.concat(F.lit("mcp:"), tool)).otherwise(F.concat(F.lit("tool:"), tool))
    return _by_subject(tool, raw, lambda prefix, _, v: F.concat(F.lit(prefix + ":"), cut_bytes(v, 100) if prefix == "bash" else v), other)


def content(tool: Column, raw: Column) -> Column:
    return _by_subject(tool, raw, lambda _, words, v: F.concat(F.lit(words + ": "), v), F.concat(F.lit("Tool call: "), tool))


def metadata(raw: Column, names: tuple[str, ...] = ENRICH) -> Column:
    """A map of those fields that are present."""
    return F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), field(raw, n)))), lambda _, v: v.isNotNull())


def response(raw: Column, mode: str = "summary") -> Column:
    """What is kept of a tool's response: all of it, nothing, or whether there is one and its exit code."""
    whole = field(raw, "tool_response")
    if mode == "none":
        return F.lit(None).cast("string")
    if mode == "full":
        return whole
    return F.to_json(F.struct(whole.isNotNull().alias("has_response"), field(raw, "tool_response.exit_code").cast("int").alias("exit_code")))


def normalize_tool_events(df: DataFrame, raw: str, source: str, mode: str = "summary") -> DataFrame:
    """Adds event_type, target, content, metadata, response and source to rows of tool hooks."""
    parsed = df.withColumn("_clean", strip_bom(F.col(raw))).withColumns({"_tool": F.coalesce(field(F.col("_clean"), "tool_name"), F.lit("unknown")), "_hook": field(F.col("_clean"), "hook_event_name")})
    clean, tool, hook = F.col("_clean"), F.col("_tool"), F.col("_hook")
    return parsed.withColumns({"event_type": event_type(tool, hook), "target": target(tool, clean), "content": content(tool, clean), "metadata": metadata(clean), "response": response(clean, mode), "source": F.lit(source)}).drop("_clean", "_tool", "_hook")


def normalize_lifecycle(df: DataFrame, raw: str, source: str) -> DataFrame:
    """The same for lifecycle hooks; elicitation answers and displayed messages leave their byte length alone. Rows of other hooks are dropped.

    The hook's name is a column of its own, so that it is read once a row, and a field only where the hook has it.
    """
    parsed = df.withColumn("_clean", strip_bom(F.col(raw))).withColumn("_hook", field(F.col("_clean"), "hook_event_name")).where(F.col("_hook").isin(*LIFECYCLE))
    clean, hook = F.col("_clean"), F.col("_hook")
    kind = aim = F.lit(None).cast("string")
    for name, (etype, prefix, last, missing, _) in LIFECYCLE.items():
        own = hook == name
        kind = F.when(own, etype).otherwise(kind)
        aim = F.when(own, F.concat(F.lit(prefix), F.coalesce(field(clean, last), F.lit(missing))) if last else F.lit(prefix)).otherwise(aim)
    having = lambda n: [h for h, (*_, names) in LIFECYCLE.items() if n in names]
    every = sorted({n for *_, names in LIFECYCLE.values() for n in names})
    fields = F.map_filter(F.create_map(*(x for n in every for x in (F.lit(n), F.when(hook.isin(*having(n)), field(clean, n))))), lambda _, v: v.isNotNull())
    length = F.when(hook == "ElicitationResult", F.octet_length(F.coalesce(field(clean, "content"), F.lit("")))).when(hook == "MessageDisplay", F.octet_length(F.coalesce(field(clean, "message"), F.lit(""))))
    return parsed.withColumns({"event_type": kind, "target": aim, "metadata": fields, "byte_len": length.cast("long"), "source": F.lit(source)}).drop("_clean", "_hook")


def prompt_metadata(df: DataFrame, raw: str, most: int = 4096) -> DataFrame:
    """Prompt bodies inline or by reference."""
    body = F.coalesce(field(strip_bom(F.col(raw)), "prompt"), F.lit(""))
    return df.withColumn("prompt_body", externalize_or_inline(body, "prompt", most))


def submit_payload(df: DataFrame) -> DataFrame:
    """The shape in which events are sent: target under ``hook/``, action observe."""
    return df.withColumns({"target": F.concat(F.lit("hook/"), "target"), "action_type": F.lit("observe")})


def image_blocks(blocks: Column) -> Column:
    """Of an array of blocks (type, media_type, data): media type, length of the base64 text and about how many bytes it stands for, for images alone."""
    size = lambda b: F.length(b["data"]).cast("long")
    return F.transform(F.filter(blocks, lambda b: b["type"] == "image"), lambda b: F.struct(b["media_type"].alias("media_type"), size(b).alias("b64_len"), F.floor(size(b) * 3 / 4).alias("approx_bytes")))


def drop_second_hand(df: DataFrame, raw: str, version_field: str) -> DataFrame:
    """Rows that the other tool passed on (they carry its version) are dropped: their own tool records them first-hand."""
    return df.where(field(F.col(raw), version_field).isNull())
