"""Blocks of rollout items (JSON payloads told apart by their type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.segments import carried, islands
from .jsonl import blank as is_blank

BLOCKS = "array<struct<kind: string, role: string, tool_name: string, byte_len: bigint>>"
PART = "array<struct<type: string, text: string, image_url: string>>"
#: Items that are one block: kind, role, fixed tool name, fields whose text is measured (fixed values).
SINGLE = {
    "reasoning": ("reasoning", "assistant", None, "encrypted_content"),
    "function_call": ("tool_call", "assistant", None, "arguments"),
    "custom_tool_call": ("tool_call", "assistant", None, "input"),
    "function_call_output": ("tool_result", "tool", None, "output"),
    "custom_tool_call_output": ("tool_result", "tool", None, "output"),
    "web_search_call": ("tool_call", "assistant", "web_search", "action"),
    "tool_search_call": ("tool_call", "assistant", "tool_search", None),
    "tool_search_output": ("tool_result", "tool", None, None),
    "image_generation_call": ("image", "assistant", "image_generation", None),
}
#: Kinds of message parts (fixed values).
PARTS = {"input_text": "input_text", "output_text": "output_text", "input_image": "image"}


def value_to_text(payload: Column, name: str) -> Column:
    """A field as text: strings as they are, null and absent as empty, everything else as JSON."""
    return F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit(""))


#: Fields without which an item of a known type cannot be read (fixed values).
REQUIRED = {"message": ("role", "content"), "function_call": ("call_id", "name", "arguments"), "custom_tool_call": ("call_id", "name", "input"), "function_call_output": ("call_id",), "custom_tool_call_output": ("call_id",)}
KNOWN_ITEMS = ("message", *SINGLE, "ghost_snapshot")


def item_blocks(p: Column) -> Column:
    """The blocks of an item's payload (JSON text): kind, role, tool_name, byte_len. No body is kept; unknown parts are skipped; null for snapshots and unknown items."""
    own = F.get_json_object(p, "$.type")
    role = F.get_json_object(p, "$.role")
    size = lambda text: F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    block = lambda kind, role, tool, n: F.struct(kind.alias("kind"), role.alias("role"), tool.alias("tool_name"), n.alias("byte_len"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    kinds = F.create_map(*(F.lit(x) for pair in PARTS.items() for x in pair))
    parts = F.filter(F.from_json(F.get_json_object(p, "$.content"), PART), lambda x: F.element_at(kinds, x["type"]).isNotNull())
    message = F.transform(parts, lambda x: block(F.element_at(kinds, x["type"]), role, none, size(F.when(x["type"] == "input_image", x["image_url"]).otherwise(x["text"]))))
    blocks = F.when(own == "message", message)
    for name, (kind, who, tool, field) in SINGLE.items():
        named = F.lit(tool) if tool else F.get_json_object(p, "$.name") if kind == "tool_call" else none
        blocks = blocks.when(own == name, F.array(block(F.lit(kind), F.lit(who), named.cast("string"), size(value_to_text(p, field)) if field else zero)))
    return blocks


def rollout_blocks(items: DataFrame, payload: str = "payload") -> DataFrame:
    """A row a block with its place in the item: part, kind, role, tool_name, byte_len."""
    return items.select("*", F.posexplode(item_blocks(F.col(payload))).alias("part", "b")).select(*items.columns, "part", "b.*")


#: Bytes of a file that one task orders at a time.
RANGE_BYTES = 1 << 24


def numbered_items(items: DataFrame, session: Column) -> DataFrame:
    """Items of rollout files (path, offset, timestamp, type, payload) with the turn that each belongs to: session_id, path, offset, timestamp, own, items (blocks), n (blocks), island, upto (blocks of the island up to the row), turn, model, cwd and git_branch as known at the row.

    A user or developer message is a turn of its own and ends the assistant's; everything between
    merges into one assistant turn. Snapshots and unknown items count for nothing, messages without
    readable parts make no turn, and turns are numbered as they come; turn is of no meaning for rows
    without blocks. Model and directory are carried on from turn contexts (each where it names one), directory
    and branch from session metadata. The first session_meta names the session, else ``session`` does. A
    file is many tasks, of RANGE_BYTES each.
    """
    p, kind = F.col("payload"), F.col("type")
    at = lambda where: F.get_json_object(p, f"$.{where}")
    named = at("role")
    meta = (kind == "session_meta") & at("id").isNotNull()
    context = meta | (kind == "turn_context")
    blocks = F.when(kind == "response_item", item_blocks(p))
    read = items.where("type IN ('response_item', 'turn_context', 'session_meta')").select(
        session.alias("session_id"), "path", "offset", "timestamp", F.coalesce(context, F.lit(False)).alias("context"), blocks.alias("items"),
        F.when((kind == "response_item") & (at("type") == "message") & named.isin("user", "developer"), named).alias("own"),
        F.when(kind == "turn_context", at("model")).alias("model"),
        F.when(meta | ((kind == "turn_context") & at("cwd").isNotNull()), F.struct(at("cwd").alias("value"))).alias("cwd"),
        F.when(meta & at("git").isNotNull(), F.struct(at("git.branch").alias("value"))).alias("git_branch"),
        F.when(meta, at("id")).alias("meta_id"),
    )
    first = read.where("meta_id IS NOT NULL").groupBy("path").agg(F.min_by("meta_id", "offset").alias("meta_id"))
    kept = read.where("context OR own IS NOT NULL OR size(items) > 0").withColumn("n", F.when(F.size("items") > 0, F.size("items")).otherwise(0).cast("long"))
    placed = islands(kept.drop("meta_id"), ["path"], "offset", F.col("own").isNotNull(), "island", lasts={c: F.col(c) for c in ("model", "cwd", "git_branch")}, width=RANGE_BYTES)
    counted = carried(placed, ["path", "island"], "offset", sums={"upto": F.col("n")}, width=RANGE_BYTES)
    starts = ((F.col("n") > 0) & (F.col("upto") == F.col("n"))).cast("long")
    numbered = carried(counted, ["path"], "offset", sums={"turn": starts}, width=RANGE_BYTES)
    named = numbered.join(first, "path", "left").withColumns({"turn": F.col("turn") - 1, "session_id": F.coalesce("meta_id", "session_id"), "cwd": F.col("cwd.value"), "git_branch": F.col("git_branch.value")})
    return named.drop("meta_id")


def turn_rows(numbered: DataFrame) -> DataFrame:
    """A row a turn of numbered items: session_id, path, turn, turn_uuid, offset (of its first block), role, timestamp (of its first item), model, cwd, git_branch, blocks and bytes. Model, directory and branch are the last that were known before the turn ended."""
    size = F.aggregate(F.coalesce("items", F.array().cast(BLOCKS)), F.lit(0).cast("long"), lambda total, b: total + b["byte_len"])
    item = F.when(~F.col("context"), F.col("offset"))
    last = lambda c: F.max_by(c, "offset").alias(c)
    turns = numbered.groupBy("session_id", "path", "island").agg(
        F.max(F.when(F.col("n") > 0, F.col("turn"))).alias("turn"), F.min(F.when(F.col("n") > 0, F.col("offset"))).alias("offset"), F.coalesce(F.max("own"), F.lit("assistant")).alias("role"),
        F.min_by("timestamp", item).alias("timestamp"), last("model"), last("cwd"), last("git_branch"), F.sum("n").alias("blocks"), F.sum(size).alias("bytes"),
    ).where("blocks > 0")
    return turns.withColumn("turn_uuid", F.concat("session_id", F.lit(":t"), "turn")).drop("island")


def turn_blocks(numbered: DataFrame) -> DataFrame:
    """A row a block of numbered items: turn_uuid, session_id, block_index, kind, role, tool_name, byte_len."""
    placed = numbered.where("n > 0").select(F.concat("session_id", F.lit(":t"), "turn").alias("turn_uuid"), "session_id", (F.col("upto") - F.col("n")).alias("_first"), F.posexplode("items").alias("_part", "b"))
    return placed.select("turn_uuid", "session_id", (F.col("_first") + F.col("_part")).cast("int").alias("block_index"), "b.*")


def grouped_turns(items: DataFrame, session: Column) -> DataFrame:
    """Turns of rollout files (items: path, offset, timestamp, type, payload): session_id, turn, turn_uuid, role, timestamp, model, blocks and bytes."""
    return turn_rows(numbered_items(items, session)).select("session_id", "role", "timestamp", "model", "blocks", "bytes", "turn", "turn_uuid")


def shape_profile(lines: DataFrame) -> DataFrame:
    """Counts (dim, value, n) over raw lines of rollouts (value), in one pass: line (blank, unparseable, parsed), envelope, item, unknown_item, typed_failure (an item of a known type without a field that it needs), role, part."""
    v = F.col("value")
    blank = is_blank(v)
    bad = F.try_parse_json(v).isNull()
    kind = F.get_json_object(v, "$.type")
    item = F.when(kind == "response_item", F.get_json_object(v, "$.payload.type"))
    one = lambda dim, value: F.array(F.struct(F.lit(dim).alias("dim"), value.alias("value")))
    lacks = F.lit(False)
    for name, fields in REQUIRED.items():
        missing = F.lit(False)
        for field in fields:
            missing = missing | F.get_json_object(v, f"$.payload.{field}").isNull()
        lacks = lacks | ((item == name) & missing)
    parts = F.when(item == "message", F.from_json(F.get_json_object(v, "$.payload.content"), PART))
    part = F.transform(F.coalesce(parts, F.array().cast(PART)), lambda x: F.struct(F.lit("part").alias("dim"), F.when(x["type"].isin(*PARTS), x["type"]).otherwise("unknown").alias("value")))
    line = F.when(blank, "blank").when(bad, "unparseable").otherwise("parsed")
    every = F.concat(
        one("line", line), one("envelope", kind), one("item", item), one("unknown_item", F.when(~item.isin(*KNOWN_ITEMS), item)),
        one("typed_failure", F.when(lacks, item)), one("role", F.when(item == "message", F.get_json_object(v, "$.payload.role"))), part,
    )
    pairs = lines.select(F.explode(F.filter(F.when(blank | bad, one("line", line)).otherwise(every), lambda x: x["value"].isNotNull())).alias("p"))
    return pairs.groupBy("p.dim", "p.value").agg(F.count(F.lit(1)).alias("n"))


def reasoning_profile(items: DataFrame) -> DataFrame:
    """Reasoning items, those with encrypted content, and those with a summary (items: type, payload)."""
    p = F.col("payload")
    own = (F.col("type") == "response_item") & (F.get_json_object(p, "$.type") == "reasoning")
    summary = F.from_json(F.get_json_object(p, "$.summary"), "array<string>")
    return items.agg(F.count_if(own).alias("reasoning"), F.count_if(own & (F.coalesce(F.get_json_object(p, "$.encrypted_content"), F.lit("")) != "")).alias("with_content"), F.count_if(own & (F.size(summary) > 0)).alias("with_summary"))


def source_tag(tool: Column, version: Column) -> Column:
    """``tool version``, or the tool alone where the version is unknown."""
    return F.concat_ws(" ", tool, version)


def turn_content_rows(turns: DataFrame, blocks: str = "blocks") -> DataFrame:
    """One row a block of the turns that were captured in full; opaque blocks have no hash."""
    full = turns.where("capture = 'full'")
    return full.select("turn_uuid", F.posexplode(blocks).alias("block_index", "b")).select("turn_uuid", "block_index", "b.kind", F.when(F.col("b.kind") != "reasoning", F.col("b.content_hash")).alias("content_hash"), "b.byte_len")
