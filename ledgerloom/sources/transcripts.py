"""Readers of raw transcript, rollout, event-log and spillover files, and the writers of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsonl import MAYBE_FLOAT, blank


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """path, block, line number within the task (ordering only) and value of each line of all files below path (or of the paths)."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def with_offsets(lines: DataFrame) -> DataFrame:
    """Adds offset, the byte at which a line starts. Two levels: sums by block, then within each block, so that one huge file is many tasks.

    Lines that have a column size (bytes with the line end) need no value, so that texts need not move.
    """
    size = F.col("size") if "size" in lines.columns else F.octet_length("value").cast("long") + 1
    inside = Window.partitionBy("path", "block").orderBy("at")
    blocks = lines.groupBy("path", "block").agg(F.sum(size).alias("bytes"))
    starts = blocks.withColumn("start", F.sum("bytes").over(Window.partitionBy("path").orderBy("block")) - F.col("bytes")).drop("bytes")
    own = lines.withColumn("before", F.sum(size).over(inside) - size)
    return own.join(starts, ["path", "block"]).withColumn("offset", F.col("start") + F.col("before")).drop("start", "before", "at", "block")


def measured(lines: DataFrame) -> DataFrame:
    """Lines with their size in bytes, line end included, and whether they are blank."""
    return lines.withColumns({"size": F.octet_length("value").cast("long") + 1, "blank": blank(F.col("value"))})


def file_stats(lines: DataFrame) -> DataFrame:
    """By file (lines: path, offset, size, blank, bad): lines that are not blank, bad ones, whether the first is bad, and where the file ends."""
    return lines.groupBy("path").agg(
        F.count_if(~F.col("blank")).alias("lines"), F.count_if(~F.col("blank") & F.col("bad")).alias("bad_lines"), F.coalesce(F.min_by("bad", F.when(~F.col("blank"), F.col("offset"))), F.lit(False)).alias("first_bad"), F.max(F.col("offset") + F.col("size")).alias("scanned_to")
    )


def drop_corrupt_files(entries: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Files whose first non-blank line can't be read are skipped; of others, only the bad lines. Needs path, offset, size, blank, bad."""
    stats = file_stats(entries) if stats is None else stats
    return entries.join(stats.where("first_bad").select("path"), "path", "left_anti").where("NOT bad AND NOT blank")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines with their JSON value v (a variant), and whether they are none."""
    return lines.withColumn("v", F.try_parse_json(F.regexp_replace("value", "\r$", ""))).withColumn("bad", F.col("v").isNull())


def entry(v: Column, text: Column | None = None) -> Column:
    """The fields of an assistant or user entry (a variant, and its text) with a message, role, the message (a variant), and the content's JSON where the text holds a number that is not whole, as a variant does not keep its form; null for other entries, user entries of tool results alone, and entries without uuid, session or time."""
    at = lambda where, kind="string": F.try_variant_get(v, f"$.{where}", kind)
    names = {"type": "type", "uuid": "uuid", "parentUuid": "parentUuid", "sessionId": "sessionId", "timestamp": "timestamp", "cwd": "cwd", "gitBranch": "git_branch", "slug": "slug", "version": "version", "requestId": "request_id"}
    parts = F.try_variant_get(v, "$.message.content", "array<variant>")
    exact = F.lit(None).cast("string") if text is None else F.when(text.rlike(MAYBE_FLOAT), F.get_json_object(text, "$.message.content"))
    only_results = (at("type") == "user") & (F.size(parts) > 0) & F.forall(parts, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False)))
    turn = at("type").isin("assistant", "user") & at("uuid").isNotNull() & at("sessionId").isNotNull() & at("timestamp").isNotNull() & F.startswith(F.schema_of_variant(at("message", "variant")), F.lit("OBJECT"))
    fields = F.struct(*(at(k).alias(name) for k, name in names.items()), F.coalesce(at("isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"), at("message", "variant").alias("message"), F.coalesce(at("message.role"), at("type")).alias("role"), exact.alias("content_json"))
    return F.when(turn & ~F.coalesce(only_results, F.lit(False)), fields)


def scan_transcripts(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """The entries that are turns, of all files below path: path, offset, the entry's fields, role and message (a variant)."""
    kept = drop_corrupt_files(parsed_lines(with_offsets(measured(read_lines(spark, path, glob)))))
    return kept.select("path", "offset", entry(F.col("v"), F.col("value")).alias("e")).where("e IS NOT NULL").select("path", "offset", "e.*")


def scan_rollouts(spark: SparkSession, path: str, glob: str = "rollout-*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Items (path, offset, timestamp, type, payload JSON text), and by file how many lines could not be read. Broken UTF-8 is read leniently."""
    lines = with_offsets(read_lines(spark, path, glob)).withColumn("value", F.make_valid_utf8("value")).where(~blank(F.col("value")))
    parsed = lines.withColumn("bad", F.try_parse_json("value").isNull())
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    items = parsed.where("NOT bad").select("path", "offset", field("timestamp"), field("type"), field("payload"))
    return items, parsed.groupBy("path").agg(F.count_if("bad").alias("skipped"))


def changed_files(spark: SparkSession, path: str, glob: str, state: DataFrame) -> list[str]:
    """Files below path that are new or longer than what is scanned of them (state: path, scanned_to). Only names and sizes are read; a read of the files holds their names on the driver anyway."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    same = F.regexp_replace("path", "^file:/+", "/").alias("_same")
    files = listed.select("path", "length", same).join(state.select(same, "scanned_to"), "_same", "left")
    return [r.path for r in files.where("scanned_to IS NULL OR length > scanned_to").select("path").collect()]


def incremental_scan(spark: SparkSession, path: str, glob: str, state: DataFrame) -> DataFrame:
    """Lines with offsets after what is scanned, from files that have grown or are new. Files that have not changed are not opened."""
    changed = changed_files(spark, path, glob, state)
    if not changed:
        return spark.createDataFrame([], "path string, file_name string, value string, offset long")
    return new_lines(with_offsets(read_lines(spark, changed, glob)), state)


def new_lines(lines: DataFrame, state: DataFrame) -> DataFrame:
    """Of lines with offsets, those at or after the saved end of their file; lines of unknown files all count. A saved end inside a line drops the rest of that line."""
    return lines.join(state.select("path", "scanned_to"), "path", "left").where(F.col("scanned_to").isNull() | (F.col("offset") >= F.col("scanned_to"))).drop("scanned_to")


def path_session_id(file_name: Column) -> Column:
    """The uuid of ``rollout-<time>-<uuid>.jsonl``; else the rest of the stem."""
    stem = F.regexp_replace(file_name, r"\.jsonl$", "")
    found = F.regexp_extract(stem, r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(stem, "^rollout-", ""))


def only_session(lines: DataFrame, session: str) -> DataFrame:
    """Files whose stem is the session id, or that lie in a folder of that name."""
    return lines.where((F.regexp_replace("file_name", r"\.jsonl$", "") == session) | F.contains("path", F.lit(f"/{session}/")))


def read_spillover(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Replayed events; unreadable lines come with a null row and their text in _corrupt_record; blank lines do not come at all."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def dry_run(entries: DataFrame) -> DataFrame:
    """What an index run would take, without a write."""
    return entries.agg(F.countDistinct("path").alias("files"), F.countDistinct("sessionId").alias("sessions"), F.count(F.lit(1)).alias("turns"))


def upsert_sessions(rows: DataFrame, path: str, buckets: int = 16) -> None:
    """Replaces the buckets of the sessions in rows: dynamic overwrite of partitions by session bucket. rows must hold all sessions of the buckets they touch."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_into(spark: SparkSession, fresh: DataFrame, stored: str, target: str, buckets: int = 16) -> None:
    """Per-session replacement: sessions in fresh take the place of their stored rows, others stay; written to target."""
    old = spark.read.parquet(stored)
    stay = old.join(fresh.select("session_id").distinct(), "session_id", "left_anti").drop("bucket")
    upsert_sessions(stay.unionByName(fresh, allowMissingColumns=True), target, buckets)


def append_notes(notes: DataFrame, path: str) -> None:
    """Appends user notes (content, and event_type, source and metadata where given) to the log at path."""
    given = lambda name, default, kind="string": (F.coalesce(F.col(name), F.lit(default)) if name in notes.columns else F.lit(default)).cast(kind).alias(name)
    row = notes.select(F.lit("note-v1").alias("schema"), given("event_type", "note"), "content", given("source", "library"), given("metadata", None, "map<string, string>"))
    row.write.mode("append").parquet(path)


def append_note(spark: SparkSession, path: str, content: str, event_type: str = "note", source: str = "library", metadata: dict[str, str] | None = None) -> None:
    """Appends one user note to the log at path."""
    append_notes(spark.createDataFrame([(event_type, content, source, metadata)], "event_type string, content string, source string, metadata map<string, string>"), path)
