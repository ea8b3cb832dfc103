"""The index of transcripts: entries to blocks, turns, sessions and signatures. No body of a block is kept, only its size."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rollout as R
from ..functions.jsonl import blank, compact_bytes
from ..functions.scratch import discard
from ..functions.signatures import ascii_runs, decode_base64, variant_by_priority
from ..sources import transcripts as S
from ..sources.index_store import Store, Version
from ..sources.tail import listed, parts, read_tail
from .turns import composite_order, first_write_wins, preserve_receipts

#: Kinds of blocks that are kept, those whose bytes are visible text or tool use, and those of reasoning (fixed values).
KINDS = ("text", "tool_use", "tool_result", "thinking")
TEXT_KINDS = ("text", "input_text", "output_text")
TOOL_KINDS = ("tool_use", "tool_call")
THINKING_KINDS = ("thinking", "reasoning")
TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
#: Names of the token counters in an entry's usage (fixed values).
USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens"}


def content_blocks(content: Column, patterns: Sequence[str], exact: Column | None = None) -> Column:
    """Blocks of a content array (variant), in order: kind, tool_name, byte_len, is_error, signature, variant. Content that is no array has none; unknown kinds are skipped.

    Sizes: texts and reasoning in UTF-8 bytes, tool inputs and results as their compact JSON. The
    variant is the first of ``patterns`` that a printable run of the signature holds. ``exact`` is the
    content's JSON where it holds numbers that are not whole, which a variant prints in another form.
    """
    exact = F.lit(None).cast("string") if exact is None else exact
    texts = F.from_json(exact, "array<string>")
    at = lambda b, where, kind="string": F.try_variant_get(b, f"$.{where}", kind)

    def block(pair: Column) -> Column:
        b, text = pair["b"], pair["text"]
        kind, signature = at(b, "type"), at(b, "signature")
        compact = lambda where: F.coalesce(compact_bytes(F.get_json_object(text, f"$.{where}")), F.octet_length(F.to_json(at(b, where, "variant"))))
        size = (
            F.when(kind == "text", F.octet_length(at(b, "text")))
            .when(kind == "tool_use", F.when(text.isNull(), F.octet_length(F.to_json(at(b, "input", "variant")))).otherwise(compact("input")))
            .when(kind == "tool_result", F.when(text.isNull() | F.startswith(F.schema_of_variant(at(b, "content", "variant")), F.lit("STRING")), F.octet_length(F.to_json(at(b, "content", "variant")))).otherwise(compact("content")))
            .when(kind == "thinking", F.octet_length(at(b, "thinking")))
        )
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "tool_use", F.coalesce(at(b, "name"), F.lit(""))).alias("tool_name"),
            F.coalesce(size, F.lit(0)).cast("long").alias("byte_len"),
            F.when(kind == "tool_result", F.coalesce(at(b, "is_error", "boolean"), F.lit(False))).alias("is_error"),
            F.when(kind == "thinking", F.coalesce(signature, F.lit(""))).alias("signature"),
            F.when((kind == "thinking") & (signature != ""), variant_by_priority(ascii_runs(decode_base64(signature)), patterns)).alias("variant"),
        )

    every = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    paired = F.transform(every, lambda b, i: F.struct(b.alias("b"), F.get(texts, i).alias("text")))
    return F.transform(F.filter(paired, lambda p: at(p["b"], "type").isin(*KINDS)), block)


def usage_fields(message: Column) -> list[Column]:
    """The four token counters; null where absent or no count."""
    value = lambda name: F.try_variant_get(message, f"$.usage.{name}", "bigint")
    return [F.when(value(name) >= 0, value(name)).alias(column) for column, name in USAGE.items()]


def _bytes_of(blocks: Column, kinds: Sequence[str]) -> Column:
    return F.aggregate(F.filter(blocks, lambda b: b["kind"].isin(*kinds)), F.lit(0).cast("long"), lambda total, b: total + b["byte_len"])


def with_derived(turns: DataFrame) -> DataFrame:
    """Visible bytes of text and tool use, reasoning blocks, the estimate of hidden tokens, and the variant: of the first block that has one."""
    b = F.col("blocks")
    measured = turns.withColumns({"visible_text_bytes": _bytes_of(b, TEXT_KINDS), "visible_tool_bytes": _bytes_of(b, TOOL_KINDS), "thinking_blocks": F.size(F.filter(b, lambda x: x["kind"].isin(*THINKING_KINDS))).cast("long")})
    hidden = F.expr("greatest(0L, coalesce(output_tokens, 0L) - ((visible_text_bytes + visible_tool_bytes + 3) div 4))")
    return measured.withColumns({"hidden_tokens": hidden, "model_variant": F.get(F.filter(b, lambda x: x["variant"].isNotNull()), F.lit(0))["variant"]})


def turn_of(e: Column, patterns: Sequence[str], source: str = "transcript") -> Column:
    """The turn of an entry (the fields of ``sources.transcripts.entry``): a struct without any body; null where e is null."""
    at = lambda where: F.try_variant_get(e["message"], f"$.{where}", "string")
    turn = F.struct(
        e["uuid"].alias("turn_uuid"), e["sessionId"].alias("session_id"), e["parentUuid"].alias("parent_turn_uuid"), *(e[c].alias(c) for c in ("role", "timestamp", "cwd", "git_branch", "is_sidechain", "slug", "version", "request_id")),
        at("id").alias("message_id"), at("model").alias("model"), *usage_fields(e["message"]), content_blocks(F.try_variant_get(e["message"], "$.content", "variant"), patterns, e["content_json"]).alias("blocks"), F.lit(source).alias("source"),
    )
    return F.when(e["uuid"].isNotNull(), turn)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns (path, offset and the fields of ``turn_of``) with order and derived columns; of repeated uuids the first by file and place stays."""
    return with_derived(composite_order(first_write_wins(turns.withColumn("file_rank", F.col("path")))).drop("file_rank"))


def entry_turns(entries: DataFrame, patterns: Sequence[str], source: str = "transcript") -> DataFrame:
    """One turn an entry (of ``scan_transcripts``), with its blocks, usage and derived columns."""
    return ordered_turns(entries.select("path", "offset", turn_of(F.struct(*entries.columns), patterns, source).alias("t")).select("path", "offset", "t.*"))


def block_rows(turns: DataFrame) -> DataFrame:
    """One row a block."""
    return turns.select("turn_uuid", "session_id", F.posexplode("blocks").alias("block_index", "b")).select("turn_uuid", "session_id", "block_index", "b.*")


def blocks_meta(blocks: Column) -> Column:
    """The blocks as JSON with the fixed keys; a tool's name where there is one, is_error for results alone."""
    return F.to_json(F.transform(blocks, lambda b, i: F.struct(i.alias("idx"), b["kind"].alias("kind"), b["byte_len"].alias("byte_len"), b["tool_name"].alias("tool_name"), b["is_error"].alias("is_error"))))


def signature_rows(turns: DataFrame) -> DataFrame:
    """Signatures of reasoning blocks, by turn and block: decoded size and variant."""
    signed = block_rows(turns).where("signature <> ''")
    return signed.select("turn_uuid", "session_id", "block_index", F.coalesce(F.octet_length(decode_base64(F.col("signature"))), F.lit(0)).alias("signature_bytes"), "variant")


def session_rows(turns: DataFrame) -> DataFrame:
    """Turns, start, end, the five token sums and the sorted distinct variants (JSON, null without any) by session; two steps, so that no set grows with a session's turns."""
    sums = (*TOKENS, "hidden_tokens")
    per_variant = turns.groupBy("session_id", "model_variant").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums))
    variants = F.array_sort(F.collect_list("model_variant"))
    return per_variant.groupBy("session_id").agg(F.sum("n").alias("turn_count"), F.min("started").alias("started"), F.max("ended").alias("ended"), *(F.sum(c).alias(c) for c in sums), F.when(F.size(variants) > 0, F.to_json(variants)).alias("variants"))


def index_report(files: DataFrame, turns: DataFrame, sessions: DataFrame, signatures: DataFrame) -> DataFrame:
    """What an index run has done, counted in its tables: one row."""
    of_files = files.agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if("first_bad").alias("files_failed"), F.coalesce(F.sum(F.when(~F.col("first_bad"), F.col("bad_lines"))), F.lit(0)).alias("parse_skipped"))
    by_variant = turns.where("model_variant IS NOT NULL").groupBy("model_variant").agg(F.count(F.lit(1)).alias("n"))
    variants = by_variant.agg(F.array_join(F.array_sort(F.collect_list(F.concat("model_variant", F.lit("="), "n"))), ",").alias("variants"))
    out = of_files
    for one in (turns.agg(F.count(F.lit(1)).alias("turns")), sessions.agg(F.count(F.lit(1)).alias("sessions")), signatures.agg(F.count(F.lit(1)).alias("signatures")), variants):
        out = out.join(F.broadcast(one))
    return out


def index_transcripts(spark: SparkSession, path: str, target: str, patterns: Sequence[str], glob: str = "*.jsonl") -> dict[str, DataFrame]:
    """Reads all transcripts below path once and writes files, turns, sessions and signatures below target; returns these tables as written, and report.

    Lines become turns without bodies as they are read, so that no text moves. files also tells how
    far each file is scanned, which ``incremental_scan`` takes as its state.
    """

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        return spark.read.parquet(f"{target}/{name}")

    read = S.parsed_lines(S.measured(S.read_lines(spark, path, glob))).withColumn("e", S.entry(F.col("v"), F.col("value")))
    lines = written("lines", S.with_offsets(read.select("path", "file_name", "block", "at", "size", "blank", "bad", turn_of(F.col("e"), patterns).alias("t"))))
    files = written("files", S.file_stats(lines))
    turns = written("turns", ordered_turns(S.drop_corrupt_files(lines, files).where("t IS NOT NULL").select("path", "offset", "t.*")))
    discard(spark, f"{target}/lines")
    tables = {"files": files, "turns": turns, "sessions": written("sessions", session_rows(turns)), "signatures": written("signatures", signature_rows(turns))}
    return tables | {"report": index_report(**tables)}


# --- the index that grows

#: Columns of the stored turns (``turns``), without blocks, which are a table of their own.
TURNS = (
    "turn_uuid string, session_id string, path string, offset long, parent_turn_uuid string, role string, timestamp string, cwd string, git_branch string, is_sidechain boolean, slug string, version string, request_id string, message_id string, model string, "
    "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, visible_text_bytes long, visible_tool_bytes long, thinking_blocks long, hidden_tokens long, model_variant string, n_blocks long, source string, kernel_event_id string"
)
STORED_TURNS = TURNS + ", turn_order long"
BLOCKS = "turn_uuid string, session_id string, block_index int, kind string, tool_name string, byte_len long, is_error boolean, variant string"
SIGNATURES = "turn_uuid string, session_id string, block_index int, signature_bytes int, variant string"
FILES = "path string, lines long, bad_lines long, first_bad boolean, scanned_to long, source string"
KEYS = "turn_uuid string, path string, offset long, session_id string, source string"


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns; those that df lacks are null."""
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields))


def stored_sessions(turns: DataFrame) -> DataFrame:
    """``session_rows`` with what a session begins with: its source, and the first directory, branch, model and tool version that is there, in turn order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("turn_order"))).alias(f"first_{c}")
    begins = turns.groupBy("session_id").agg(F.min_by("source", "turn_order").alias("source"), first("cwd"), first("git_branch"), first("model"), first("version"))
    return session_rows(turns).join(begins, "session_id")


def _files_after(old: DataFrame, stats: DataFrame, source: str) -> DataFrame:
    """Files of the buckets in old, brought up to date with what was read."""
    new = stats.select("path", *(F.col(c).alias(f"_{c}") for c in ("lines", "bad_lines", "first_bad", "scanned_to")))
    both = old.join(new, "path", "full")
    added = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c)
    return both.select("path", added("lines"), added("bad_lines"), F.when(F.col("lines") > 0, F.col("first_bad")).otherwise(F.coalesce("_first_bad", "first_bad")).alias("first_bad"), F.greatest("scanned_to", "_scanned_to").alias("scanned_to"), F.coalesce("source", F.lit(source)).alias("source"))


def _known(store: Store, version: Version, source: str) -> dict[str, int]:
    """Ends of the source's files that are indexed. Their names are on the driver, as with any read of files."""
    return {r.path: r.scanned_to for r in store.read(version, "files", FILES).where(F.col("source") == source).select("path", "scanned_to").toLocalIterator()}


def _stored(store: Store, base: Version, table: str, schema: str, touched: list[int], source: str, full: bool) -> tuple[DataFrame, list[int]]:
    """The stored rows in the touched buckets, and these. full: all buckets, without the source's rows."""
    if full:
        return store.read(base, table, schema).where(F.col("source") != source), list(range(store.buckets))
    return store.read(base, table, schema, touched), touched


def _buckets(store: Store, rows: DataFrame, **keys: str) -> list[list[int]]:
    """By key, the buckets of the rows; each at most as many as the store has."""
    found = rows.agg(*(F.collect_set(F.when(F.col(column).isNotNull(), store.bucket(column))).alias(name) for name, column in keys.items())).first()
    return [sorted(found[name]) for name in keys]


def _write_index(store: Store, base: Version, run: str, files: tuple[DataFrame, list[int]], turns: DataFrame, blocks: DataFrame, signatures: DataFrame, gone: DataFrame, keys: tuple[DataFrame, list[int] | None] | None = None) -> Version:
    """Merges turns (TURNS; with blocks and signatures) into the buckets of their sessions and publishes the version. gone (turn_uuid, session_id): stored turns that go, with their children. Receipts that are stored stay. keys: new rows, and the buckets that they replace (None: they are added)."""
    by_session = store.bucket("session_id")
    (touched,) = _buckets(store, turns.select("session_id").union(gone.select("session_id")), session="session_id")
    old = store.read(base, "turns", STORED_TURNS, touched)
    stay = old.join(gone.select("turn_uuid"), "turn_uuid", "left_anti")
    merged = composite_order(_shaped(stay, TURNS).unionByName(_shaped(preserve_receipts(turns, old), TURNS)))

    def children(name: str, rows: DataFrame, schema: str) -> DataFrame:
        held = store.read(base, name, schema, touched).join(gone.select("turn_uuid"), "turn_uuid", "left_anti")
        return _shaped(held, schema).unionByName(_shaped(rows, schema)).withColumn("bucket", by_session)

    rows_of = {"turns": merged.withColumn("bucket", by_session), "blocks": children("blocks", blocks, BLOCKS), "signatures": children("signatures", signatures, SIGNATURES), "files": files[0].withColumn("bucket", store.bucket("path"))}
    of_tables, added = {"turns": touched, "sessions": touched, "blocks": touched, "signatures": touched, "files": files[1]}, ()
    if keys is not None:
        rows_of["keys"] = keys[0].withColumn("bucket", store.bucket("turn_uuid"))
        of_tables["keys"], added = keys[1], ("keys",) if keys[1] is None else ()
    with ThreadPoolExecutor(len(rows_of)) as pool:  # tables that do not need each other are written side by side
        jobs = {name: pool.submit(store.write, run, name, rows) for name, rows in rows_of.items()}
        written = {name: job.result() for name, job in jobs.items()}
    now = store.spark.read.schema(STORED_TURNS).parquet(f"{store.root}/{run}/turns") if written["turns"]["buckets"] else merged.limit(0)
    written["sessions"] = store.write(run, "sessions", stored_sessions(now).withColumn("bucket", by_session))
    return store.publish(base, run, written, of_tables, added)


def update_index(spark: SparkSession, path: str, root: str, patterns: Sequence[str], glob: str = "*.jsonl", source: str = "transcript", buckets: int = 64, full: bool = False) -> Version:
    """Brings the index at root up to date with the transcripts below path, and publishes its next version (``sources.index_store``): tables files, turns, sessions, blocks, signatures and keys.

    Only bytes that are new are read (``sources.tail``), and only buckets that get turns are written
    anew; the result is that of ``full``, which reads everything again but keeps the receipts. Of turns
    with one uuid the first by file and place stays, also where a later run finds it: keys, a table that
    gains rows and is looked up in the buckets of new uuids alone, tells where each was found. A last line
    without an end counts if it is whole JSON; else it is read again once it is longer. Where nothing is new, the
    version stays.
    """
    store = Store(spark, root, buckets)
    base, run = store.version(), store.new_run()
    known = {} if full else _known(store, base, source)
    if not full and base.number and not parts(listed(path, glob), known):
        return base
    read = S.parsed_lines(read_tail(spark, path, glob, known).withColumn("blank", blank(F.col("value")))).withColumn("e", S.entry(F.col("v"), F.col("value")))
    read.select("path", "offset", "size", "ended", "blank", "bad", turn_of(F.col("e"), patterns, source).alias("t")).write.parquet(store.folder(run, "lines"))
    lines = spark.read.parquet(store.folder(run, "lines")).where("ended OR NOT bad").drop("ended")
    stats = S.file_stats(lines)
    at_files, at_keys = _buckets(store, lines.select("path", "t.turn_uuid"), files="path", keys="turn_uuid")
    old_files, touched_files = _stored(store, base, "files", FILES, at_files, source, full)
    files = _files_after(old_files, stats, source)

    found = S.drop_corrupt_files(lines, files).where("t IS NOT NULL").select("path", "offset", "t.*")
    fresh = first_write_wins(with_derived(found).withColumn("file_rank", F.col("path"))).drop("file_rank")
    keys, touched_keys = _stored(store, base, "keys", KEYS, at_keys, source, full)
    held = keys.groupBy("turn_uuid").agg(F.min(F.struct("path", "offset", "session_id")).alias("held"))
    first = fresh.join(held, "turn_uuid", "left").where(F.col("held").isNull() | (F.struct("path", "offset") < F.struct("held.path", "held.offset")))
    first.withColumn("n_blocks", F.size("blocks").cast("long")).write.parquet(store.folder(run, "first"))
    first = spark.read.parquet(store.folder(run, "first"))
    gone = first.where("held IS NOT NULL").select("turn_uuid", F.col("held.session_id").alias("session_id"))
    if full:
        gone = gone.union(store.read(base, "turns", STORED_TURNS).where(F.col("source") == source).select("turn_uuid", "session_id"))
    places = _shaped(first, KEYS)
    out = _write_index(store, base, run, (files, touched_files), _shaped(first, TURNS), block_rows(first), signature_rows(first), gone, (keys.unionByName(places), touched_keys) if full else (places, None))
    for name in ("lines", "first"):
        store.discard(run, name)
    return out


def rollout_turns(numbered: DataFrame, source: str) -> DataFrame:
    """Turns of rollouts (``functions.rollout.numbered_items``) in the shape of TURNS: they report no tokens, so that none are hidden."""
    of = lambda kinds: F.sum(_bytes_of(F.coalesce("items", F.array().cast(R.BLOCKS)), kinds)).alias
    n = F.sum(F.size(F.filter(F.coalesce("items", F.array().cast(R.BLOCKS)), lambda b: b["kind"].isin(*THINKING_KINDS))))
    sums = numbered.where("n > 0").groupBy("session_id", "path", "turn").agg(of(TEXT_KINDS)("visible_text_bytes"), of(TOOL_KINDS)("visible_tool_bytes"), n.alias("thinking_blocks"))
    turns = R.turn_rows(numbered).join(sums, ["session_id", "path", "turn"])
    return _shaped(turns.withColumns({"n_blocks": F.col("blocks"), "source": F.lit(source), "hidden_tokens": F.lit(0), "is_sidechain": F.lit(False)}), TURNS)


def update_rollouts(spark: SparkSession, path: str, root: str, glob: str = "rollout-*.jsonl", source: str = "rollout", buckets: int = 64, full: bool = False) -> Version:
    """The same for rollout files, one a session: a file that has grown or is new is read whole, and its session is replaced with all its blocks, but receipts stay. Turns without readable blocks are none; lines that cannot be read are counted in files."""
    store = Store(spark, root, buckets)
    base, run = store.version(), store.new_run()
    known = {} if full else _known(store, base, source)
    there = listed(path, glob)
    same = {p: n for p, n in there.items() if known.get(p, -1) >= n}
    if not full and base.number and len(same) == len(there):
        return base
    read = read_tail(spark, path, glob, same).withColumns({"blank": blank(F.col("value")), "bad": F.try_parse_json("value").isNull()})
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    read.select("path", "file_name", "offset", "size", "blank", "bad", field("timestamp"), field("type"), field("payload")).write.parquet(store.folder(run, "lines"))
    lines = spark.read.parquet(store.folder(run, "lines"))
    stats = S.file_stats(lines)
    old_files, touched_files = _stored(store, base, "files", FILES, _buckets(store, stats, files="path")[0], source, full)
    files = _shaped(old_files.join(stats, "path", "left_anti"), FILES).unionByName(_shaped(stats.withColumn("source", F.lit(source)), FILES))
    R.numbered_items(lines.where("NOT bad AND NOT blank"), S.path_session_id(F.regexp_extract("path", "([^/]*)$", 1))).write.parquet(store.folder(run, "items"))
    numbered = spark.read.parquet(store.folder(run, "items"))
    turns = first_write_wins(rollout_turns(numbered, source).withColumn("file_rank", F.col("path"))).drop("file_rank")
    blocks = R.turn_blocks(numbered).join(turns.select("turn_uuid", "path"), "turn_uuid", "left_semi")
    sessions = numbered.select("session_id").distinct()
    held = store.read(base, "turns", STORED_TURNS, None if full else _buckets(store, sessions, at="session_id")[0])
    gone = (held.where(F.col("source") == source) if full else held.join(sessions, "session_id", "left_semi")).select("turn_uuid", "session_id")
    out = _write_index(store, base, run, (files, touched_files), turns, blocks, spark.createDataFrame([], SIGNATURES), gone)
    for name in ("lines", "items"):
        store.discard(run, name)
    return out


def record_receipts(spark: SparkSession, root: str, receipts: DataFrame, buckets: int = 64) -> Version:
    """Writes receipt ids (session_id, turn_uuid, kernel_event_id) into the stored turns; turns that have one keep it."""
    store = Store(spark, root, buckets)
    base, run = store.version(), store.new_run()
    by_session = store.bucket("session_id")
    (touched,) = _buckets(store, receipts, at="session_id")
    new = receipts.groupBy("turn_uuid").agg(F.min("kernel_event_id").alias("_new"))
    turns = store.read(base, "turns", STORED_TURNS, touched).join(new, "turn_uuid", "left").withColumn("kernel_event_id", F.coalesce("kernel_event_id", "_new"))
    return store.publish(base, run, {"turns": store.write(run, "turns", _shaped(turns, STORED_TURNS).withColumn("bucket", by_session))}, {"turns": touched})
