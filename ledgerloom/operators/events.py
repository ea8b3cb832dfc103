"""Event-log analytics: filters, statistics, presence, receipts, paging.

Every function takes and returns DataFrames; times are epoch milliseconds (UTC).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
#: Commands to flag (fixed values).
RISKY = ("rm -rf", "git push", "git reset", "drop table", "taskkill", "force")


def parse_mixed_time(text: Column) -> Column:
    """Milliseconds from epoch-ms digits, RFC 3339 or naive ISO text (as UTC); null where unreadable."""
    digits = F.when(text.rlike(r"^-?\d{1,18}$"), text.try_cast("long"))
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(digits, F.unix_millis(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), zoned))))


def event_text(df: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("id", "event_hash", "actor_id", "action_type", "target", "payload") if c in df.columns)))


def keyword_search(df: DataFrame, keyword: str) -> DataFrame:
    return df.where(F.contains(event_text(df), F.lit(keyword.lower())))


def time_range(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None, column: str = "event_ms") -> DataFrame:
    """Both bounds are inclusive; rows without a time fail as soon as one is set."""
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("the start lies after the end")
    if start_ms is not None:
        df = df.where(F.col(column) >= start_ms)
    return df if end_ms is None else df.where(F.col(column) <= end_ms)


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("log_index")).limit(n)


def event_query(df: DataFrame, *, actor: str | None = None, action_type: str | None = None, event_type: str | None = None, start_ms: int | None = None, end_ms: int | None = None, keyword: str | None = None, limit: int = 20, scan_limit: int | None = None) -> DataFrame:
    """All given conditions together, newest first. action_type and event_type are two names of one condition."""
    if action_type and event_type and action_type != event_type:
        raise ValueError("action_type and event_type differ")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    if actor:
        df = df.where(F.col("actor_id") == actor)
    if scan_limit:
        df = newest(df, scan_limit)
    if action_type or event_type:
        df = df.where(F.col("action_type") == (action_type or event_type))
    df = time_range(df, start_ms, end_ms)
    return newest(keyword_search(df, keyword) if keyword else df, limit)


def session_exact(df: DataFrame, session: str) -> DataFrame:
    return df.where(F.col("session_id") == session)


def session_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.startswith(F.col("session_id"), F.lit(prefix)))


def id_prefix_lookup(df: DataFrame, prefix: str) -> DataFrame:
    return newest(df.where(F.startswith(F.col("id"), F.lit(prefix))), 1)


def ellipsis(text: Column, most: int) -> Column:
    """Texts of more than ``most`` bytes are cut to end in three points."""
    return F.when(F.octet_length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def clock(ms: Column) -> Column:
    """HH:MM in UTC."""
    minute = F.floor(F.pmod(ms, F.lit(DAY_MS)) / 60_000).cast("int")
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)))


def day(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


def history_rows(df: DataFrame, n: int) -> DataFrame:
    """The newest n events as numbered display rows. The rank runs over the n rows of the page alone."""
    page = newest(df, n)
    rank = F.row_number().over(Window.orderBy(F.desc("log_index")))
    return page.select(rank.cast("long").alias("rank"), clock(F.col("event_ms")).alias("at"), F.coalesce("event_type", "action_type").alias("kind"), ellipsis(F.col("target"), 30).alias("target"), F.coalesce("settled_energy", F.lit(0)).alias("energy"), F.left("id", F.lit(8)).alias("short_id"))


def scan_counts(df: DataFrame, condition: Column, limit: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(condition).alias("matched")).select("scanned", "matched", F.least("matched", F.lit(limit).cast("long")).alias("returned"))


def counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def timeline_day(df: DataFrame) -> DataFrame:
    return df.groupBy((F.floor(F.col("event_ms") / DAY_MS) * DAY_MS).alias("day_ms")).agg(F.count(F.lit(1)).alias("n"))


def time_span(df: DataFrame) -> DataFrame:
    return df.agg(F.min("event_ms").alias("earliest_ms"), F.max("event_ms").alias("latest_ms"), F.count(F.lit(1)).alias("total"))


def hourly_energy(df: DataFrame) -> DataFrame:
    """Energy by UTC day and hour; a missing energy counts as 1."""
    hour = F.floor(F.pmod(F.col("event_ms"), F.lit(DAY_MS)) / HOUR_MS).cast("int")
    return df.groupBy(day(F.col("event_ms")).alias("day"), hour.alias("hour")).agg(F.sum(F.coalesce("settled_energy", F.lit(1))).alias("energy"))


def heatmap(df: DataFrame, days: int) -> DataFrame:
    """One row for each of the last ``days`` calendar days, a column an hour, gaps filled with 0."""
    hourly = hourly_energy(df)
    last = hourly.agg(F.max("day").alias("last"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    wide = hourly.groupBy("day").pivot("hour", list(range(24))).agg(F.sum("energy"))
    return calendar.join(F.broadcast(wide.join(last, (F.col("day") > F.date_sub("last", days)), "left_semi")), "day", "left").select("day", *(F.coalesce(F.col(str(h)), F.lit(0)).cast("long").alias(f"h{h:02d}") for h in range(24)))


def presence_totals(df: DataFrame) -> DataFrame:
    pre, post, failed = F.endswith("event_type", F.lit("_pre")), F.col("event_type").isin("command_execution", "file_read", "file_write", "file_edit"), F.endswith("event_type", F.lit("_failed"))
    got = df.agg(
        F.sum(F.coalesce("settled_energy", F.lit(1))).alias("energy"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "user_prompt").alias("decisions"),
        F.countDistinct("session_id").alias("sessions"),
        F.count_if(pre).alias("pre"),
        F.count_if(post).alias("post"),
        F.count_if(failed).alias("failed"),
    )
    return got.withColumn("completeness", F.when(F.col("pre") == 0, F.lit(100.0)).otherwise((F.col("post") + F.col("failed")) * 100.0 / F.col("pre")))


def peak_hour(df: DataFrame) -> DataFrame:
    """The hour with most energy over all days; of equals, the latest."""
    return hourly_energy(df).groupBy("hour").agg(F.sum("energy").alias("energy")).agg(F.max_by("hour", F.struct("energy", "hour")).alias("hour"), F.max("energy").alias("energy"))


def heat_level(hourly: DataFrame) -> DataFrame:
    """Level 0 to 5 against the greatest energy in view (one value, joined back)."""
    top = hourly.agg(F.max("energy").alias("top"))
    share = F.col("energy") / F.col("top")
    level = F.when(F.col("energy") == 0, 0).when(share < 0.1, 1).when(share < 0.25, 2).when(share < 0.5, 3).when(share < 0.75, 4).otherwise(5)
    return hourly.join(F.broadcast(top)).select("day", "hour", "energy", level.alias("level"))


def duration_text(ms: Column) -> Column:
    """``Xm YYs``."""
    seconds = F.floor(ms / 1000).cast("long")
    return F.format_string("%dm %02ds", F.floor(seconds / 60), F.pmod(seconds, F.lit(60)))


def receipt_duration(first_ms: Column, last_ms: Column) -> Column:
    """``Xm YYs``; unknown without two different times."""
    return F.when(last_ms > first_ms, duration_text(last_ms - first_ms)).otherwise("unknown")


def report_duration(start_ms: Column, end_ms: Column) -> Column:
    """``Xm Ys``, or ``Ys`` below a minute; ongoing without an end, else unknown."""
    seconds = F.floor((end_ms - start_ms) / 1000).cast("long")
    minutes = F.floor(seconds / 60)
    text = F.when(minutes > 0, F.format_string("%dm %ds", minutes, F.pmod(seconds, F.lit(60)))).otherwise(F.format_string("%ds", seconds))
    return F.when(end_ms > start_ms, text).when(start_ms.isNotNull() & end_ms.isNull(), "ongoing").otherwise("unknown")


def energy_cost(kind: Column, output: Column, payload: Column, base: dict[str, int], default: int = 25, per_output: int = 256, per_payload: int = 1024) -> Column:
    """1, what the kind costs (kinds not in ``base``: ``default`` and one for each ``per_output`` of output), and one for each ``per_payload`` bytes of payload."""
    known = F.coalesce(*(F.when(kind == name, F.lit(cost)) for name, cost in base.items()), default + F.floor(output / per_output))
    return (known + 1 + F.floor(F.octet_length(payload) / per_payload)).cast("long")


def short_hash(text: Column) -> Column:
    """The first and last eight letters of a hash."""
    return F.concat(F.left(text, F.lit(8)), F.lit("..."), F.right(text, F.lit(8)))


def day_label(date: Column) -> Column:
    """``M/D Www``."""
    return F.date_format(date, "M/d E")


def thousands(n: Column) -> Column:
    """A whole number with a comma between groups of three digits."""
    return F.format_number(n, 0)


def with_checkpoint(receipts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Adds tree size and short root of the latest checkpoint (tree_size, root); 0 and unavailable without any."""
    latest = checkpoints.agg(F.max("tree_size").alias("tree_size"), F.max_by("root", "tree_size").alias("root"))
    root = F.when(F.length("root") > 16, F.concat(F.lit("0x"), short_hash(F.col("root")))).otherwise(F.coalesce(F.concat(F.lit("0x"), "root"), F.lit("unavailable")))
    return receipts.join(F.broadcast(latest.select(F.coalesce("tree_size", F.lit(0)).alias("tree_size"), root.alias("root"))))


def session_receipt(df: DataFrame) -> DataFrame:
    """A row a session: events, energy, span, duration and counts by action as ``action=n`` in order."""
    per_action = df.groupBy("session_id", "action_type").agg(F.count(F.lit(1)).alias("n"), F.sum("settled_energy").alias("energy"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"))
    got = per_action.groupBy("session_id").agg(
        F.sum("n").alias("events"),
        F.sum("energy").alias("energy"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.array_join(F.array_sort(F.collect_list(F.concat("action_type", F.lit("="), "n"))), ",").alias("actions"),
    )
    return got.withColumn("duration", duration_text(F.col("last_ms") - F.col("first_ms")))


def export_scope(df: DataFrame, actor: str | None, last: int | None, session: str | None) -> DataFrame:
    """Actor, then the last n, then the session prefix, in this order."""
    df = df if actor is None else df.where(F.col("actor_id") == actor)
    df = df if last is None else newest(df, last)
    return df if session is None else session_prefix(df, session)


def export_header(df: DataFrame) -> DataFrame:
    got = df.agg(F.count(F.lit(1)).alias("events"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"), F.sum("settled_energy").alias("energy"))
    return got.withColumn("duration", duration_text(F.col("last_ms") - F.col("first_ms")))


def export_type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("event_type", "action_type", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("settled_energy", F.lit(0))).alias("energy"))


def export_timeline(df: DataFrame) -> DataFrame:
    """A line an event; the first event of each UTC day is marked. Days are windows of their own, so no task holds the whole log."""
    by_day = Window.partitionBy("day").orderBy("event_ms", "log_index")
    return df.withColumn("day", day(F.col("event_ms"))).select("log_index", F.col("day").cast("string").alias("day"), (F.row_number().over(by_day) == 1).alias("day_header"), F.concat(clock(F.col("event_ms")), F.lit(" "), F.coalesce("event_type", "action_type"), F.lit(" "), "target").alias("line"))


def export_json(df: DataFrame, columns: Sequence[str], path: str | None = None) -> DataFrame:
    """Events as JSON lines; written to path if one is given."""
    lines = df.select(F.to_json(F.struct(*columns)).alias("value"))
    if path:
        lines.write.mode("overwrite").text(path)
    return lines


def flagged_commands(df: DataFrame, fragments: Sequence[str] = RISKY) -> DataFrame:
    command = F.lower(F.regexp_replace("target", "^hook/bash:", ""))
    return df.where(F.startswith("target", F.lit("hook/bash:")) & F.exists(F.array(*map(F.lit, fragments)), lambda p: F.contains(command, p)))


def low_energy(df: DataFrame, least: int = 100) -> DataFrame:
    return df.where(F.col("balance") - F.col("reserved") < least)


def sorted_counts(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("n"), key)


def as_of_anchor(rows: DataFrame, anchors: DataFrame, width: int = 4096) -> DataFrame:
    """For each row, the smallest anchored tree_size that is at least its own; status exact, covered or none.

    Sizes fall into buckets of ``width``. A row looks at its own bucket, and at the least anchor of
    later buckets: of its own group of ``width`` buckets, and of later groups. Only the groups, one
    row for each ``width`` squared sizes, meet in one task.
    """
    bucket = F.floor(F.col("tree_size") / width)
    marks = anchors.select("tree_size").distinct().withColumn("bucket", bucket)
    firsts = marks.groupBy("bucket").agg(F.min("tree_size").alias("first"))
    wanted = rows.withColumn("bucket", bucket)
    all_buckets = wanted.select("bucket").distinct().join(firsts, "bucket", "full").withColumn("group", F.floor(F.col("bucket") / width))
    rest = (1, Window.unboundedFollowing)
    groups = all_buckets.groupBy("group").agg(F.min("first").alias("least")).withColumn("next", F.min("least").over(Window.orderBy("group").rowsBetween(*rest)))
    near = all_buckets.withColumn("after", F.min("first").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(*rest)))
    after = near.join(groups.select("group", "next"), "group").select("bucket", F.coalesce("after", "next").alias("after"))
    both = wanted.select("bucket", "tree_size", F.struct(*rows.columns).alias("row"), F.lit(None).cast("long").alias("mark")).union(marks.select("bucket", "tree_size", F.lit(None).cast(rows.schema), F.col("tree_size").alias("mark")))
    own = Window.partitionBy("bucket").orderBy("tree_size").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("mark", F.min("mark").over(own)).where("row IS NOT NULL").join(after, "bucket", "left")
    mark = F.coalesce("mark", "after")
    return found.select("row.*", mark.alias("anchored")).withColumn("status", F.when(F.col("anchored").isNull(), "none").when(F.col("anchored") == F.col("tree_size"), "exact").otherwise("covered"))
