"""Daily roll-ups that merge: totals of any range of days, with exact distinct sessions, come from partials.

A day's partial of an action type has the number of events, their energy, first and last time, and the sessions
as bitmaps: each session has a number in a dictionary, numbers lie in blocks, and a day has one bitmap for each
block that it touches. Sums add, bitmaps unite, so rows that come late change the partials of their days alone
(``sources.index_store``, a bucket a day), and distinct sessions over many days are the bits of the united
bitmaps. Numbers are dense within each of DEALS shares of the sessions, so that new ones get theirs without a
global order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.index_store import Store, Version

DAY_MS = 86_400_000
#: Shares of the sessions' dictionary, and numbers that each may hold.
DEALS, SPAN_BITS = 64, 40
DAILY = "day int, action_type string, block long, n long, energy long, first_ms long, last_ms long, sessions binary"
NAMES = "session_id string, number long"


def _store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, DEALS)


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("day", "action_type", "block").agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.bitmap_or_agg("sessions").alias("sessions"))


def update_daily(spark: SparkSession, events: DataFrame, root: str) -> Version:
    """Adds events (session_id, action_type, event_ms, settled_energy) to the roll-ups at root. Events without a time or session count for nothing. Each event must be given once."""
    store = _store(spark, root)
    base, run = store.version(), store.new_run()
    known = events.where("session_id IS NOT NULL AND event_ms IS NOT NULL")
    # New sessions get the next numbers of their share.
    share = store.bucket("session_id")
    seen = store.read(base, "sessions", NAMES)
    fresh = known.select("session_id").distinct().join(seen, "session_id", "left_anti").withColumn("bucket", share)
    held = seen.groupBy(share.alias("bucket")).agg(F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("session_id")).cast("long") - 1
    numbered = fresh.withColumn("rank", rank).join(held, "bucket", "left").withColumn("number", F.shiftleft(F.col("bucket").cast("long"), SPAN_BITS) + F.coalesce("held", F.lit(0)) + F.col("rank"))
    written = {"sessions": store.write(run, "sessions", numbered.select("session_id", "number", "bucket"))}
    new = spark.read.schema(NAMES).parquet(f"{store.root}/{run}/sessions").select("session_id", "number") if written["sessions"]["buckets"] else spark.createDataFrame([], NAMES)
    day = F.floor(F.col("event_ms") / DAY_MS).cast("int")
    placed = known.join(seen.union(new), "session_id").withColumns({"day": day, "block": F.bitmap_bucket_number("number"), "bit": F.bitmap_bit_position("number")})
    partials = placed.groupBy("day", "action_type", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("settled_energy").cast("long").alias("energy"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"), F.bitmap_construct_agg("bit").alias("sessions"),
    )
    days = [r.day for r in known.select(day.alias("day")).distinct().collect()]  # as many as the events span
    merged = _merged(partials.unionByName(store.read(base, "daily", DAILY, days)))
    written["daily"] = store.write(run, "daily", merged.withColumn("bucket", F.col("day")))
    return store.publish(base, run, written, {"daily": days, "sessions": None}, ("sessions",))


def totals(spark: SparkSession, root: str, first_day: int | None = None, last_day: int | None = None, by: tuple[str, ...] = ("action_type",)) -> DataFrame:
    """n, energy, first_ms, last_ms and exact distinct sessions of the days (numbers since 1970) from first_day to last_day, by action_type, day, both, or neither. Only the partials of these days are read."""
    store = _store(spark, root)
    version = store.version()
    there = [int(b) for b in version.tables.get("daily", {"parts": {}})["parts"]]
    wanted = [b for b in there if (first_day is None or b >= first_day) and (last_day is None or b <= last_day)]
    rows = store.read(version, "daily", DAILY, wanted)
    united = rows.groupBy(*by, "block").agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.bitmap_count(F.bitmap_or_agg("sessions")).alias("sessions"))
    return united.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("sessions").alias("sessions"))
