"""A durable queue: entries and an acknowledgement log, both only added to, and a compaction.

Each step is one version of a store (``sources.index_store``), so that readers see whole steps alone. Work is
done before it is acknowledged: a crash between the two repeats at most that round. Rows that failed too often
stay for diagnosis and hold up nothing; compaction drops what is done and keeps of the log one row an entry.
Entries and log are dealt by seq into as many tasks as keep each near TASK_ROWS, so that a task's memory
does not grow with the queue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.index_store import Store, Version

#: Shares of the entries, by their numbers.
SHARES = 16
#: Rows of entries, or of the log, that one task meets, about.
TASK_ROWS = 1 << 17
LOG = "seq long, attempts int, error string, place long"
#: Rows that one step may number.
STEP_BITS = 40


class Queue:
    """At root; entries have the schema of the first rows put in."""

    def __init__(self, spark: SparkSession, root: str, most: int = 3):
        self.spark, self.store, self.most = spark, Store(spark, root, SHARES), most

    def _tasks(self, version: Version) -> int:
        """By the rows that the files tell."""
        rows = max(self.store.read(version, table, LOG).count() for table in ("entries", "log"))
        return max(1, -(-rows // TASK_ROWS))

    def _add(self, base: Version, run: str, table: str, rows: DataFrame, tasks: int = 0) -> Version:
        written = self.store.write(run, table, rows.withColumn("bucket", self.store.bucket("seq")), "seq" if tasks else None, tasks)
        return self.store.publish(base, run, {table: written}, {table: None}, (table,))

    def put(self, rows: DataFrame) -> Version:
        """Adds rows; those of one call come before those of the next, and in the order of the rows."""
        base = self.store.version()
        first = F.shiftleft(F.lit(base.number).cast("long"), STEP_BITS)
        return self._add(base, self.store.new_run(), "entries", rows.select((first + F.monotonically_increasing_id()).alias("seq"), "*"))

    def _state(self, version: Version) -> DataFrame:
        """Entries (none yet: an empty frame) with how often they were tried, the last error, and whether they are done."""
        if "entries" not in version.tables:
            return self.spark.createDataFrame([], "seq long, attempts int, last_error string, done boolean")
        tasks = self._tasks(version)
        log = self.store.read(version, "log", LOG).repartition(tasks, "seq").groupBy("seq").agg(F.sum("attempts").cast("int").alias("attempts"), F.max_by(F.struct("error"), "place").alias("last"))
        entries = self.store.read(version, "entries", StructType()).repartition(tasks, "seq")
        return entries.join(log, "seq", "left").select(*entries.columns, F.coalesce("attempts", F.lit(0)).alias("attempts"), F.col("last.error").alias("last_error"), (F.col("last").isNotNull() & F.col("last.error").isNull()).alias("done"))

    def pending(self) -> DataFrame:
        """Entries that wait to be tried, first in first (by seq)."""
        return self._state(self.store.version()).where(~F.col("done") & (F.col("attempts") < self.most)).drop("done")

    def dead(self) -> DataFrame:
        """Entries that failed too often."""
        return self._state(self.store.version()).where(~F.col("done") & (F.col("attempts") >= self.most)).drop("done")

    def left(self) -> DataFrame:
        """Entries that are not done: pending and dead."""
        return self._state(self.store.version()).where(~F.col("done")).drop("done")

    def drain(self, attempt: Callable[[DataFrame], DataFrame]) -> Version:
        """One round over what waits, sorted by seq within each task. ``attempt`` does the work and adds a column error, null where a row went through; then the outcome of every row is acknowledged."""
        base, run = self.store.version(), self.store.new_run()
        waiting = self._state(base).where(~F.col("done") & (F.col("attempts") < self.most)).drop("done")
        tried = attempt(waiting.sortWithinPartitions("seq"))
        return self._add(base, run, "log", tried.select("seq", F.lit(1).alias("attempts"), F.col("error").cast("string").alias("error"), F.lit(base.number).cast("long").alias("place")), self._tasks(base))

    def compact(self) -> Version:
        """Entries that are done go, with their log; of the others one log row each stays."""
        base, run = self.store.version(), self.store.new_run()
        if "entries" not in base.tables:
            return base
        left, by, tasks = self._state(base).where(~F.col("done")), self.store.bucket("seq"), self._tasks(base)
        log = left.where("attempts > 0").select("seq", "attempts", F.col("last_error").alias("error"), F.lit(base.number).cast("long").alias("place"))
        written = {"entries": self.store.write(run, "entries", left.drop("attempts", "last_error", "done").withColumn("bucket", by), "seq", tasks), "log": self.store.write(run, "log", log.withColumn("bucket", by), "seq", tasks)}
        return self.store.publish(base, run, written, {"entries": None, "log": None})
