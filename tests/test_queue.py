"""The durable queue: first in first, dead rows hold up nothing, a crash repeats one round, compaction keeps what is left."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.index_store import Store
from ledgerloom.streaming import jobs
from ledgerloom.streaming.queue import Queue


def test_queue(spark, tmp_path, monkeypatch):
    queue = Queue(spark, str(tmp_path / "q"))
    assert queue.pending().count() == 0 and queue.compact().number == 0
    queue.put(spark.createDataFrame([("a", 0), ("b", 9), ("c", 1)], "name string, needs int").coalesce(1))
    queue.put(spark.createDataFrame([("d", 0)], "name string, needs int"))
    assert [r.name for r in queue.pending().orderBy("seq").collect()] == ["a", "b", "c", "d"]
    done = []

    def attempt(n):
        def run(rows):
            out = rows.withColumn("error", F.when(F.col("needs") > n, F.concat(F.lit("not in round "), F.lit(n))))
            done.extend(r.name for r in out.where("error IS NULL").collect())
            return out

        return run

    real = Store.write
    monkeypatch.setattr(Store, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        queue.drain(attempt(0))  # the work is done, but not acknowledged
    monkeypatch.setattr(Store, "write", real)
    queue.drain(attempt(0))
    assert sorted(done) == ["a", "a", "d", "d"]
    left = {r.name: (r.attempts, r.last_error) for r in queue.pending().collect()}
    assert left == {"b": (1, "not in round 0"), "c": (1, "not in round 0")}
    queue.compact()
    assert {r.name: (r.attempts, r.last_error) for r in queue.pending().collect()} == left
    for n in (1, 2, 3):
        queue.drain(attempt(n))
    assert queue.pending().count() == 0 and sorted(done) == ["a", "a", "c", "d", "d"]
    assert [(r.name, r.attempts, r.last_error) for r in queue.dead().collect()] == [("b", 3, "not in round 2")]
    queue.put(spark.createDataFrame([("e", 0)], "name string, needs int"))
    queue.drain(attempt(9))
    assert done[-1] == "e" and queue.dead().count() == 1


def test_a_queue_has_more_tasks_for_more_rows(spark, tmp_path, monkeypatch):
    """The tasks used to be as many as the session sets and small partitions leave, however long the queue."""
    monkeypatch.setattr("ledgerloom.streaming.queue.TASK_ROWS", 100, raising=False)
    queue = Queue(spark, str(tmp_path / "q"))
    queue.put(spark.range(2000).withColumnRenamed("id", "n"))
    queue.drain(lambda rows: rows.withColumn("error", F.when(F.col("n") % 4 == 0, "no")))
    assert queue.pending().rdd.getNumPartitions() == 20
    queue.compact()
    assert sorted(r.n for r in queue.pending().collect()) == list(range(0, 2000, 4))
    assert queue.pending().rdd.getNumPartitions() == 5


def test_outbox_sends_once_over_restarts(spark, tmp_path):
    """Repeats within a run, in a later run, and in a batch that dies after its write: one receipt each; no batch reads receipts."""
    turns, receipts, sink = (str(tmp_path / n) for n in ("turns", "receipts", "sink"))
    schema = "source string, turn_uuid string"

    def put(*ids):
        spark.createDataFrame([("s", i) for i in ids], schema).coalesce(1).write.mode("append").parquet(turns)

    def go():
        jobs.outbox(spark, jobs.read_events(spark, turns, schema, 1), receipts, sink)
        return sorted(r.target for r in spark.read.parquet(receipts).collect())

    put("a", "b", "a")
    assert go() == ["s/turn/a", "s/turn/b"]
    put("b", "c")
    assert go() == ["s/turn/a", "s/turn/b", "s/turn/c"]
    last = sorted((tmp_path / "sink" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    (last.parent / f".{last.name}.crc").unlink()
    last.unlink()  # the batch wrote its receipts, but died before its commit
    put("a", "d")
    assert go() == ["s/turn/a", "s/turn/b", "s/turn/c", "s/turn/d"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
