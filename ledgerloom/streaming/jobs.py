"""Streaming forms of the incremental jobs. Every sink is a Parquet table below a shared folder; a run takes what is there and ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_once(df: DataFrame, sink: str, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Everything available, in as many batches as the source makes. Each batch is a folder named by its number: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        else:
            batch.write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The last state of each key from the batches of an update-mode run."""
    rows = spark.read.parquet(f"{sink}/rows")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def daily_counter(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Energy by UTC day; rows later than the watermark are dropped (this system's rule; the counter it stands for had none)."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day").alias("w")).agg(F.sum("settled_energy").alias("energy")).select(F.unix_millis("w.start").alias("day_ms"), "energy")


def running_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"))


def gap_sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions by silence instead of by id: closed after a gap, emitted when the watermark has passed."""
    return events.withWatermark("event_time", late).groupBy("actor_id", F.session_window("event_time", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("actor_id", F.unix_millis("w.start").alias("start_ms"), "n")


#: Shares of the sessions: those of one are one key of the state, and are stepped together.
SESSION_SHARES = 512
HELD, TOLD = ["session_id", "n", "energy", "last", "deadline"], ["session_id", "n", "energy", "ended"]


def _step_sessions(held: pd.DataFrame, rows: pd.DataFrame, now: int, timeout_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Sessions (session_id, n, energy, last, deadline) of a share after the rows of a batch, and those to be told of (session_id, n, energy, ended)."""
    rows = rows.sort_values("log_index", ignore_index=True)
    at = rows.groupby("session_id", dropna=False, sort=False)
    start = rows.index.to_series().where(rows["event_type"] == "session_start").groupby(at.ngroup()).transform("max")
    last = at["event_ms"].max()
    kept = rows[start.isna() | (rows.index >= start)].assign(begins=start.notna(), ends=rows["event_type"] == "session_end")
    here = kept.groupby("session_id", dropna=False).agg(n=("log_index", "size"), energy=("settled_energy", "sum"), begins=("begins", "any"), ended=("ends", "any"))
    here = here.join(last).reset_index()
    # A session without an id is None in both, so that it meets itself.
    here["session_id"] = here["session_id"].astype(object).where(here["session_id"].notna(), None)
    here = here.merge(held, "left", "session_id", suffixes=("", "_held"))
    before = lambda c: here[c + "_held"].fillna(0).astype("int64").where(~here["begins"], 0)
    here["n"], here["energy"] = before("n") + here["n"], before("energy") + here["energy"].astype("int64")
    here["last"] = here[["event_ms", "last"]].max(axis=1).fillna(0).astype("int64")
    here["deadline"] = here["last"].clip(lower=now) + timeout_ms
    idle, told = _silenced(held[~held["session_id"].isin(here["session_id"])], now)
    return pd.concat([idle, here.loc[~here["ended"], HELD]]), pd.concat([here[TOLD], told])


def _silenced(held: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Sessions whose deadline has not passed, and those to be told of as ended."""
    silent = held["deadline"] < now
    return held[~silent], held[silent].assign(ended=True)[TOLD]


def session_state(events: DataFrame, timeout_ms: int = 86_400_000, late: str = "1 day") -> DataFrame:
    """Running count and energy of each session: session_start begins anew, session_end ends it, as does silence beyond the timeout (in event time).

    A key of the state is a share of the sessions, not a session, so that a batch is stepped in SESSION_SHARES calls over columns; the timer is that of the share's earliest deadline.
    """

    def step(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(HELD, state.get if state.exists else ([],) * 5, strict=True))).astype({"session_id": object} | dict.fromkeys(HELD[1:], "int64"))
        now = state.getCurrentWatermarkMs()
        got = [] if state.hasTimedOut else list(parts)
        held, told = _step_sessions(held, pd.concat(got), now, timeout_ms) if got else _silenced(held, now)
        if len(held):
            state.update(tuple(held[c].tolist() for c in HELD))
            state.setTimeoutTimestamp(int(held["deadline"].min()))
        elif state.exists:
            state.remove()
        yield told

    columns = events.withWatermark("event_time", late).select("session_id", "log_index", "event_type", "settled_energy", "event_ms", "event_time")
    return columns.withColumn("share", F.pmod(F.xxhash64("session_id"), F.lit(SESSION_SHARES))).groupBy("share").applyInPandasWithState(step, "session_id string, n long, energy long, ended boolean", "session_id array<string>, n array<long>, energy array<long>, last array<long>, deadline array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def without_replays(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events of a log and its replays, each id once."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])


#: State on disk, of which a batch saves what it changed.
KEYED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state by KEYED_STATE."""
    before = {k: spark.conf.get(k, None) for k in KEYED_STATE}
    for k, v in KEYED_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def outbox(spark: SparkSession, turns: DataFrame, receipts: str, sink: str) -> None:
    """One receipt a turn under a deterministic target. Targets that were sent are keyed state of the query at sink: a batch looks up its own targets and reads no receipts, and a batch that is run again finds the state before it and replaces its own folder, so that nothing is sent twice."""
    made = turns.select(F.concat("source", F.lit("/turn/"), "turn_uuid").alias("target")).dropDuplicates(["target"])

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{receipts}/batch={number}")

    with keyed_state(spark):
        run_once(made, sink, "append", each)


def split_bad_rows(spark: SparkSession, lines: DataFrame, schema: str, sink: str) -> None:
    """Rows that parse go to sink/rows; the others to sink/dead, tried once, with why they failed, and never hold up what follows. ``drain`` tries them again."""

    def each(batch: DataFrame, number: int) -> None:
        parsed = batch.withColumn("e", F.from_json("value", schema)).withColumn("bad", F.try_parse_json("value").isNull())
        parsed.where("NOT bad").select("e.*").write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        parsed.where("bad").select("value", F.lit(1).alias("attempts"), F.lit("not JSON").alias("last_error")).write.mode("overwrite").parquet(f"{sink}/dead/batch={number}")

    run_once(lines, sink, "append", each)


def drain(pending: DataFrame, attempt: Callable[[DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """One round over a queue (attempts, last_error and any more): rows done, and rows that stay.

    ``attempt`` adds a column error, null where a row went through. Rows that failed stay with one
    attempt more; those tried ``most`` times stay for diagnosis and are not tried again.
    """
    tried = attempt(pending.where(F.col("attempts") < most))
    failed = tried.where("error IS NOT NULL").withColumns({"attempts": F.col("attempts") + 1, "last_error": F.col("error")}).drop("error")
    return tried.where("error IS NULL").drop("error"), failed.unionByName(pending.where(F.col("attempts") >= most))


def recompute_touched(turns: DataFrame, batch: DataFrame, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Aggregates of the sessions that a batch touches, from all their turns."""
    return aggregate(turns.join(batch.select("session_id").distinct(), "session_id", "left_semi"))
