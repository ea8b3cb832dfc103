"""Session state by shares: restarts, ends, silence, and several batches, each against one session at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.streaming import jobs

SCHEMA = "log_index long, event_type string, session_id string, event_ms long, settled_energy long, event_time timestamp"
HOUR = 3_600_000


def test_starts_ends_and_silence_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SESSION_SHARES", 2)
    folder, sink = str(tmp_path / "events"), str(tmp_path / "sink")
    batches = [
        [(0, "x", "a", 1, 1), (1, "x", "a", 1, 2), (2, "x", "b", 2, 4), (3, "x", None, 3, 5), *((10 + k, "x", f"m{k}", 4, k) for k in range(300))],
        [(400, "x", "a", 5, 8), (401, "session_start", "a", 6, 16), (402, "x", "a", 7, 32), (403, "session_end", "b", 8, 64), (404, "x", None, 8, 7)],
        [(500, "x", "b", 9, 128), (501, "x", "z", 100 * HOUR, 1)],
        [(600, "x", "a", 100 * HOUR, 256)],
    ]
    seen = []
    for rows in batches:
        frame = spark.createDataFrame(rows, "log_index long, event_type string, session_id string, event_ms long, settled_energy long")
        frame.withColumn("event_time", F.timestamp_millis("event_ms")).coalesce(1).write.mode("append").parquet(folder)
        jobs.run_once(jobs.session_state(jobs.read_events(spark, folder, SCHEMA), timeout_ms=HOUR, late="1 hour"), sink, "update")
        every = spark.read.parquet(f"{sink}/rows").toPandas()
        seen.append({(r.session_id, r.n, r.energy, r.ended) for r in every.itertuples() if r.session_id is None or not r.session_id.startswith("m")})
    assert seen[0] == {("a", 2, 3, False), ("b", 1, 4, False), (None, 1, 5, False)}
    assert seen[1] - seen[0] == {("a", 2, 48, False), ("b", 2, 68, True), (None, 2, 12, False)}
    # b begins anew after its end; the watermark then passes a, b and the session without an id.
    assert seen[2] - seen[1] == {("b", 1, 128, False), ("z", 1, 1, False), ("a", 2, 48, True), ("b", 1, 128, True), (None, 2, 12, True)}
    assert seen[3] - seen[2] == {("a", 1, 256, False)}
    ended = every[every["session_id"].fillna("").str.startswith("m") & every["ended"]]
    assert sorted(ended["session_id"]) == sorted(f"m{k}" for k in range(300))


def test_a_batch_is_stepped_by_shares():
    """10,000 sessions are one call; each used to be one of its own."""
    rows = pd.DataFrame({"session_id": [f"s{k % 10_000}" for k in range(30_000)], "log_index": range(30_000), "event_type": "x", "settled_energy": 2, "event_ms": 5})
    none = pd.DataFrame({"session_id": pd.Series([], dtype=object), **{c: pd.Series([], dtype="int64") for c in jobs.HELD[1:]}})
    held, told = jobs._step_sessions(none, rows, 0, 10)
    assert len(held) == len(told) == 10_000 and set(held["n"]) == {3} and set(held["energy"]) == {6} and set(held["deadline"]) == {15}
