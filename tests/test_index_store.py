"""The index that grows: a second run equals a full one, touches only its buckets, keeps receipts, and survives what dies between writes."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import indexing
from ledgerloom.plans import index_queries
from ledgerloom.sources import tail
from ledgerloom.sources.index_store import Conflict, Store

PATTERNS = ("mv-[0-9]+",)


def entry(uuid, session, second, role="assistant", **more):
    message = {"role": role, "model": more.pop("model", None), "content": [{"type": "text", "text": f"text {uuid}"}, {"type": "tool_use", "name": "Read", "input": {"a": 1.0}}], "usage": {"output_tokens": 9}}
    return json.dumps({"type": role, "uuid": uuid, "sessionId": session, "timestamp": f"2024-01-01T00:00:{second:02}Z", "message": message} | more)


def tables(spark, root, version=None, source=None):
    store = Store(spark, str(root), 4)
    v = store.version(version)
    out = {}
    for name in ("files", "turns", "sessions", "blocks", "signatures"):
        if name in v.tables:
            out[name] = sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in store.read(v, name).collect())
    return out


def update(spark, files, root, **more):
    return indexing.update_index(spark, str(files), str(root), PATTERNS, buckets=4, **more)


def grow(files, r, step):
    """Files get lines, whole or begun; new files come, before and after the old ones in order; uuids recur in other files and sessions."""
    for name in ("b", "d", "a" if step else "x", "sub/c"):
        path = files / f"{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a") as f:
            if path.stat().st_size == 0 and name == "d":
                f.write("\r\n{broken\n")
            for k in range(r.randint(0, 6)):
                f.write(r.choice((entry(f"u{r.randint(0, 25)}", f"s{r.randint(0, 5)}", k, cwd=f"/{step}"), entry(f"{name}{step}{k}", f"s{r.randint(0, 5)}", k, model=f"m{k}"), "{oops", " \r")) + "\n")
            if r.random() < 0.6:
                line = entry(f"{name}{step}last", "s1", 50, version="v1")
                cut = r.choice((len(line), len(line) // 2))
                f.write(line[:cut])
                (files / "rest").mkdir(exist_ok=True)
                (files / "rest" / f"{name.replace('/', '_')}.txt").write_text(line[cut:] + "\n")
    return files


def finish(files):
    """The rest of the lines that were begun."""
    for rest in (files / "rest").glob("*.txt") if (files / "rest").exists() else ():
        with (files / f"{rest.stem.replace('_', '/')}.jsonl").open("a") as f:
            f.write(rest.read_text())
        rest.unlink()


@pytest.mark.parametrize("seed", [1])
def test_runs_over_grown_files_equal_a_full_run(spark, tmp_path, seed):
    r, files = random.Random(seed), tmp_path / "in"
    files.mkdir()
    for step in range(3):
        finish(files)
        grow(files, r, step)
        update(spark, files, tmp_path / "grown")
    update(spark, files, tmp_path / "whole")
    assert tables(spark, tmp_path / "grown") == tables(spark, tmp_path / "whole")
    before = tables(spark, tmp_path / "grown")
    update(spark, files, tmp_path / "grown", full=True)
    assert tables(spark, tmp_path / "grown") == before


def write(path, *lines):
    with path.open("a") as f:
        f.write("".join(x + "\n" for x in lines))


def test_only_touched_buckets_and_receipts(spark, tmp_path):
    files, root = tmp_path / "in", tmp_path / "root"
    files.mkdir()
    for k in range(12):
        write(files / f"f{k}.jsonl", entry(f"t{k}", f"s{k}", 1), entry(f"v{k}", f"s{k}", 2))
    first = update(spark, files, root)
    receipts = spark.createDataFrame([("s3", "t3", "r3"), ("s4", "t4", "r4"), ("s4", "none", "x")], "session_id string, turn_uuid string, kernel_event_id string")
    second = indexing.record_receipts(spark, str(root), receipts, 4)
    write(files / "f3.jsonl", entry("w3", "s3", 3))
    third = update(spark, files, root)
    store = Store(spark, str(root), 4)
    bucket = str(spark.range(1).select(store.bucket(F.lit("s3"))).first()[0])
    for name in ("turns", "sessions", "blocks", "signatures"):
        old, new = second.tables[name]["parts"], third.tables[name]["parts"]
        assert {b for b in new if new[b] != old.get(b)} <= {bucket}, name
    assert third.tables["turns"]["parts"][bucket] != first.tables["turns"]["parts"][bucket]
    held = {r.turn_uuid: r.kernel_event_id for r in store.read(third, "turns").where("kernel_event_id IS NOT NULL").collect()}
    assert held == {"t3": "r3", "t4": "r4"}
    again = update(spark, files, root, full=True)
    assert {r.turn_uuid: r.kernel_event_id for r in store.read(again, "turns").where("kernel_event_id IS NOT NULL").collect()} == held
    assert update(spark, files, root) == again  # nothing new: no version


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    files, root = tmp_path / "in", tmp_path / "root"
    files.mkdir()
    write(files / "a.jsonl", entry("t1", "s1", 1))
    update(spark, files, root)
    before = tables(spark, root)
    write(files / "a.jsonl", entry("t2", "s1", 2), entry("t3", "s2", 2))
    real = Store.write

    for deadly in ("turns", "keys"):

        def write_until(self, run, table, rows, deadly=deadly):
            if table == deadly:
                raise RuntimeError("killed")
            return real(self, run, table, rows)

        monkeypatch.setattr(Store, "write", write_until)
        with pytest.raises(RuntimeError, match="killed"):
            update(spark, files, root)
        assert tables(spark, root) == before
    monkeypatch.setattr(Store, "write", real)
    store = Store(spark, str(root), 4)
    base = store.version()
    update(spark, files, root)
    with pytest.raises(Conflict):  # a run from the version before comes too late
        store.publish(base, "run-late", {}, {})
    after = tables(spark, root)
    assert len(after["turns"]) == 3
    assert len(store.vacuum(keep=1)) >= 2  # the dead runs, and those that no bucket has any more
    assert tables(spark, root) == after


def test_rollouts_are_replaced_with_their_children(spark, tmp_path):
    files, root = tmp_path / "in", tmp_path / "root"
    files.mkdir()
    message = lambda role, text: json.dumps({"timestamp": text, "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}})
    meta = json.dumps({"type": "session_meta", "payload": {"id": "sid", "cwd": "/w"}})
    write(files / "rollout-1.jsonl", meta, message("user", "a"), message("assistant", "bb"), message("assistant", "ccc"))
    write(files / "rollout-2.jsonl", message("user", "x"), "{bad")
    go = lambda **k: indexing.update_rollouts(spark, str(files), str(root), buckets=4, **k)
    go()
    write(files / "t.jsonl", entry("cc", "sid2", 1))
    indexing.update_index(spark, str(files), str(root), PATTERNS, glob="t.jsonl", buckets=4)
    indexing.record_receipts(spark, str(root), spark.createDataFrame([("sid", "sid:t0", "r0"), ("sid", "sid:t1", "r1")], "session_id string, turn_uuid string, kernel_event_id string"), 4)
    write(files / "rollout-1.jsonl", message("assistant", "dd"), message("user", "e"))
    go()
    got = tables(spark, root)
    turns = {json.loads(t)["turn_uuid"]: json.loads(t) for t in got["turns"]}
    assert {k: (t["n_blocks"], t["visible_text_bytes"], t["kernel_event_id"], t["cwd"]) for k, t in turns.items() if k != "cc"} == {"sid:t0": (1, 1, "r0", "/w"), "sid:t1": (3, 7, "r1", "/w"), "sid:t2": (1, 1, None, "/w"), "2:t0": (1, 1, None, None)}
    assert sorted((json.loads(b)["turn_uuid"], json.loads(b)["block_index"]) for b in got["blocks"]) == [("2:t0", 0), ("cc", 0), ("cc", 1), ("sid:t0", 0), ("sid:t1", 0), ("sid:t1", 1), ("sid:t1", 2), ("sid:t2", 0)]
    sessions = {json.loads(s)["session_id"]: json.loads(s) for s in got["sessions"]}
    assert (sessions["sid"]["turn_count"], sessions["sid"]["first_cwd"], sessions["sid"]["source"]) == (3, "/w", "rollout")
    go(full=True)
    assert tables(spark, root) == got
    files_now = {json.loads(f)["path"].rsplit("/", 1)[1]: (json.loads(f)["lines"], json.loads(f)["bad_lines"]) for f in got["files"]}
    assert files_now == {"rollout-1.jsonl": (6, 0), "rollout-2.jsonl": (2, 1), "t.jsonl": (1, 0)}


def test_files_are_written_and_read_in_small_pieces(spark, tmp_path, monkeypatch):
    """Python used to hold batches of 10,000 lines: on writing any number of bytes, on reading 8 MB and their copies."""
    rows = [(k % 3, 1000 - k, f'{{"line": "{k} é {"x" * 5000}"}}') for k in range(1000)]
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", None)
    for part in (rows, rows[:10]):  # the second time shorter ones take their place
        index_queries.write_named(spark.createDataFrame(part, "file int, ord int, value string"), f"file://{tmp_path}/named")
        for f in range(3):
            assert (tmp_path / "named" / f"file-{f}.jsonl").read_text() == "".join(v + "\n" for n, _, v in reversed(part) if n == f)
    index_queries.write_named(spark.createDataFrame(rows, "file int, ord int, value string"), f"file://{tmp_path}/named")
    found = tail.listed(f"file://{tmp_path}/named", "*.jsonl")
    assert len(found) == 3
    batches = [b for part in tail.parts(found, {}) for b in tail.rows(part)]
    assert sum(b.num_rows for b in batches) == 1000 and max(b.nbytes for b in batches) < 2 << 20
