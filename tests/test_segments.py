"""Segmented scans against plain windows, and rollouts whose contexts change."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import jsonl, rollout
from ledgerloom.operators import segments


@pytest.mark.parametrize("width", [3, 64, 1 << 20])
def test_equals_a_window(spark, width):
    r = random.Random(width)
    rows = [(0 if k % 3 else k % 7, k, r.choice((None, "a", "b", "c")), r.randint(0, 3), r.random() < 0.3) for k in range(2000)]
    df = spark.createDataFrame(rows, "s int, k long, m string, n long, own boolean").repartition(5)
    upto = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("s", "k", "n", "own", F.sum("n").over(upto).alias("t"), F.last("m", ignorenulls=True).over(upto).alias("m"))
    got = segments.carried(df, ["s"], "k", sums={"t": F.col("n")}, lasts={"m": F.col("m")}, width=width)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    numbers = {}
    for s, k, _, _, own in rows:
        last, number = numbers.get(s, (None, 0))[-2:] if s in numbers else (None, 0)
        numbers.setdefault(s, (None, 0))
        number += own or last is None or last
        numbers[s] = (own, number)
        numbers[s, k] = number
    isles = segments.islands(df, ["s"], "k", F.col("own"), "island", width=width).collect()
    by = {}
    for row in isles:  # equal numbers where islands are equal, in the same order
        by.setdefault(row.s, {}).setdefault(row.island, set()).add(numbers[row.s, row.k])
    assert all(len(v) == 1 for d in by.values() for v in d.values())
    assert all([min(d[i]) for i in sorted(d)] == sorted({x for v in d.values() for x in v}) for d in by.values())


def test_one_long_session_is_many_tasks(spark):
    """Rows of one key are ordered in ranges: no task reads more than a few of them."""
    df = spark.range(200_000).select(F.lit(1).alias("s"), F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    out = segments.carried(df, ["s"], "k", sums={"t": F.col("n")}, width=10_000)
    assert out.where("t <> k + 1").count() == 0
    sizes = [r.n for r in out.groupBy(F.expr("k DIV 10000"), F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 20 and set(sizes) == {10_000}


def test_rollout_contexts(spark):
    """Model and directory as last known when a turn ends, branch and session from the metadata, blocks numbered within turns."""
    message = lambda role, *parts: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": p, "text": t} for p, t in parts]}}
    lines = [
        {"type": "session_meta", "payload": {"id": "sid", "cwd": "/a", "git": {"branch": "main"}}},
        {"type": "turn_context", "payload": {"model": "m1"}},
        message("user", ("input_text", "hello")),
        message("assistant", ("output_text", "one"), ("other", "x")),
        {"type": "response_item", "payload": {"type": "reasoning", "encrypted_content": "abc"}},
        {"type": "turn_context", "payload": {"cwd": "/b", "model": None}},
        message("assistant", ("output_text", "two"), ("output_text", "three")),
        message("developer", ("other", "unreadable")),
        {"type": "turn_context", "payload": {"model": "m2"}},
        {"type": "response_item", "payload": {"type": "mystery"}},
        message("user", ("input_text", "bye")),
        {"type": "session_meta", "payload": {"id": "other", "git": {"branch": None}}},
        message("assistant", ("output_text", "é")),
    ]
    rows = [("f", 100 * k, f"t{k}", x["type"], json.dumps(x["payload"])) for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "path string, offset long, timestamp string, type string, payload string").repartition(3)
    numbered = rollout.numbered_items(df, F.lit("fallback"))
    got = [(r.turn_uuid, r.role, r.timestamp, r.model, r.cwd, r.git_branch, r.blocks, r.bytes) for r in rollout.turn_rows(numbered).orderBy("turn").collect()]
    assert got == [
        ("sid:t0", "user", "t2", "m1", "/a", "main", 1, 5),
        ("sid:t1", "assistant", "t3", "m1", "/b", "main", 4, 14),
        ("sid:t2", "user", "t10", "m2", "/b", "main", 1, 3),
        ("sid:t3", "assistant", "t12", "m2", None, None, 1, 2),
    ]
    blocks = [(r.turn_uuid, r.block_index, r.kind, r.byte_len) for r in rollout.turn_blocks(numbered).orderBy("turn_uuid", "block_index").collect()]
    assert blocks == [("sid:t0", 0, "input_text", 5), ("sid:t1", 0, "output_text", 3), ("sid:t1", 1, "reasoning", 3), ("sid:t1", 2, "output_text", 3), ("sid:t1", 3, "output_text", 5), ("sid:t2", 0, "input_text", 3), ("sid:t3", 0, "output_text", 2)]


def test_blank_lines_and_float_sizes(spark):
    lines = {"": True, "\r": True, "\t \x0b\r": True, " 　": True, "x\r": False, " . ": False}
    df = spark.createDataFrame([(k,) for k in lines], "v string")
    assert {r.v: r.b for r in df.select("v", jsonl.blank(F.col("v")).alias("b")).collect()} == lines
    sizes = {'{"a": 1.0}': '{"a":1.0}', "[1e10, -0.0, 0.00001, 1e-6]": "[10000000000.0,-0.0,0.00001,1e-6]", "[1e16, 1e15, 12.50]": "[1e16,1000000000000000.0,12.5]", "[18446744073709551616, 18446744073709551615]": "[1.8446744073709552e19,18446744073709551615]", '["1.0 \\" 2e5", 3]': '["1.0 \\" 2e5",3]'}
    df = spark.createDataFrame([(k,) for k in sizes], "v string")
    assert {r.v: r.n for r in df.select("v", jsonl.compact_bytes(F.get_json_object("v", "$")).alias("n")).collect()} == {k: len(v) for k, v in sizes.items()}


def test_pages_by_rank(spark, tmp_path):
    """Any page equals the sorted one, from ranges that the files' statistics find."""
    r = random.Random(5)
    keys = sorted({r.choice((r.randint(-500, 500), r.randint(10_000, 10_050), r.randint(0, 10**6))) for _ in range(900)})
    path = str(tmp_path / "rows")
    spark.createDataFrame([(k, str(k)) for k in r.sample(keys, len(keys))] + [(None, "x")], "k long, v string").repartitionByRange(6, "k").write.parquet(path)
    df = spark.read.parquet(path)
    counts = segments.range_counts(df, "k", 64).cache()
    for offset, limit in ((0, 5), (37, 20), (len(keys) - 3, 10), (len(keys), 4), (200, 300)):
        page = segments.page_by_rank(df, "k", offset, limit, counts, 64)
        assert [x.k for x in page.collect()] == keys[offset : offset + limit]
    plan = segments.page_by_rank(df, "k", 100, 10, counts, 64)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k," in plan and "LessThan(k," in plan
