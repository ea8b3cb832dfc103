"""Tail reads against plain reads of whole files."""

from __future__ import annotations

import os
import random

import pytest

from ledgerloom.sources import tail


def brute(path, start):
    """(offset, bytes, ended) of the lines of a file from a byte on; a line that was begun is dropped."""
    data = path.read_bytes()
    if start and data[start - 1 : start] != b"\n":
        cut = data.find(b"\n", start)
        start = len(data) if cut < 0 else cut + 1
    out = []
    while start < len(data):
        cut = data.find(b"\n", start)
        end = len(data) if cut < 0 else cut
        out.append((start, data[start:end], cut >= 0))
        start = end + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_parts_hold_every_line_once(tmp_path, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(tail, "CHUNK", r.choice((1, 3, 7, 1000)))
    path = tmp_path / "a.txt"
    data = b"\n".join(bytes(r.choices(b"ab\xc3\xa9", k=r.choice((0, 0, 1, 5, 40)))) for _ in range(60)) + r.choice((b"", b"\n"))
    path.write_bytes(data)
    for start in (0, 1, len(data) // 2, len(data) - 1, len(data)):
        for size in (1, 4, 33, 10_000):
            got = [x for p in tail.parts({str(path): len(data)}, {str(path): start}, size) for x in tail.lines(p)]
            assert got == brute(path, start), (start, size)


def collect(df):
    return sorted((os.path.basename(r.path), r.offset, r.value, r.ended) for r in df.collect())


def test_only_what_is_new(spark, tmp_path, monkeypatch):
    a, b, skip = tmp_path / "a b.jsonl", tmp_path / "deep" / "b.jsonl", tmp_path / "c.other"
    b.parent.mkdir()
    a.write_bytes(b"one\ntwo\n")
    b.write_bytes("é\nha".encode())
    skip.write_bytes(b"no\n")
    first = tail.read_tail(spark, str(tmp_path), "*.jsonl")
    assert collect(first) == [("a b.jsonl", 0, "one", True), ("a b.jsonl", 4, "two", True), ("b.jsonl", 0, "é", True), ("b.jsonl", 3, "ha", False)]
    ends = {r.path: r.offset + r.size for r in first.orderBy("offset").collect()}
    with a.open("ab") as f:
        f.write(b"three\n\xff\n")
    with b.open("ab") as f:
        f.write(b"lf\nnext\n")
    grown = tail.read_tail(spark, f"file://{tmp_path}", "*.jsonl", ends)
    assert collect(grown) == [("a b.jsonl", 8, "three", True), ("a b.jsonl", 14, "�", True), ("b.jsonl", 8, "next", True)]
    # Bytes read are bytes appended, and one before them.
    seen = []
    monkeypatch.setattr(tail, "_open", lambda p, was=tail._open: (lambda fs, path, head: (Counted(fs, seen), path, head))(*was(p)))
    for p in tail.parts({str(a): a.stat().st_size}, {str(a): 8}):
        list(tail.lines(p))
    assert sum(seen) == a.stat().st_size - 8 + 1
    a.write_bytes(b"short")
    assert [p for p in tail.parts({str(a): 5}, {str(a): 8})] == []


class Counted:
    def __init__(self, fs, seen):
        self.fs, self.seen = fs, seen

    def open_input_file(self, path):
        f, seen = self.fs.open_input_file(path), self.seen

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

            def seek(self, at):
                f.seek(at)

            def read(self, n):
                out = f.read(n)
                seen.append(len(out))
                return out

        return File()


def test_a_stream_reads_each_byte_once(spark, tmp_path):
    files, sink = tmp_path / "in", tmp_path / "out"
    files.mkdir()
    (files / "x.jsonl").write_text("1\n2\n")

    def run():
        q = tail.stream_tail(spark, str(files), "*.jsonl", part=3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(sink))
        q.awaitTermination()
        return sorted((os.path.basename(r.path), r.value) for r in spark.read.parquet(str(sink)).collect())

    assert run() == [("x.jsonl", "1"), ("x.jsonl", "2")]
    with (files / "x.jsonl").open("a") as f:
        f.write("3\n")
    (files / "y.jsonl").write_text("4\n\n5\n")
    assert run() == [("x.jsonl", "1"), ("x.jsonl", "2"), ("x.jsonl", "3"), ("y.jsonl", ""), ("y.jsonl", "4"), ("y.jsonl", "5")]
    assert run() == run()
    assert tail.read_tail(spark, str(tmp_path / "none")).collect() == []
