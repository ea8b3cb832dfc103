"""Tail reads: a data source over the bytes of files that have not been read yet.

    spark.dataSource.register(TailSource)
    spark.read.format("tail").option("glob", "*.jsonl").option("state", state_json).load(folder)
    spark.readStream.format("tail").option("glob", "*.jsonl").load(folder)

A partition is (file, from byte, to byte); of a grown file only what was appended is read. The offset of a
stream is a map of file ends. A row is a line: path, file_name, offset (of its first byte), size (with its
end), value and ended (whether a line feed ends it). Rules:

* a line belongs to the part in which it begins, which reads on to its end, but not beyond the end of the
  file when it was listed;
* where reading begins within a line, the rest of that line is dropped;
* a last line without an end comes as it is; ``ended`` tells, and whoever keeps the state decides whether
  it counts (``operators.indexing`` takes it again later unless it is whole);
* a file that has shrunk below what was read of it is left alone until it is longer again;
* bytes that are no UTF-8 come as replacement characters.

Files are opened by pyarrow, so any address that it knows will do. A path in a row is the address as
``address`` gives it. Names and ends are held by the driver, as with any read of files.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, file_name string, offset long, size long, value string, ended boolean"
#: Bytes of a part, read at a time, and of a batch of lines, and lines of a batch.
PART, CHUNK, BATCH, BATCH_LINES = 64 << 20, 1 << 20, 1 << 20, 2_000


def _open(address: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system, the path in it, and what stands before such a path in an address. Paths in addresses are plain, not percent-encoded."""
    scheme, _, rest = address.rpartition("://")
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + rest.removeprefix("file:").lstrip("/"), "file://"
    authority, slash, path = rest.partition("/")
    fs, root = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    root = root.rstrip("/")
    return fs, root + slash + path, f"{scheme}://{authority}".removesuffix(root)


def listed(folder: str, glob: str) -> dict[str, int]:
    """Addresses of the files below folder whose names fit, with their lengths."""
    fs, path, head = _open(folder)
    files = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return {head + f.path: f.size for f in files if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and not f.base_name.startswith(("_", "."))}


class Part(InputPartition):
    """Bytes start to end of a file that was ``length`` long; ``first`` if reading begins here."""

    def __init__(self, path: str, start: int, end: int, length: int, first: bool):
        self.path, self.start, self.end, self.length, self.first = path, start, end, length, first


def parts(ends: dict[str, int], read: dict[str, int], size: int = PART) -> list[Part]:
    """What is new of every file, in parts of at most ``size`` bytes."""
    return [Part(path, at, min(at + size, end), end, at == read.get(path, 0)) for path, end in sorted(ends.items()) for at in range(read.get(path, 0), end, size)]


def lines(part: Part) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes without the line feed, whether there was one) of the lines that begin in a part."""
    fs, path, _ = _open(part.path)
    with fs.open_input_file(path) as f:
        at = max(part.start - 1, 0)
        f.seek(at)
        kept, begins = b"", part.start == 0
        while at < part.length:
            chunk = f.read(min(CHUNK, part.length - at))
            if not chunk:
                break
            at += len(chunk)
            *whole, kept = (kept + chunk).split(b"\n") if b"\n" in chunk else (kept + chunk,)
            begin = at - len(kept) - sum(len(w) + 1 for w in whole)
            for line in whole:
                if begins:
                    if begin >= part.end:
                        return
                    yield begin, line, True
                begins = True
                begin += len(line) + 1
            if not begins:  # within a line of the part before, whose bytes are not needed
                kept = b""
        begin = at - len(kept)
        if begins and kept and begin < part.end:
            yield begin, kept, False


def rows(part: Part | None) -> Iterator[pa.RecordBatch]:
    """Lines in batches of about BATCH bytes. Spark asks for the part None where there is none."""
    if part is None:
        return
    name = part.path.rsplit("/", 1)[-1]
    held: list[tuple[int, bytes, bool]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = [
            pa.array([part.path] * len(held)), pa.array([name] * len(held)), pa.array([o for o, _, _ in held], pa.int64()), pa.array([len(v) + e for _, v, e in held], pa.int64()),
            pa.array([v.decode("utf-8", "replace") for _, v, _ in held], pa.string()), pa.array([e for _, _, e in held], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["path", "file_name", "offset", "size", "value", "ended"])

    for line in lines(part):
        held.append(line)
        size += len(line[1])
        if size >= BATCH or len(held) == BATCH_LINES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Part]:
        read = json.loads(self.options.get("state", "{}"))
        return parts(listed(self.options["path"], self.options.get("glob", "*")), read, int(self.options.get("part", PART)))

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        return rows(partition)


class _Stream(DataSourceStreamReader):
    """A file that has shrunk keeps the end that was read, as long as the stream runs."""

    def __init__(self, options: dict):
        self.options = options
        self.ends: dict[str, int] = json.loads(options.get("state", "{}"))

    def initialOffset(self) -> dict:
        return json.loads(self.options.get("state", "{}"))

    def latestOffset(self) -> dict:
        for path, end in listed(self.options["path"], self.options.get("glob", "*")).items():
            self.ends[path] = max(end, self.ends.get(path, 0))
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(end, start, int(self.options.get("part", PART)))

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        return rows(partition)


class TailSource(DataSource):
    """Options: path, glob (of file names), state (JSON of ends by address that are read already), part (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Stream:  # noqa: ANN001, N802
        return _Stream(dict(self.options))


def read_tail(spark: SparkSession, path: str, glob: str = "*", read: dict[str, int] | None = None, part: int = PART):  # noqa: ANN201
    """The lines of what is new in the files below path; ``read`` has the ends that are known."""
    spark.dataSource.register(TailSource)
    return spark.read.format("tail").option("glob", glob).option("part", part).option("state", json.dumps(read or {})).load(path)


def stream_tail(spark: SparkSession, path: str, glob: str = "*", part: int = PART):  # noqa: ANN201
    """The same as a stream."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("glob", glob).option("part", part).load(path)
