"""What the operators of this subpackage share: table access, checkpoints, a bounded chunk cache."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Unicode White_Space, as the tokenizers' regular expressions read ``\s`` (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
#: Separators that ``str.split`` treats as white space although White_Space does not hold them.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SOLID = re.compile(f"[^{WHITE}]+")

#: Rows of an Arrow batch that Python holds as objects at a time.
SLICE_ROWS = 256
#: Bytes of texts that a task works on at a time, where rows alone do not bound them.
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    here = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(here)
    return df.checkpoint()


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Small slices of the batches, so that a task never holds many texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES, *names: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose columns ``names`` (text) have at most ``size`` bytes in all, but one row at least."""
    for batch in batches:
        upto = np.cumsum(sum(pc.binary_length(batch.column(n)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names or ("text",)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def solid_chunks(text: str) -> list[str]:
    """Maximal runs without White_Space."""
    return _SOLID.findall(text) if _ODD_SPACE.search(text) else text.split()


class ChunkCache:
    """Chunk -> encoded bytes, for chunks that are encoded alone.

    Two generations of at most ``limit`` bytes each beside those of the current slice: what is used
    again moves to the younger one, and when that is full it becomes the older, whose chunks that
    were not used meanwhile go. So frequent chunks stay. Chunks longer than ``longest`` never stay.
    """

    #: About what a chunk takes beside its letters and ids.
    OVERHEAD = 160

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 96 << 20, longest: int = 64):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def encode(self, chunked: list[list[str]]) -> list[bytes]:
        """For each list of chunks, their encodings joined."""
        young, old = self.young, self.old
        missing = set().union(*chunked).difference(young)
        again = {c: old[c] for c in missing if c in old}
        fresh = list(missing.difference(again))
        young.update(again)
        young.update(zip(fresh, self.encode_many(fresh), strict=True))
        out = [b"".join(map(young.__getitem__, chunks)) for chunks in chunked]
        for c in fresh:
            if len(c) > self.longest:
                del young[c]
        self.bytes += sum(self.OVERHEAD + len(c) + len(young[c]) for c in missing if c in young)
        if self.bytes > self.limit:
            self.old, self.young, self.bytes = young, {}, 0
        return out


def quiet_tokenizers() -> None:
    """One thread a task: Spark already uses every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
