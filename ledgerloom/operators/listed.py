"""Redaction of listed values, of which there may be very many.

A chain of ``replace`` grows the plan with the list. Here a text's bytes are looked up in a table of the
values' first BLOCK bytes: each place of a text gives a block, a bitmap of block hashes lets few places
through, and only there are whole values compared. The table goes to the tasks with the query while it has at
most TABLE_BYTES; a longer list is cut into tables, longest values first, which are applied one after the other.

What is replaced is what the chain replaces: the longest value first, of equal lengths the first in order,
each wherever it stands, marks of those before it included.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .governance import LEAST_LITERAL

MARK = "[REDACTED:env]"
#: Bytes of a block; no listed value is shorter.
BLOCK = LEAST_LITERAL
#: Bytes of values that one table holds, and of a text that are looked up at a time.
TABLE_BYTES, STEP = 32 << 20, 1 << 20
_HASH_BITS = 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Values (bytes) in the order of the chain, findable by their first block."""

    def __init__(self, values: list[bytes]):
        self.values = values
        blocks = np.frombuffer(b"".join(v[:BLOCK] for v in values), "<u8")
        self.order = np.argsort(blocks, kind="stable")
        self.blocks = blocks[self.order]
        self.some = np.zeros(1 << _HASH_BITS, bool)
        self.some[self._hash(blocks)] = True

    @staticmethod
    def _hash(blocks: np.ndarray) -> np.ndarray:
        return (blocks * _FACTOR) >> np.uint64(64 - _HASH_BITS)

    def first(self, text: bytes, after: int) -> int | None:
        """The least number beyond ``after`` of a value that the text holds."""
        best = None
        for at in range(0, len(text) - BLOCK + 1, STEP):
            raw = np.frombuffer(text[at : at + STEP + BLOCK - 1], np.uint8).astype(np.uint64)
            n = len(raw) - BLOCK + 1
            block = raw[:n].copy()
            for k in range(1, BLOCK):
                block |= raw[k : n + k] << np.uint64(8 * k)
            places = np.flatnonzero(self.some[self._hash(block)])
            low, high = np.searchsorted(self.blocks, block[places]), np.searchsorted(self.blocks, block[places], "right")
            for place, a, b in zip((places + at)[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                # Numbers of values with one block rise, as the sort was stable.
                numbers = self.order[a:b]
                for number in numbers[bisect_left(numbers, after + 1) :].tolist():
                    if best is not None and number >= best:
                        break
                    if text.startswith(self.values[number], place):
                        best = number
                        break
        return best

    def clean(self, text: str) -> str:
        raw, number = text.encode("utf-8", "surrogatepass"), self.first(text.encode("utf-8", "surrogatepass"), -1)
        while number is not None:
            raw = raw.replace(self.values[number], MARK.encode())
            number = self.first(raw, number)
        return raw.decode("utf-8", "surrogatepass")


def tables(values: Iterable[str]) -> Iterator[list[bytes]]:
    """The distinct values of BLOCK bytes or more, in the chain's order, cut at TABLE_BYTES."""
    every = sorted({v for v in values if len(v.encode()) >= BLOCK}, key=lambda v: (-len(v), v))
    part, size = [], 0
    for v in (v.encode() for v in every):
        if part and size + len(v) > TABLE_BYTES:
            yield part
            part, size = [], 0
        part.append(v)
        size += len(v)
    if part:
        yield part


def redact_listed(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """df with every listed value in the column (text) replaced by MARK. Null stays null; values of fewer than BLOCK bytes are no secrets."""
    schema = df.schema
    for part in tables(values):

        def run(batches: Iterator[pa.RecordBatch], part: list[bytes] = part) -> Iterator[pa.RecordBatch]:
            table = Table(part)
            for batch in batches:
                k = batch.schema.get_field_index(column)
                texts = [None if t is None else table.clean(t) for t in batch.column(k).to_pylist()]
                yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

        df = df.mapInArrow(run, schema)
    return df
