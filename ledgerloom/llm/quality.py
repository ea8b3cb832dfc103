"""Repetition rules from a suffix array.

Method: over the words of each document a suffix array is built by prefix doubling; the longest
common prefixes of its neighbours give, for each word, the longest passage starting there that
the text holds twice. The spans of these maximal repeats of at least MIN_REPEAT words are united,
and a document is rejected when they cover too much of it or when one of them is too long.
Suffix arrays are built for many documents at once, a word of one document never equal to a word
of another; documents in which no window of MIN_REPEAT words recurs (found by hashes, which miss
none) have no such repeat and need no array.

Defined results: null and empty texts have no words and fail the base rules (n_words < 20), as
does any short text; null ids pass through; repeated rows get a row each; ``keep_good`` returns
the input's columns; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_slices, texts_of

MIN_WORDS = 20
MIN_REPEAT = 8
BASE_REPEAT_PERCENT = 30
#: The method's own limits: share of words inside maximal repeats, and words of the longest one.
MAX_COVERED = 0.25
MAX_LONGEST = 50

#: Bytes of texts that a task works on at a time.
STEP_BYTES = 1 << 20

#: White space and symbol characters of the rules (fixed values).
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest passage that starts there and recurs in ids."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    step = 1
    while step < n and int(ranks[-1].max()) + 1 < n:
        low = ranks[-1].astype(np.int64)
        high = np.zeros(n, np.int64)
        high[:-step] = low[step:] + 1
        ranks.append(np.unique(low * (n + 1) + high, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    one, other, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 1 << level, ranks[level]
        a, b = one + common, other + common
        fits = np.maximum(a, b) + width <= n
        same = fits & (rank[np.where(fits, a, 0)] == rank[np.where(fits, b, 0)])
        common += width * same
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, one, common)
    np.maximum.at(longest, other, common)
    return longest


def _recurring(words: list[list[bytes]], lengths: np.ndarray) -> np.ndarray:
    """Documents in which some window of MIN_REPEAT words recurs."""
    owner = np.repeat(np.arange(len(words)), lengths)
    n = len(owner) - MIN_REPEAT + 1
    if n < 2:
        return np.zeros(0, np.int64)
    each = np.fromiter((h for own in words for h in map(hash, own)), np.int64, len(owner)).astype(np.uint64) * _MIX
    window = owner[:n].astype(np.uint64)
    for k in range(MIN_REPEAT):
        window = (window ^ (window >> np.uint64(29))) * _MIX + each[k : n + k]
    whole = owner[:n] == owner[MIN_REPEAT - 1 :]
    window, owner = window[whole], owner[:n][whole]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    return np.unique(owner[order[1:][same]])


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of NAMES for each text."""
    words = [t.encode().split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(texts))
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, WHITE)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.zeros(len(texts), np.int64),
        "n_repeat_words": np.zeros(len(texts), np.int64),
        "longest_repeat": np.zeros(len(texts), np.int64),
    }
    for k, text in enumerate(texts):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(WHITE)]
            out["n_dup_lines"][k] = len(lines) - len(set(lines))
    at = _recurring(words, n_words).tolist()
    if at:
        numbers: dict[tuple[int, bytes], int] = {}
        ids, starts = [], []
        for k in at:
            starts.append(len(ids))
            seen: dict[bytes, int] = {}
            base = len(numbers)
            ids += [base + seen.setdefault(w, len(seen)) for w in words[k]]
            numbers.update(((k, w), base + v) for w, v in seen.items())
            numbers[k, b""] = len(numbers)
            ids.append(numbers[k, b""])  # an end that nothing equals
        longest = repeats(np.array(ids, np.int64))
        begin = np.flatnonzero(longest >= MIN_REPEAT)
        depth = np.zeros(len(ids) + 1, np.int64)
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + longest[begin], -1)
        out["n_repeat_words"][at] = np.add.reduceat((np.cumsum(depth[:-1]) > 0).astype(np.int64), starts)
        out["longest_repeat"][at] = np.maximum.reduceat(longest, starts)
    return out


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of NAMES, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, STEP_BYTES):
            got = measure(texts_of(batch))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(got[n]) for n in NAMES)], names=["doc_id", *NAMES])

    return _judged(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES)))


def _judged(counted: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    fine = (F.col("n_repeat_words") <= MAX_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= MAX_LONGEST)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns, in one pass without a shuffle."""
    fields, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = fields.index("text")
        for batch in sized_slices(batches, STEP_BYTES):
            got = measure([t or "" for t in batch.column(place).to_pylist()])
            words, repeated = got["n_words"], got["n_repeat_words"]
            good = (words >= MIN_WORDS) & (100 * repeated <= BASE_REPEAT_PERCENT * words) & (repeated <= MAX_COVERED * words) & (got["longest_repeat"] <= MAX_LONGEST)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
