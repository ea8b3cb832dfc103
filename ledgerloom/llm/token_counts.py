"""Token counts by section, through character offsets.

Method: each document is encoded once, whole. The byte lengths of its tokens give the character
span of every token; the spans are interval-joined to the document's sections (sorted, disjoint
character spans), and tokens that cross a boundary are allocated by one explicit rule:

* a token belongs to the section that holds most of its characters;
* of sections that hold equally many, the earliest gets it;
* a token that touches no section is counted in the row whose section is null.

So the rows of a document sum to its token count. The default sections are its lines, each with
its line end, which tile the text.

Defined results: null and empty texts have one section 0 of no characters and no tokens; null ids
pass through; repeated rows are counted once each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import text_encoder
from .common import slices, texts_of

SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long"


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines; a line holds its line end."""
    lines = text.split("\n")
    starts = np.cumsum(np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines)))
    ends = np.append(starts[:-1], len(text))
    starts = np.append(0, starts[:-1])
    if len(lines) > 1 and not lines[-1]:  # nothing follows the last line end
        starts, ends = starts[:-1], ends[:-1]
    return starts, ends


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span of each token, from the tokens' byte lengths; tokens inside one character share its span."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        return starts, ends
    letter = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return letter[starts], letter[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and crossing tokens of each section, and tokens outside all of them."""
    n = len(begins)
    first = np.searchsorted(stops, starts, "right")  # the first section that ends after the token's start
    after = np.searchsorted(begins, ends, "left")  # the first that begins at or after its end
    inside = (after - first == 1) & (begins[np.minimum(first, n - 1)] <= starts) & (ends <= stops[np.minimum(first, n - 1)]) if n else np.zeros(len(starts), bool)
    counts, crossing = np.bincount(first[inside], minlength=n), np.zeros(n, np.int64)
    outside = 0
    for k in np.flatnonzero(~inside).tolist():
        own = range(int(first[k]), int(after[k]))
        if not own:
            outside += 1
            continue
        best = max(own, key=lambda s: (min(ends[k], stops[s]) - max(starts[k], begins[s]), -s))
        counts[best] += 1
        crossing[best] += 1
    return counts, crossing, outside


def count_by_section(docs: DataFrame, tokenizer_path: str, sections: str | None = None) -> DataFrame:
    """One row a section: doc_id, section (from 0; null: outside all), char_start, char_end, n_tokens, n_crossing.

    ``sections`` names an array<struct<start, end>> column of sorted, disjoint character spans
    (fields, for instance); without it the lines are the sections.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        width = np.array([len(b) for b in encoder.bpe.token_bytes], np.int64)
        for batch in slices(batches):
            texts = texts_of(batch)
            spans = batch.column("sections").to_pylist() if sections else [None] * len(texts)
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text, ids, own in zip(batch.column("doc_id").to_pylist(), texts, encoder.encode(texts), spans, strict=True):
                starts, ends = token_spans(text, width[ids]) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                begins, stops = (np.array([s["start"] for s in own or []], np.int64), np.array([s["end"] for s in own or []], np.int64)) if sections else line_sections(text)
                counts, crossing, outside = allocate(starts, ends, begins, stops)
                numbers = list(range(len(begins)))
                if outside:
                    numbers, begins, stops = [*numbers, None], np.append(begins, 0), np.append(stops, 0)
                    counts, crossing = np.append(counts, outside), np.append(crossing, 0)
                for column, values in zip(rows, ([doc_id] * len(numbers), numbers, begins.tolist(), stops.tolist(), counts.tolist(), crossing.tolist()), strict=True):
                    column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    own = docs.select("doc_id", "text", docs[sections].alias("sections")) if sections else docs.select("doc_id", "text")
    return own.mapInArrow(run, SCHEMA)
