"""Best-fit packing of token pieces into fixed-length sequences.

Method: bounded-space online best-fit. A lane (a hash share of the pieces, of bounded size) is
packed by one task, in the order of doc_id and piece, whatever their lengths. It keeps at most
OPEN_BINS bins open, indexed by a bitset over free space: the tightest bin that still takes a piece
is the lowest set bit at or above the piece's length. When a new bin is needed and all are open,
the fullest one closes first.

Tokens: the words of many texts are encoded together. The tokenizer drops white space, cuts words
by its own pattern and marks each word's last token, so a text's distinct runs without white space
are cut into words once, distinct words are encoded many in one text, and the ids are gathered back
with arrays. Runs and words that recur are kept from one slice of texts to the next, in arrays of bounded size.

Defined results: a null text counts as empty; an empty text is one piece holding the end id
alone; a null doc_id is packed like any other; repeated rows are packed once each; an empty
table gives no rows. Columns of the input other than doc_id and text are ignored, so clashing
names cannot arise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quiet_tokenizers, sized_slices, solid_chunks

SEQUENCE_TOKENS = 2048
OPEN_BINS = 64
#: Mean documents a lane. Lanes grow in number, not in size, with the table.
LANE_DOCUMENTS = 16_384
#: Lanes number their sequences apart from each other.
LANE_STRIDE = 1 << 36
END_ID = 0
#: Bytes of texts that a task works on at a time, and words that are encoded at a time; the library takes some hundred bytes a token.
STEP_BYTES = 2 << 20
WORDS_AT_ONCE = 8192
#: Words that are joined to one text; with more of them the library takes longer a word.
WORDS_A_TEXT = 256
#: Bytes of kept runs, and as many of kept words.
KEPT_BYTES = 8 << 20

#: Runs that normalisation leaves as they are but for case, and whose words are cut as below; no special token is spelled with them.
_PLAIN = "^[!-;=-~\u00a1\u00ab\u00bb\u00bf\u00c0-\u00ff]*$"
#: The tokenizer's word pattern over lower-case runs of such letters.
_WORD = "('s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+)"
#: What ends the last token of a word in the vocabulary (fixed value).
WORD_END = "</w>"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


class Ragged:
    """Lists of ids, one after the other: ids, and where each list begins and ends."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    def gather(self, chosen: np.ndarray, ends: np.ndarray) -> Ragged:
        """New lists made of chosen ones: list k joins chosen[ends[k]:ends[k + 1]]."""
        sizes = np.diff(self.bounds)[chosen]
        upto = np.append(0, np.cumsum(sizes))
        places = np.int32 if max(len(self.ids), upto[-1]) < 1 << 31 else np.int64
        at = np.repeat((self.bounds[:-1][chosen] - upto[:-1]).astype(places), sizes)
        at += np.arange(len(at), dtype=places)
        return Ragged(self.ids[at], upto[ends])


class Kept:
    """Ids of strings that are encoded alone; those that recur stay, in at most ``limit`` bytes of arrays.

    When these are full, the strings used in the fewest slices of late go, until half of the limit is left.
    """

    #: Bytes a string takes beside its letters and ids: where they end, its uses, and a bit that it is there.
    OVERHEAD = 17
    #: Strings of more bytes never stay.
    LONGEST = 64

    def __init__(self, encode_new: Callable[[pa.StringArray], Ragged], limit: int):
        self.encode_new, self.limit = encode_new, limit
        self.names, self.lists = pa.array([], pa.string()), Ragged(np.empty(0, "<u4"), np.zeros(1, np.int64))
        self.uses = np.empty(0, np.float32)

    def encode(self, strings: pa.StringArray) -> Ragged:
        """The ids of distinct strings, in the order given."""
        strings = strings.cast(pa.string())
        found = pc.index_in(strings, value_set=self.names)
        new = strings.filter(found.is_null())
        fresh = self.encode_new(new)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.uses[at[at >= 0]] += 1
        at[at < 0] = len(self.names) + np.arange(len(new))
        known = Ragged(np.concatenate([self.lists.ids, fresh.ids]), np.append(self.lists.bounds, self.lists.bounds[-1] + fresh.bounds[1:]))
        self._keep(pa.concat_arrays([self.names, new]), known, np.append(self.uses, np.ones(len(new), np.float32)))
        return known.gather(at, np.arange(len(at) + 1))

    def _keep(self, names: pa.StringArray, lists: Ragged, uses: np.ndarray) -> None:
        letters = pc.binary_length(names).to_numpy().astype(np.int64)
        sizes = letters + 4 * np.diff(lists.bounds) + self.OVERHEAD
        stay = np.flatnonzero(letters <= self.LONGEST)
        if sizes[stay].sum() > self.limit:
            stay = stay[np.argsort(-uses[stay], kind="stable")]
            stay = np.sort(stay[np.cumsum(sizes[stay]) <= self.limit // 2])
            uses = uses / 2
        if len(stay) < len(names):
            names, lists, uses = names.take(pa.array(stay)), lists.gather(stay, np.arange(len(stay) + 1)), uses[stay]
        self.names, self.lists, self.uses = names, lists, uses


class WordEndEncoder:
    """Whole texts to ids, for a tokenizer that drops white space, cuts words as _WORD does, and marks word ends."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        # The same model for words that are normalised and cut already.
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.chunks, self.words = Kept(self._chunks, KEPT_BYTES), Kept(self._words, KEPT_BYTES)

    def encode(self, texts: pa.StringArray) -> Ragged:
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # white space to Arrow, not to the tokenizer
            chunks = pa.array([solid_chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            chunks = pc.utf8_split_whitespace(texts)
        ends = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        return self.chunks.encode(coded.dictionary).gather(coded.indices.to_numpy(), ends - ends[0])

    def _chunks(self, chunks: pa.StringArray) -> Ragged:
        """Plain runs through their words, the others one by one; in the order given."""
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(pc.utf8_lower(chunks.filter(pa.array(plain))), _WORD, "\\1 "), " "), " ")
        words = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy().astype(np.int64)
        one = self.words.encode(words.dictionary).gather(words.indices.to_numpy(), ends - ends[0])
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(chunks.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        sizes = np.empty(len(chunks), np.int64)
        sizes[plain], sizes[~plain] = np.diff(one.bounds), [len(r) for r in rest]
        owner = np.repeat(plain, sizes)
        ids = np.empty(len(owner), "<u4")
        ids[owner] = one.ids
        ids[~owner] = np.concatenate([np.array(r, "<u4") for r in rest]) if rest else ()
        return Ragged(ids, np.append(0, np.cumsum(sizes)))

    def _words(self, strings: pa.StringArray) -> Ragged:
        """Each word ends with the first token that ends a word; the empty one has none."""
        parts = [np.empty(0, "<u4")]
        for at in range(0, len(strings), WORDS_AT_ONCE):
            words = strings.slice(at, WORDS_AT_ONCE).to_pylist()
            joined = [" ".join(words[k : k + WORDS_A_TEXT]) for k in range(0, len(words), WORDS_A_TEXT)]
            parts += [np.array(e.ids, "<u4") for e in self.of_words.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts)
        held = pc.not_equal(strings, "").to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(strings), np.int64)
        sizes[held] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return Ragged(ids, np.append(0, np.cumsum(sizes)))


@cache
def _encoder(path: str) -> WordEndEncoder:
    return WordEndEncoder(path)


def encode_pieces(docs: DataFrame, tokenizer_path: str, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its ids, then ``end_id``; only documents longer than a sequence are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in sized_slices(batches, STEP_BYTES):
            coded = encoder.encode(batch.column("text"))
            lengths = np.diff(coded.bounds) + 1
            ids = np.full(lengths.sum(), end_id, "<u4")
            last = np.zeros(len(ids), bool)
            last[np.cumsum(lengths) - 1] = True
            ids[~last] = coded.ids
            pieces = -(-lengths // sequence_tokens)
            row = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(lengths[row] - piece * sequence_tokens, sequence_tokens)
            ends = np.append(0, 4 * np.cumsum(length)).astype(np.int32)
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * sequence_tokens, pa.int64()), pa.array(length, pa.int64()), raw], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each length, in the order given (bounded-space online best-fit)."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    free_bits = n_open = n_bins = 0
    bins, offsets = [], []
    for length in lengths:
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = waiting[free].pop()
            if not waiting[free]:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            if n_open == open_bins:
                tightest = (free_bits & -free_bits).bit_length() - 1
                waiting[tightest].pop()
                if not waiting[tightest]:
                    free_bits ^= 1 << tightest
                n_open -= 1
            free, number = capacity, n_bins
            n_bins += 1
        bins.append(number)
        offsets.append(capacity - free)
        left = free - length
        if left:
            waiting[left].append(number)
            free_bits |= 1 << left
            n_open += 1
    return bins, offsets


def pack(pieces: DataFrame, n_documents: int, sequence_tokens: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces (doc_id, piece, length and any more) with sequence_id and offset.

    Lanes are hash shares of the pieces of about LANE_DOCUMENTS documents each; a lane's rows hold
    no texts unless the caller carries them. A piece longer than a sequence is an error of the caller.
    """
    lanes = max(1, -(-n_documents // LANE_DOCUMENTS))
    own = [c for c in pieces.columns if c in ("doc_id", "piece", "ids_crc32")]
    order = [(c, "ascending") for c in own]

    def run(lane: pa.Table) -> pa.Table:
        number = lane.column("_lane")[0].as_py()
        lane = lane.drop_columns(["_lane"])
        lane = lane.take(pc.sort_indices(lane, sort_keys=order))
        bins, offsets = best_fit(lane.column("length").to_pylist(), sequence_tokens, open_bins)
        return lane.append_column("sequence_id", pa.array(np.array(bins, "i8") + number * LANE_STRIDE)).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    laned = pieces.withColumn("_lane", F.pmod(F.xxhash64("length", *own), F.lit(lanes)))
    return laned.groupBy("_lane").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digest form: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = encode_pieces(docs, tokenizer_path)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), docs.count())
