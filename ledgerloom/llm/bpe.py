"""Byte-level BPE by speculation and verification.

Method: each distinct word is split greedily into longest vocabulary entries. The exact merge
process yields that split if and only if it would never merge across any boundary between two
neighbouring tokens, and whether it would depends on the two tokens alone. So all neighbouring
pairs are tested at once with arrays, and only words with a failing pair are merged exactly.

The test: while BPE builds token a, its last part x stands at a's right edge from the merge that
makes x until the merge that swallows it; likewise y at b's left edge. BPE crosses the boundary
iff some such x and y have a merge whose rank comes before both of these swallowing merges (a tie
with the swallowing of y goes to the crossing, which stands further left).

Defined results: null and empty texts have no tokens and decode to the empty text; texts of any
length, ties, repeated rows and extra columns need no special care; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import WHITE, ChunkCache, slices, texts_of

#: The byte-level word pattern (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Word boundaries never fall inside what these chunks join, so a chunk is encoded alone.
_CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_NEVER = 1 << 40
#: Stands between words where all are matched at once; no byte is written with it.
_GAP = "Ā"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ordinary = {to_bytes(s): i for s, i in vocab.items() if s not in self.special}
        size = max([*ordinary.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for b, i in ordinary.items():
            self.token_bytes[i] = b
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.names = [str(i) for i in range(size)]
        self.of_byte = [ordinary[bytes([b])] for b in range(256)]
        self.size = size
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (to_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            l, r, whole = ordinary[left], ordinary[right], ordinary[left + right]  # noqa: E741
            self.ranks[l, r] = rank
            self.made.append(whole)
            parts.setdefault(whole, (l, r, rank))
        keys = np.array([l * size + r for l, r in self.ranks], dtype=np.int64)  # noqa: E741
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*self.ranks.values()], dtype=np.int64)[order]
        self.made_ids = np.array(self.made, dtype=np.int64)
        self._edges(parts)
        # Entries that exact merging doesn't yield from their own bytes can't be proposed.
        self.automaton = ahocorasick.Automaton()
        for b, i in ordinary.items():
            if len(b) == 1 or self.merge(b) == [i]:
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.tested, self.verdicts = np.empty(0, np.int64), np.empty(0, bool)

    def _edges(self, parts: dict[int, tuple[int, int, int]]) -> None:
        """For each token, the parts at its right and left edge, and the rank of the merge that swallows each."""

        def chains(side: int) -> tuple[np.ndarray, np.ndarray]:
            lists = []
            for token in range(self.size):
                chain, swallowed = [(token, _NEVER)], token
                while swallowed in parts:
                    made = parts[swallowed]
                    swallowed = made[side]
                    chain.append((swallowed, made[2]))
                lists.append(chain)
            width = max(map(len, lists))
            tokens, ranks = np.full((self.size, width), -1, np.int64), np.zeros((self.size, width), np.int64)
            for token, chain in enumerate(lists):
                tokens[token, : len(chain)] = [t for t, _ in chain]
                ranks[token, : len(chain)] = [r for _, r in chain]
            return tokens, ranks

        self.right, self.left = chains(1), chains(0)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE never merges across the boundary between a and b, for arrays of token ids."""
        fine = np.ones(len(a), bool)
        for i in range(self.right[0].shape[1]):
            for j in range(self.left[0].shape[1]):
                x, y = self.right[0][a, i], self.left[0][b, j]
                at = np.flatnonzero(fine & (x >= 0) & (y >= 0))
                if not len(at):
                    break
                keys = x[at] * self.size + y[at]
                found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[found] == keys, self.pair_ranks[found], 2 * _NEVER)
                crosses = (rank < self.right[1][a[at], i]) & (rank <= self.left[1][b[at], j])
                fine[at[crosses]] = False
        return fine

    def _pairs_fine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, back = np.unique(a * self.size + b, return_inverse=True)
        at = np.minimum(np.searchsorted(self.tested, keys), max(len(self.tested) - 1, 0))
        seen = self.tested[at] == keys if len(self.tested) else np.zeros(len(keys), bool)
        fine = np.zeros(len(keys), bool)
        fine[seen] = self.verdicts[at[seen]] if seen.any() else False
        new = keys[~seen]
        if len(new):
            fine[~seen] = verdicts = self.compatible(new // self.size, new % self.size)
            if len(self.tested) < 4_000_000:  # what is remembered stays bounded; the rest is tested again
                put = np.searchsorted(self.tested, new)
                self.tested, self.verdicts = np.insert(self.tested, put, new), np.insert(self.verdicts, put, verdicts)
        return fine[back]

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words (as Latin-1 letters of their bytes) at once: token ids, and the word of each."""
        text = _GAP.join(words)
        hits = list(self.automaton.iter_long(text))
        tokens = np.fromiter((t for _, t in hits), np.int64, len(hits))
        ends = np.fromiter((e for e, _ in hits), np.int64, len(hits))
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 2
        return tokens, np.searchsorted(last, ends)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost among equals."""
        tokens = [self.of_byte[b] for b in word]
        if len(tokens) > 64:
            return self._merge_long(tokens)
        ranks = [self.rank_of(pair) for pair in zip(tokens, tokens[1:])]
        while ranks and (lowest := min(ranks)) < _NEVER:
            i = ranks.index(lowest)
            tokens[i : i + 2] = [self.made[lowest]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank_of((tokens[i - 1], tokens[i]))
            if i < len(ranks):
                ranks[i] = self.rank_of((tokens[i], tokens[i + 1]))
        return tokens

    def rank_of(self, pair: tuple[int, int]) -> int:
        return self.ranks.get(pair, _NEVER)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; _NEVER where there is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], _NEVER)

    def merge_many(self, words: list[str]) -> list[np.ndarray]:
        """Exact merging of many words, one merge of each word at a time."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for width, least in ((8, 0), (16, 8), (32, 16), (64, 32)):
            rows = np.flatnonzero((sizes > least) & (sizes <= width))
            if not len(rows):
                continue
            raw = np.frombuffer("".join(words[k].ljust(width) for k in rows.tolist()).encode("latin-1"), np.uint8).reshape(-1, width)
            tokens = np.where(np.arange(width) < sizes[rows, None], np.array(self.of_byte, np.int64)[raw], -1)
            ranks = np.full((len(rows), width), _NEVER, np.int64)
            ranks[:, :-1] = self.ranks_of(tokens[:, :-1], tokens[:, 1:])
            later = np.arange(width)
            while len(rows):
                i = ranks.argmin(axis=1)
                lowest = ranks[np.arange(len(rows)), i]
                if (ended := lowest >= _NEVER).any():
                    for k, row in zip(rows[ended].tolist(), tokens[ended]):
                        out[k] = row[row >= 0]
                    rows, tokens, ranks, i, lowest = rows[~ended], tokens[~ended], ranks[~ended], i[~ended], lowest[~ended]
                    if not len(rows):
                        break
                here = np.arange(len(rows))
                tokens[here, i] = self.made_ids[lowest]
                gone = later > i[:, None]
                tokens[:, :-1] = np.where(gone[:, :-1], tokens[:, 1:], tokens[:, :-1])
                ranks[:, :-1] = np.where(gone[:, :-1], ranks[:, 1:], ranks[:, :-1])
                tokens[:, -1], ranks[:, -1] = -1, _NEVER
                ranks[here, i] = self.ranks_of(tokens[here, i], tokens[here, np.minimum(i + 1, width - 1)])
                inner = np.flatnonzero(i)
                ranks[inner, i[inner] - 1] = self.ranks_of(tokens[inner, i[inner] - 1], tokens[inner, i[inner]])
        for k in np.flatnonzero(sizes > 64).tolist():
            out[k] = np.array(self._merge_long([self.of_byte[b] for b in words[k].encode("latin-1")]), np.int64)
        return out

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        n, ranks = len(tokens), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(tokens, tokens[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != left or j >= n or tokens[j] != right:
                continue
            tokens[i], tokens[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := (tokens[i], tokens[k])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            if (h := before[i]) >= 0 and (pair := (tokens[h], tokens[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], h, *pair))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and how many each has. Words are Latin-1 letters of bytes."""
        tokens, owner = self.propose(words)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        counts = np.bincount(owner, minlength=len(words))
        failing = inner[~self._pairs_fine(tokens[inner], tokens[inner + 1])] if len(inner) else inner
        if len(failing):
            wrong = np.unique(owner[failing])
            exact = self.merge_many([words[k] for k in wrong.tolist()])
            sizes = np.fromiter(map(len, exact), np.int64, len(exact))
            keep = np.ones(len(words), bool)
            keep[wrong] = False
            held = keep[owner]
            counts[wrong] = sizes
            everything = np.concatenate([tokens[held], *exact])
            owners = np.concatenate([owner[held], np.repeat(wrong, sizes)])
            tokens = everything[np.argsort(owners, kind="stable")]
        return tokens, counts

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        words, ends = [], []
        for chunk in chunks:
            bare = chunk[1:] if chunk[0] == " " else chunk
            if not bare.isascii():
                words.extend(w.encode().decode("latin-1") for w in WORDS.findall(chunk))
            elif bare.isalpha():
                words.append(chunk)
            else:
                words.extend(WORDS.findall(chunk))
            ends.append(len(words))
        if not words:
            return []
        tokens, counts = self.encode_words(words)
        raw, upto = tokens.astype("<u4").tobytes(), (4 * np.cumsum(counts)[np.array(ends) - 1]).tolist()
        return [raw[a:b] for a, b in zip([0, *upto], upto)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class TextEncoder:
    """Whole texts to ids, over a bounded cache of chunks."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.cache = ChunkCache(self.bpe.encode_chunks)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")") if self.bpe.special else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts: list[list[str]] = []
        for text in texts:
            parts.append(self.special.split(text) if self.special and any(s in text for s in self.bpe.special) else [text])
        coded = iter(self.cache.encode([_CHUNKS.findall(p) if k % 2 == 0 else [] for own in parts for k, p in enumerate(own)]))
        out = []
        for own in parts:
            ids: list[int] = []
            for k, part in enumerate(own):
                raw = next(coded)
                ids += [self.bpe.special[part]] if k % 2 else np.frombuffer(raw, "<u4").tolist()
            out.append(ids)
        return out


@cache
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the real outputs, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        for batch in slices(batches):
            ids = encoder.encode(texts_of(batch))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.bpe.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_documents returns, made in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        name, sha = encoder.bpe.names.__getitem__, hashlib.sha256
        for batch in slices(batches):
            ids = encoder.encode(texts_of(batch))
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([sha(",".join(map(name, i)).encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([sha(encoder.bpe.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
