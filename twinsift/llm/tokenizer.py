"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Two tiers. A pre-token that is itself an entry of the vocabulary is resolved by a minimal perfect hash over all
entries. Any other pre-token is merged by rank with a heap over doubly linked bytes, O(n log n) also for a pre-token
of a million characters. The operator is a single pass without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pre-token pattern that belongs to the byte_bpe_50k vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers before it starts afresh; a cache only, results do not depend on it.
CACHE = 200_000
#: Characters of text that are split at once.
SLAB = 2_000_000


def _spread(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser, seeded by the level."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash by cascaded bit arrays: a key's slot is the rank of the first bit that it has alone."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.5):
        self.size = len(keys)
        if len(np.unique(keys)) != self.size:
            raise ValueError("keys must be distinct")
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        before, left = 0, keys
        while len(left):
            width = max(64, int(gamma * len(left)))
            at = (_spread(left, len(self.levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            rank = np.cumsum(alone) - 1 + before
            self.levels.append((alone, rank, width))
            before += int(alone.sum())
            left = left[~alone[at]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots 0..size-1; a key outside the set gets some slot or -1, so the caller compares the key itself."""
        slots = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (alone, rank, width) in enumerate(self.levels):
            if not len(open_):
                break
            at = (_spread(keys[open_], level) % np.uint64(width)).astype(np.int64)
            hit = alone[at]
            slots[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return slots


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        entries = list(ranks)
        hashes = np.array([xxhash.xxh3_64_intdigest(e) for e in entries], np.uint64)
        self.find = PerfectHash(hashes)
        slots = self.find(hashes)
        self.entry: list[bytes] = [b""] * len(entries)
        self.id_at = np.zeros(len(entries), np.int32)
        for k, s in enumerate(slots.tolist()):
            self.entry[s] = entries[k]
            self.id_at[s] = ranks[entries[k]]
        self.split = regex.compile(PRE_TOKEN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge by rank: the lowest-ranked pair first, the leftmost of equal ones, until no pair is an entry."""
        ranks, n = self.ranks, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            left = part[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(part[j]) != length:
                continue  # one of its sides has been merged since
            joined = left + part[j]
            part[i], part[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if (r := ranks.get(joined + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(joined) + len(part[k])))
            if (p := prior[i]) >= 0 and (r := ranks.get(part[p] + joined)) is not None:
                heapq.heappush(heap, (r, p, len(part[p]) + len(joined)))
        return tuple(ranks[x] for x in part if x is not None)

    def learn(self, fresh: list[str]) -> None:
        """Resolve pre-tokens that are not yet known: whole entries first, the rest by merging."""
        raw = [x.encode("utf-8", "replace") for x in fresh]
        slots = self.find(np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64)).tolist()
        for word, piece, s in zip(fresh, raw, slots):
            self.known[word] = (int(self.id_at[s]),) if s >= 0 and self.entry[s] == piece else self.merge(piece)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            if len(known) + len(fresh) > CACHE and known:
                known.clear()
                fresh = list(dict.fromkeys(words))
            self.learn(fresh)
        return [i for w in words for i in known[w]]


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> BytePairEncoder:
    ranks = {}
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return BytePairEncoder(ranks)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, ids)``: the token ids of every text, without special tokens.

    Defined cases: an empty or null text has an empty list; a special token's string is ordinary text; a row comes out
    for every row that went in (a null key stays null); whole texts are encoded, however long; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(name, folder)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at, size = 0, 0
            flat: list[int] = []
            ends = [0]
            for i in range(len(texts)):
                value = texts[i].as_py()
                if value:
                    flat += bpe.encode(value)
                    size += len(value)
                ends.append(len(flat))
                if size >= SLAB or i == len(texts) - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at), lists], names=[key, "ids"])
                    at, size, flat, ends = i + 1, 0, [], [0]

    kind = documents.schema[key].dataType.simpleString()
    chosen = documents.select(F.col(key), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
