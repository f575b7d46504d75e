"""Encoding of texts with a byte-level BPE vocabulary, in two tiers.

Texts are cut into pre-tokens. Tier one resolves whole pre-tokens that are in
the vocabulary through a minimal perfect hash, for all distinct pre-tokens of
a batch at once. Tier two merges the bytes of the misses over a linked list,
the next merge coming from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files are; a parameter of every function that needs them.
FOLDER = "/opt/tokenizers"

#: Fixed value: the pre-token pattern published with the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file with a base64 token and its id on each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class PerfectHash:
    """A minimal perfect hash of n byte strings onto 0 .. n - 1.

    Hash, displace and compress: keys fall into n / 4 bins; from the fullest
    bin on, each gets the first displacement that sends its keys to free slots.
    Bins of one key, which come last, point to a free slot directly. A lookup
    takes two array reads; the stored key tells members from strangers.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = n = len(keys)
        self.bins = max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys have one hash")
        self.shift = np.zeros(self.bins, dtype=np.int64)
        self.hash = np.zeros(n, dtype=np.uint64)
        self.value = np.zeros(n, dtype=np.int64)
        self.key: list[bytes] = [b""] * n
        numbers = np.array(values, dtype=np.int64)
        of_bin = (hashes % np.uint64(self.bins)).astype(np.int64)
        order = np.argsort(of_bin, kind="stable")
        cuts = np.searchsorted(of_bin[order], np.arange(self.bins + 1))
        groups = sorted((order[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a), key=len, reverse=True)
        taken = np.zeros(n, dtype=bool)
        free = None
        for group in groups:
            if len(group) == 1:
                free = iter(np.flatnonzero(~taken)) if free is None else free
                slots = np.array([next(free)])
                self.shift[of_bin[group[0]]] = -1 - slots[0]
            else:
                d, slots = self._free(hashes[group], taken)
                self.shift[of_bin[group[0]]] = d
            taken[slots] = True
            self.hash[slots], self.value[slots] = hashes[group], numbers[group]
            for i, s in zip(group, slots, strict=True):
                self.key[s] = keys[i]

    def _free(self, hashes: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that sends the keys to different free slots; a block of them is tried at once."""
        first, block = 0, 16
        while True:
            tried = np.arange(first, first + block, dtype=np.uint64)
            slots = self._slots(hashes[None, :], tried[:, None])
            placed = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (placed[:, 1:] != placed[:, :-1]).all(axis=1)
            if good.any():
                at = int(good.argmax())
                return first + at, slots[at]
            first, block = first + block, min(4096, block * 4)

    def _slots(self, hashes: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hashes ^ (np.uint64(0x9E3779B97F4A7C15) * (d + np.uint64(1)))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 for strangers."""
        if not keys or not self.n:
            return np.full(len(keys), -1)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        shift = self.shift[(hashes % np.uint64(self.bins)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0).astype(np.uint64)))
        same = self.hash[slots] == hashes
        out = np.where(same, self.value[slots], -1)
        for i in np.flatnonzero(same):  # the key itself decides, not its hash
            if self.key[slots[i]] != keys[i]:
                out[i] = -1
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the lowest-ranked adjacent pair is merged until none is left."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]; a part that was merged away has end 0
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Both tiers, with a bounded memory of merged misses."""

    def __init__(self, table: PerfectHash, most: int = 100_000):
        self.table, self.most = table, most
        self.ranks = dict(zip(table.key, table.value.tolist(), strict=True))
        self.cut = regex.compile(PATTERN)
        self.merged: dict[bytes, list[int]] = {}

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.cut.findall(t) if t else [] for t in texts]
        place: dict[str, int] = {}
        for found in pieces:
            for p in found:
                place.setdefault(p, len(place))
        keys = [p.encode("utf-8", "replace") for p in place]
        ids: list = [[v] if v >= 0 else None for v in self.table.lookup(keys).tolist()]
        for i, got in enumerate(ids):
            if got is None:
                ids[i] = self._miss(keys[i])
        known = dict(zip(place, ids, strict=True))
        return [[i for p in found for i in known[p]] for found in pieces]

    def _miss(self, piece: bytes) -> list[int]:
        got = self.merged.get(piece)
        if got is None:
            if len(self.merged) >= self.most:
                self.merged.clear()
            got = merge(piece, self.ranks)
            if len(piece) <= 64:
                self.merged[piece] = got
        return got


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, rows: int = 500) -> DataFrame:
    """(key, ids) of every row: the token ids of its whole text, without special tokens.

    The list is empty for null and for empty texts, and only for these. Strings
    of special tokens are ordinary text. Keys may be null or repeat; each row
    gives a row. Other columns are left out, whatever their names. The
    vocabulary is read on the driver and broadcast; its size is fixed.
    """
    spark = df.sparkSession
    ranks = read_ranks(f"{folder}/{vocabulary}.tiktoken")
    table = spark.sparkContext.broadcast(PerfectHash(list(ranks), list(ranks.values())))
    schema = df.select(F.col(key), F.array().cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = encoder.batch(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], [key, "ids"])

    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, schema)
