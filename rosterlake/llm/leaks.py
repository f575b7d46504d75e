"""Evaluation texts that leaked into a corpus.

A document holds a passage of a test item if at least ``SHORTEST`` words running
of the item stand in it with at most one word in eight changed, dropped or
added. Pigeonhole: a window of L words with at most k = L // 8 errors, cut into
k + 1 pieces, has a piece without error, and every such piece is at least
``PIECE`` words long. So all runs of ``PIECE`` words of the items are looked up
in the documents; round each hit the windows that can hold are verified with
Myers' bit-parallel edit distance over words.

Both sides stay distributed. The items' pieces are a table; a Bloom filter of
them, of a size that follows from their number up to a fixed most, sifts the
runs of the corpus in one pass over it. What passes is joined with the pieces,
and only documents that share ``HITS`` pieces with an item meet its words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rosterlake.llm import words
from rosterlake.session import materialise

SHORTEST, PIECE, LONGEST = 15, 5, 32
#: Pieces in common that a window that holds has at least: of L words and k = L // 8 errors, L - PIECE + 1 - k * PIECE, least at 16 words.
HITS = 2
#: Bits of the filter for each piece, and the most bits it has (32 MB), as a power of two; beyond it sifts less and nothing is lost.
BITS_EACH, MOST_BITS = 16, 28
#: Most rows of a table that is broadcast; its size is counted first.
BROADCAST_ROWS = 200_000

_INLINE = re.compile(r"</?(?:b|i|em|strong|a|span|u|code|font|mark|small|sub|sup)(?:\s[^<>]{0,300})?>", re.I)
_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,300}>|<!--.*?-->", re.S)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
#: A line by itself that only says that the page ends or the text goes on.
_BREAK = re.compile(r"^[^\w\n]*(?:\[[^\[\]\n]{1,40}\]|(?:[-*=_~#]{2,})\s*[^\n]{0,40}?\s*(?:[-*=_~#]{2,})|(?:page|seite|página|pagina|страница|p\.|s\.)\s*\d+(?:\s*(?:of|/|von|de|van|sur|из)\s*\d+)?)[^\w\n]*$", re.M | re.I)


def plain(text: str) -> str:
    """A text in folded case without markup, hidden characters and page or break lines."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    text = _BREAK.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold()


def read(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, word hashes, start of each text's words with the end behind, hash of the run of words from each place) of texts read in one run.

    Runs that reach over the end of a text, or past the last word, are 0.
    """
    at, size, held = 0, 0, []

    def together() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        h, first, points = words.hashes("\x01".join(held))
        owner = np.cumsum(points == 1)[first]
        starts = np.searchsorted(owner, np.arange(len(held) + 1))
        found = np.zeros(len(h), np.uint64)
        got = runs(h)
        whole = owner[PIECE - 1 :] == owner[: len(got)]
        found[: len(got)][whole] = got[whole] | np.uint64(1)
        return at, h, starts, found

    for i, text in enumerate(texts):
        held.append(plain(text).replace("\x01", " ") if text else "")
        size += len(held[-1])
        if size >= most:
            yield together()
            at, size, held = i + 1, 0, []
    if held:
        yield together()


def anchored_distance(pattern: list[int], text: list[int], most: int) -> bool:
    """Whether the pattern is within ``most`` edits of a beginning of the text that ends with the pattern's last word.

    Myers' bit vectors, in the form for distances from the text's beginning:
    bit i of ``up`` and ``down`` says that the cell i + 1 of the column is one
    more, or less, than the cell above it.
    """
    m = len(pattern)
    mask = (1 << m) - 1
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score, top = mask, 0, m, 1 << (m - 1)
    last = pattern[-1]
    for w in text[: m + most]:
        eq = where.get(w, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & mask
        hp = down | (~(d0 | up) & mask)
        hm = d0 & up
        score += bool(hp & top) - bool(hm & top)
        hp = (hp << 1 | 1) & mask
        hm = (hm << 1) & mask
        up = hm | (~(d0 | hp) & mask)
        down = hp & d0
        if w == last and score <= most:
            return True
    return False


def holds(words: list[int], item: list[int], hits: list[tuple[int, int]]) -> bool:
    """Whether words hold a passage of the item; hits are the (place, place in the item) of their common pieces, in order."""
    run: dict[int, list[int]] = {}
    for p, q in hits:  # runs without any error need no distance
        seen = run.get(p - q)
        run[p - q] = [seen[0], q] if seen and seen[1] == q - 1 else [q, q]
        if q - run[p - q][0] + PIECE >= SHORTEST:
            return True
    done: set[tuple] = set()
    return any(_round(words, item, p, q, done) for p, q in hits)


def _round(words: list[int], item: list[int], p: int, q: int, done: set[tuple]) -> bool:
    low, high = max(0, q + PIECE - LONGEST), min(len(item), q + LONGEST)
    there = set(words[max(0, p - LONGEST - 4) : p + LONGEST + 4])
    sums = [0]
    for w in item[low:high]:
        sums.append(sums[-1] + (w in there))
    for size in range(SHORTEST, LONGEST + 1):
        errors = size // 8
        for s in range(max(low, q + PIECE - size), min(q, high - size) + 1):
            if sums[s + size - low] - sums[s - low] < size - errors or item[s] not in there or item[s + size - 1] not in there:
                continue
            for start in range(max(0, p - (q - s) - errors), p - (q - s) + errors + 1):
                if start < len(words) and words[start] == item[s] and (start, s, size) not in done:
                    done.add((start, s, size))
                    if anchored_distance(item[s : s + size], words[start : start + size + errors], errors):
                        return True
    return False


def runs(hashed: np.ndarray) -> np.ndarray:
    """A hash of every ``PIECE`` words running."""
    n = len(hashed) - PIECE + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PIECE if n > 0 else 0):
            out = (out ^ hashed[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


_ITEM = "item_id bigint, item array<bigint>, hash array<bigint>"


def pieces(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, words, hashes) of the items with words enough: a hash of every word and of every run of ``PIECE`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, h, starts, found in read(batch.column(1).to_pylist()):
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    if b - a >= SHORTEST:
                        own = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (h[a:b], found[a : b - PIECE + 1])]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at + i, 1), *own], ["item_id", "item", "hash"])

    rows = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return rows.filter(F.col("t").isNotNull() & F.col("k").isNotNull()).mapInArrow(run, _ITEM)


def _filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of (hash) rows, filled where they are; two places for each hash."""
    n = max(1, hashes.count())
    bits = min(MOST_BITS, max(12, (BITS_EACH * n - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            cells, at = np.unique(both >> np.uint64(6), return_inverse=True)
            words = np.zeros(len(cells), np.uint64)
            np.bitwise_or.at(words, at, np.uint64(1) << (both & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(words.view(np.int64))], ["cell", "bits"])

    got = hashes.mapInArrow(fill, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        return h >> top, (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> top


def _passes(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = (len(table) * 64).bit_length() - 1
    ok = h != 0
    for place in _places(h, bits):
        ok &= (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): the document holds a passage of the item.

    Texts that are null or too short hold nothing, items under 15 words leak
    nowhere. Repeated rows give one row. Null keys of documents stay null.
    Whole texts are searched. Other columns don't matter, whatever their names.
    """
    of_key = documents.schema[key].dataType
    held = materialise(pieces(items, item_key, item_text), "items").withColumn("text", F.xxhash64("item"))
    every = held.select("item_id", "text", F.posexplode("hash").alias("q", "hash"))
    table = documents.sparkSession.sparkContext.broadcast(_filter(every.select("hash")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, h, starts, found in read(batch.column(1).to_pylist()):
                place = np.flatnonzero(_passes(found, table.value))
                whose = np.searchsorted(starts, place, side="right") - 1
                docs, first, n = np.unique(whose, return_index=True, return_counts=True)
                enough = n >= HITS
                docs, first, n = docs[enough], first[enough], n[enough]
                if not len(docs):
                    continue
                bodies = pa.array([h[starts[d] : starts[d + 1]].view(np.int64) for d in docs], pa.list_(pa.int64()))
                spots = pa.array([(place[f : f + k] - starts[d]).astype(np.int32) for d, f, k in zip(docs, first, n, strict=True)], pa.list_(pa.int32()))
                hits = pa.array([found[place[f : f + k]].view(np.int64) for f, k in zip(first, n, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs + at)), bodies, spots, hits], [key, "body", "p", "hash"])

    schema = StructType([StructField(key, of_key), *StructType.fromDDL("body array<bigint>, p array<int>, hash array<bigint>").fields])
    near = documents.select(F.col(key), F.col(text).alias("__text")).mapInArrow(sift, schema)
    near = materialise(near.withColumn("row", F.monotonically_increasing_id()), "near")
    hits = near.select("row", F.explode(F.arrays_zip("p", "hash")).alias("h")).select("row", "h.p", "h.hash")
    few = every.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = hits.join(F.broadcast(every) if few else every, "hash").groupBy("row", "item_id", "text").agg(F.collect_set(F.struct("p", "q")).alias("hits"))
    met = met.filter(F.size("hits") >= HITS)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            good = [i for i, (body, item, found) in enumerate(rows) if holds(body, item, sorted((x["p"], x["q"]) for x in found))]
            at = pa.array(good, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], [key, "item_id"])

    pairs = near.select("row", key, "body").join(met, "row").join(held.select("item_id", "text", "item").dropDuplicates(["item_id", "text"]), ["item_id", "text"])
    out = StructType([StructField(key, of_key), *StructType.fromDDL("item_id bigint").fields])
    return pairs.select(key, "item_id", "body", "item", "hits").mapInArrow(verify, out).distinct()
