"""Words of records: what two records have in common is counted over these.

A word is a run of letters or digits, in lower case. A record's words are
those of all its string values at any depth, keys and numbers left out, each
as often as it occurs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Records of fewer words aren't compared.
FEWEST_WORDS = 25
#: Two records repeat each other from this share of words in common on.
SIMILAR = 0.7

_GOLDEN = 0x9E3779B97F4A7C15
_RECORD, _PARAGRAPH = "\x01", "\x00"
_INVERSE = pow(_GOLDEN, -1, 1 << 64)


def parse(text: str | None):
    """The record, or None if the text isn't a JSON object. Of a repeated key the last value holds."""
    try:
        record = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def chunks(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, list]]:
    """(first place, parsed records) of texts that are read in one run: about ``most`` characters, or one long text, and 4,096 records at most."""
    at, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(parse(text))
        size += len(text or "")
        if size >= most or len(held) == 4_096:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


def strings(value) -> Iterator[str]:
    """All string values at any depth, in order."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            stack.extend(reversed(x.values()))
        elif isinstance(x, list):
            stack.extend(reversed(x))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _GOLDEN, np.uint64)), np.cumprod(np.full(n, _INVERSE, np.uint64))


def hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first place, code points) of a text in lower case, from one pass of prefix sums."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[np.minimum(points, 0x10FFFF)]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    first, stop = edges[::2], edges[1::2]
    n = 1 << max(20, (len(points) - 1).bit_length())
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power[: len(points)])])
        h = (sums[stop] - sums[first]) * inverse[first]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h, first, points


@dataclass
class Bags:
    """The words of some records, one record after another.

    ``rows`` are the places of the records with words enough; ``tokens`` hold a
    hash for each occurrence of a word, the n-th of a word having its own, so
    sets of tokens compare as bags; ``starts`` and ``sizes`` say which are
    whose. ``paragraphs`` is, where asked for, (hashes, words in each, starts)
    of the distinct paragraphs.
    """

    rows: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    contents: np.ndarray
    paragraphs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def bags(records: list, paragraphs: bool = False) -> Bags | None:
    """The words of those records that have enough of them, None if none has. A record may be None.

    All records are read in one run, so numpy sees long arrays whatever the
    size of a record.
    """
    held = [i for i, r in enumerate(records) if r is not None]
    if not held:
        return None
    h, first, points = hashes(_RECORD.join(_PARAGRAPH.join(strings(records[i])).replace(_RECORD, " ") for i in held).lower())
    owner = np.cumsum(points == 1)[first]
    counts = np.bincount(owner, minlength=len(held))
    enough = counts >= FEWEST_WORDS
    if not enough.any():
        return None
    keep = enough[owner]
    w, owner = h[keep], owner[keep]
    pieces = None
    if paragraphs:  # they end with a string value, a record, a line, or a sentence with a space behind it
        stop = np.isin(points, (ord("."), ord("!"), ord("?"), ord(";")))
        stop[:-1] &= np.isin(points[1:], (ord(" "), ord("\t"), 0xA0))
        pieces = np.cumsum(stop | (points <= 1) | (points == ord("\n")))[first[keep]]
    sizes = counts[enough]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # sorted by record and then by word, in one array: the record's place in the top bits, 52 bits of the word's hash below
    tokens = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (w >> np.uint64(12)))
    again = np.concatenate([[False], tokens[1:] == tokens[:-1]])
    with np.errstate(over="ignore"):
        tokens = (tokens << np.uint64(12)) * np.uint64(_GOLDEN)
        tokens ^= tokens >> np.uint64(29)
        if again.any():
            place = np.arange(len(tokens))
            nth = (place - np.maximum.accumulate(np.where(again, 0, place)))[again].astype(np.uint64)
            tokens[again] = (tokens[again] ^ (nth * np.uint64(_GOLDEN))) * np.uint64(0xD6E8FEB86659FD93)
        x = tokens * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        contents = np.add.reduceat(x, starts) ^ (sizes.astype(np.uint64) * np.uint64(_GOLDEN))
        parts = _paragraphs(w, owner, pieces, np.flatnonzero(enough)) if paragraphs else None
    return Bags(np.array(held)[enough], tokens, starts, sizes, contents.view(np.int64), parts)


def _paragraphs(w: np.ndarray, owner: np.ndarray, pieces: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, words, starts by owner) of the distinct paragraphs; one that stands twice counts with all its words."""
    first = np.flatnonzero(np.concatenate([[True], pieces[1:] != pieces[:-1]]))
    long = np.diff(np.append(first, len(w)))
    nth = (np.arange(len(w)) - np.repeat(first, long)).astype(np.uint64)
    x = (w + nth * np.uint64(_GOLDEN)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    h = np.add.reduceat(x, first) ^ (long.astype(np.uint64) << np.uint64(40))
    whose = owner[first]
    order = np.lexsort((h, whose))
    h, whose, long = h[order], whose[order], long[order]
    one = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])]))
    total = np.add.reduceat(long, one)
    return h[one].view(np.int64), total.astype(np.int32), np.searchsorted(whose[one], owners)
