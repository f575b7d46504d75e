"""Near-duplicate records with small edits, by sketches of two bits a hash.

Each record's bag of words gets a sketch of two bits for each of ``SLICES``
min-wise hashes; at similarity s two sketches differ in a share (1 - s) / 2 of
the first bits, and in a share 3 (1 - s) / 4 of the hashes in one bit or the
other. Records with one content form a class and only its representative is
compared. Representatives that agree in all rows of a band of min-wise values
meet in a block. There the first bits of all pairs are compared with whole
words, 64 hashes at a time and a square of pairs at once, and the second bits
of those pairs that are left; so the pairs that merely use the same words, whose
number grows with the square of the data, cost a few nanoseconds each and
never leave their task. The pairs left are checked exactly.

With 30 bands of 5 rows a pair of similarity 0.7 meets with probability 0.996,
of 0.75 with 0.9997, of 0.8 with 0.99999; the radii of 36 of 128 first bits and
46 of 128 hashes keep 0.9998 of pairs at similarity 0.7 together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import words
from rosterlake.llm.graph import components, pairs_within
from rosterlake.session import materialise

BANDS, ROWS = 30, 5
HASHES, SLICES = BANDS * ROWS, 128
#: Most first bits, and most hashes by both bits, in which two sketches may differ.
RADIUS, RADIUS_BOTH = 36, 46
#: Blocks of more rows than this are compared in squares of about so many pairs.
SMALL, SQUARE = 64, 1 << 16
#: A block of more lanes than this is cut up and compared piece by piece, in tasks of their own.
BLOCK = 16_384
#: Most rows of a table that is broadcast; its size is counted first.
BROADCAST_ROWS = 200_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)

_SKETCH = "id string, content bigint, n_words int, low bigint, high bigint, low2 bigint, high2 bigint, bands array<bigint>"


def minima(tokens: np.ndarray, starts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Min-wise values, one row per record: tokens of all records in a row, each record from its start."""
    folded = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
    out = np.empty((hashes, len(starts)), dtype=np.uint32)
    h = np.empty_like(folded)
    for j in range(hashes):  # tokens are hashes already, so a linear map permutes them well enough
        np.multiply(folded, _MULTIPLY[j], out=h)
        np.add(h, _ADD[j], out=h)
        out[j] = np.minimum.reduceat(h, starts)
    return np.ascontiguousarray(out.T)


def _bits(least: np.ndarray, multiply: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit of each of the first ``SLICES`` hashes: (low half, high half)."""
    bits = ((least[:, :SLICES] * np.uint32(multiply)) >> np.uint32(31)).astype(np.uint64)
    weights = np.uint64(1) << np.arange(SLICES // 2, dtype=np.uint64)
    return (bits[:, : SLICES // 2] * weights).sum(axis=1, dtype=np.uint64).view(np.int64), (bits[:, SLICES // 2 :] * weights).sum(axis=1, dtype=np.uint64).view(np.int64)


def second_bits(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low half, high half) of the second bits of each record."""
    return _bits(least, 0x85EBCA6B)


def sketch_of(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low half of the first bits, high half, band keys) of each record."""
    low, high = _bits(least, 0x9E3779B1)
    with np.errstate(over="ignore"):
        shaped = least[:, : bands * rows].astype(np.uint64).reshape(len(least), bands, rows)
        keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys = np.broadcast_to(keys, (len(least), bands)).copy()
        for r in range(rows):
            keys ^= (shaped[:, :, r] + np.uint64(r + 1)) * _MIX[r]
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return low, high, keys.view(np.int64)


def sketches(df: DataFrame, key: str, source: str) -> DataFrame:
    """(id, content, n_words, low, high, low2, high2, bands) of each record that has words enough.

    Sources that are null, aren't JSON objects or hold under 25 words give no
    row. ``content`` is a hash of the bag of words, equal for full copies.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, records in words.chunks(batch.column(1).to_pylist()):
                got = words.bags(records)
                if got is None:
                    continue
                least = minima(got.tokens, got.starts)
                (low, high, keys), (low2, high2) = sketch_of(least), second_bits(least)
                offsets = pa.array(np.arange(0, len(got.rows) * BANDS + 1, BANDS), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(got.rows + at)), pa.array(got.contents), pa.array(got.sizes.astype(np.int32)),
                        pa.array(low), pa.array(high), pa.array(low2), pa.array(high2), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
                    ],
                    ["id", "content", "n_words", "low", "high", "low2", "high2", "bands"],
                )

    held = df.filter(F.col(key).isNotNull())
    return held.select(F.col(key).cast("string").alias("id"), F.col(source).alias("s")).mapInArrow(sketch, _SKETCH)


def _near(keys: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows with one key within the radius, some at a time. ``keys`` must be sorted."""
    low, high = low.view(np.uint64), high.view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], int)
    size = np.diff(np.append(first, len(keys)))
    # small blocks all together: row i with row i + d for d = 1, 2, ... until no block reaches so far
    stop = np.repeat(first + size, size)
    live = np.flatnonzero(np.repeat(size <= SMALL, size))
    d = 1
    while len(live := live[live + d < stop[live]]):
        distance = np.bitwise_count(low[live] ^ low[live + d])
        distance += np.bitwise_count(high[live] ^ high[live + d])
        hit = live[distance <= radius]
        yield hit, hit + d
        d += 1
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        stop_at = at + n
        while at < stop_at:
            end = min(stop_at, at + max(1, SQUARE // (stop_at - at)))
            distance = np.bitwise_count(low[at:end, None] ^ low[None, at:stop_at])
            distance += np.bitwise_count(high[at:end, None] ^ high[None, at:stop_at])
            i, j = np.nonzero(distance <= radius)
            later = i < j
            yield i[later] + at, j[later] + at
            at = end


def block_pairs(keys: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows with one key whose first bits are within the radius. ``keys`` must be sorted."""
    found = [(np.array([], int), np.array([], int)), *_near(keys, low, high, radius)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, (key, rid, cross, low, high) and low2, high2 if there; near pairs of rids out.

    Whole keys are compared, a bounded buffer at a time.
    """
    kept: list[pa.RecordBatch] = []
    rows = 0

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, rid, cross, low, high, *more = (table.column(i).to_numpy() for i in range(table.num_columns))
        low2, high2 = (x.view(np.uint64) for x in more) if more else (None, None)
        first, second = low.view(np.uint64), high.view(np.uint64)
        held, n = [], 0
        for i, j in _near(key, low, high, RADIUS):
            if more and len(i):
                distance = np.bitwise_count((first[i] ^ first[j]) | (low2[i] ^ low2[j]))
                distance += np.bitwise_count((second[i] ^ second[j]) | (high2[i] ^ high2[j]))
                i, j = i[distance <= RADIUS_BOTH], j[distance <= RADIUS_BOTH]
            if not len(i):
                continue
            right = (rid[i] != rid[j]) & ((cross[i] == 0) | (cross[i] != cross[j]))
            a, b = rid[i][right], rid[j][right]
            held.append((np.minimum(a, b), np.maximum(a, b)))
            n += len(a)
            if n >= 1 << 16:
                yield batch_of(held)
                held, n = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in held])) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= 12 * BLOCK:
            table = pa.Table.from_batches(kept).combine_chunks()
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from run(table.slice(0, cut))
            kept = table.slice(cut).combine_chunks().to_batches()
            rows = len(key) - cut
    if rows:
        yield from run(pa.Table.from_batches(kept).combine_chunks())


def _large_blocks(keys: DataFrame) -> DataFrame:
    """(key, parts) of the keys with more than ``BLOCK`` rows.

    Keys are first counted in 65,536 bins, which partial sums make cheap. A bin
    with such a key stands out against the median bin by nearly ``BLOCK``; only
    the keys of bins that do are counted one by one.
    """
    bins = 1 << 16
    of_bin = F.pmod("key", F.lit(bins)).alias("bin")
    counts = materialise(keys.groupBy(of_bin).agg(F.count("*").alias("n")), "bins")
    usual = counts.agg(F.percentile_approx("n", 0.5, 1000)).first()[0] or 0
    full = counts.filter(F.col("n") > usual - 6 * usual**0.5 + BLOCK).select("bin")
    inside = keys.withColumn("bin", of_bin).join(F.broadcast(full), "bin", "left_semi")
    return inside.groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("parts"))


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """(a, b) of near sketches, from (rid, low, high, bands); with columns low2 and high2 the second bits count too.

    A key's rows go to one task while there are at most ``BLOCK`` of them.
    Larger blocks are cut by hash into parts, and every two parts are compared
    in a task of their own: nothing is left out and no task gets them all.
    """
    sketch = [c for c in ("low", "high", "low2", "high2") if c in reps.columns]
    banded = reps.select("rid", *sketch, F.explode("bands").alias("key"))
    large = materialise(_large_blocks(reps.select(F.explode("bands").alias("key"))), "blocks")
    if large.isEmpty():
        plain = banded
        rows = plain.select("key", "rid", F.lit(0).alias("cross"), *sketch)
    else:
        few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        joined = banded.join(F.broadcast(large) if few else large, "key", "left")
        plain = joined.filter("parts is null").select("key", "rid", F.lit(0).alias("cross"), *sketch)
        part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
        cut = joined.filter("parts is not null").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        meet = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
        # within a part every two rows are compared (0); across two parts only rows of different parts (1 and 2)
        cross = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
        rows = plain.unionByName(cut.select(meet.alias("key"), "rid", cross.alias("cross"), *sketch))
    placed = rows.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(_compare, "a bigint, b bigint").distinct()


def share_in_common(a: Column, b: Column) -> Column:
    """Words in common over words in either, of two arrays of distinct tokens."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def token_table(df: DataFrame, key: str, source: str) -> DataFrame:
    """(id, content, tokens) of each record with words enough."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, records in words.chunks(batch.column(1).to_pylist()):
                got = words.bags(records)
                if got is not None:
                    offsets = pa.array(np.append(got.starts, len(got.tokens)), pa.int32())
                    bags = pa.ListArray.from_arrays(offsets, pa.array(got.tokens.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got.rows + at)), pa.array(got.contents), bags], ["id", "content", "tokens"])

    return df.select(F.col(key).cast("string").alias("id"), F.col(source).alias("s")).mapInArrow(tokens, "id string, content bigint, tokens array<bigint>")


def similar_classes(df: DataFrame, key: str, source: str, least: float = words.SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(members, links): the classes of full copies and the near pairs between them.

    members is (content, id), one row per class and id; links is (content_a,
    content_b, similarity) with content_a < content_b and similarity at least
    ``least``, exact over the bags of words.
    """
    sketched = materialise(sketches(df, key, source), "sketches")
    members = sketched.select("content", "id").distinct()
    reps = sketched.groupBy(F.col("content").alias("rid")).agg(F.min(F.struct("id", "low", "high", "low2", "high2", "bands")).alias("r"))
    reps = materialise(reps.select("rid", "r.low", "r.high", "r.low2", "r.high2", "r.bands", "r.id"), "reps")
    near = materialise(candidate_pairs(reps), "near")
    ends = near.select(F.col("a").alias("content")).union(near.select(F.col("b").alias("content"))).distinct()
    wanted = materialise(reps.select(F.col("rid").alias("content"), "id").join(ends, "content"), "ends")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = wanted.select(F.col("id").alias(key)).distinct()
    texts = df.select(key, source).join(F.broadcast(ids) if few else ids, key)
    bags = token_table(texts, key, source).dropDuplicates(["content"])
    bags = materialise(bags.select("content", "tokens"), "bags")
    a = bags.select(F.col("content").alias("a"), F.col("tokens").alias("ta"))
    b = bags.select(F.col("content").alias("b"), F.col("tokens").alias("tb"))
    checked = near.join(a, "a").join(b, "b").withColumn("similarity", share_in_common(F.col("ta"), F.col("tb")))
    links = checked.filter(F.col("similarity") >= least).select(F.col("a").alias("content_a"), F.col("b").alias("content_b"), "similarity")
    return members, links


def similar_groups(df: DataFrame, key: str, source: str, least: float = words.SIMILAR) -> DataFrame:
    """(id, group_id, n_links): one row per id that repeats another's record.

    Groups are the connected components of the links; group_id is the least id
    of a group, n_links the number of ids whose records the id's repeats.
    """
    members, links = similar_classes(df, key, source, least)
    links = materialise(links, "links")
    size = members.groupBy("content").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    both = links.select("content_a", "content_b").unionByName(links.select(F.col("content_b").alias("content_a"), F.col("content_a").alias("content_b")))
    near = both.join(size.select(F.col("content").alias("content_b"), "copies"), "content_b").groupBy(F.col("content_a").alias("content")).agg(F.sum("copies").alias("near"))
    linked = components(links, "content_a", "content_b").withColumnRenamed("entity", "content")
    whole = size.join(near, "content", "left").join(linked, "content", "left")
    whole = whole.select("content", "least", F.coalesce("component", "content").alias("component"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    whole = materialise(whole.filter("n_links > 0"), "classes")
    named = whole.groupBy("component").agg(F.min("least").alias("group_id"))
    return members.join(whole, "content").join(named, "component").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links"))


def similar_pairs(df: DataFrame, key: str, source: str, least: float = words.SIMILAR) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two ids whose records repeat each other, full copies included.

    Sources that are null, aren't JSON objects or hold under 25 words pair with
    nothing. An id that stands in several rows counts once; if its rows hold
    different records any of them may match. Null ids are left out, and other
    columns of ``df`` don't matter, whatever their names. An empty table gives
    no rows.
    """
    members, links = similar_classes(df, key, source, least)
    links = materialise(links, "links")
    held = members.groupBy("id").agg(F.collect_set("content").alias("held"))
    members = materialise(held.select("id", F.explode("held").alias("content"), (F.size("held") > 1).alias("several")), "members")
    # two ids with one record each meet once; only pairs with an id of several records can come again
    one, several = members.filter(~F.col("several")), members.filter("several")

    def across(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = (side.select(F.col("content").alias(c), F.col("id").alias(x)) for side, c, x in ((left, "content_a", "x"), (right, "content_b", "y")))
        return links.join(a, "content_a").join(b, "content_b").select("x", "y")

    ordered = F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    pairs = across(one, one).unionByName(pairs_within(one, "content", "id")).select(*ordered)
    if several.isEmpty():
        return pairs
    again = across(several, members).unionByName(across(one, several)).unionByName(pairs_within(members, "content", "id", several))
    return pairs.unionByName(again.filter("x != y").select(*ordered).distinct())
