"""Duplicates of new batches against all history, from an index of hashes.

The index is a folder of tables that stays: it is opened by its path, asked
about a batch, and takes the batch's hashes in; nothing of the history is read
or hashed again, for all that a check needs is in the tables:

- ``contents``: a row per record with the hash of its bag of words, its sketch,
  its paragraph hashes with the words of each, and a hash for every word;
- ``heads``, bucketed by paragraph hash: the paragraphs that a content is found by;
- ``bands``, bucketed by key: the bands of its min-wise values, each with the whole
  sketch, so that contents which merely use the same words are told apart inside
  the bucket and only pairs worth reading are written or moved.

A full copy agrees in the content hash. For the rest each content's paragraphs
are put in one order, the same for all contents: paragraphs that many contents
share last, of the others the longest first. If the paragraphs that two
contents share cover the share ``least`` of their words, the first shared
paragraph of either is among those with at most 1 - ``least`` of its words ahead
of them: its heads. So a join of heads misses no such pair, and the coverage is
then summed over all paragraphs of both. A coverage of ``least`` proves the
similarity; where edits are spread over the paragraphs it can't, and pairs that
met by a head or by a band of the sketch are checked exactly, word by word.
17 bands of 5 hashes find a pair of similarity 0.7 with probability 0.956, of
0.75 with 0.99, of 0.8 with 0.999, of 0.85 with 0.9999; the paragraphs come on
top of that.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import neardup, words
from rosterlake.operators.drift import records
from rosterlake.session import _delete, materialise, shared_dir

#: A paragraph that more than this share of the contents have as a head is put last; so many there can be at most, however large the history.
OFTEN = 1 / 20_000
#: Bands of the min-wise values and hashes in each.
BANDS, ROWS = 17, 5
#: Bits on which a content's words are marked; a bit of one content only is a word of that one only, so they bound what two have in common.
MARKS = 512
#: A key that more contents of the index have is first tried with ``LEADERS`` of them; what those don't settle meets all the others.
HOT, LEADERS = 512, 16

_HASHED = "content bigint, n_words int, hashes array<bigint>, sizes array<int>, tokens array<int>, marks array<bigint>, low bigint, high bigint, low2 bigint, high2 bigint, bands array<int>, place string"
_BUCKETED = {"heads": "key bigint, content bigint, n_words int", "bands": "key int, content bigint, n_words int, low bigint, high bigint, low2 bigint, high2 bigint"}
_SKETCH = ["low", "high", "low2", "high2"]
_NAMES = [x.split()[0] for x in _HASHED.split(", ")]


def hashed(df: DataFrame, text: str, place: str) -> DataFrame:
    """(content, n_words, hashes, sizes, tokens, marks, low, high, low2, high2, bands, place) of each record with words enough; place says where to find it.

    ``hashes`` are its distinct paragraphs and ``sizes`` the words of each,
    ``tokens`` a hash of every word, ``marks`` bits of these, ``low`` to ``high2`` its sketch, ``bands`` 32 bits of
    each band's key (two that agree by chance are told apart by their sketches). A text that is null, isn't a JSON object or holds under 25 words gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, parsed in words.chunks(batch.column(0).to_pylist()):
                got = words.bags(parsed, paragraphs=True)
                if got is None:
                    continue
                hashes, sizes, first = got.paragraphs
                minima = neardup.minima(got.tokens, got.starts, max(neardup.SLICES, BANDS * ROWS))
                (low, high, keys), (low2, high2) = neardup.sketch_of(minima, BANDS, ROWS), neardup.second_bits(minima)
                pieces = pa.array(np.append(first, len(hashes)), pa.int32())
                bag = pa.array(np.append(got.starts, len(got.tokens)), pa.int32())
                banded = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
                folded = (got.tokens ^ (got.tokens >> np.uint64(32))).astype(np.uint32).view(np.int32)
                marks = np.zeros((len(got.starts), MARKS), bool)
                marks[np.repeat(np.arange(len(got.starts)), got.sizes), folded & (MARKS - 1)] = True
                marks = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(marks, axis=1).view(np.int64).reshape(-1)), MARKS // 64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(got.contents), pa.array(got.sizes.astype(np.int32)), pa.ListArray.from_arrays(pieces, pa.array(hashes)),
                        pa.ListArray.from_arrays(pieces, pa.array(sizes)), pa.ListArray.from_arrays(bag, pa.array(folded)), marks.cast(pa.list_(pa.int64())), pa.array(low), pa.array(high),
                        pa.array(low2), pa.array(high2), pa.ListArray.from_arrays(banded, pa.array((keys.reshape(-1) >> 32).astype(np.int32))), batch.column(1).take(pa.array(got.rows + at)),
                    ],
                    _NAMES,
                )

    return df.select(F.col(text).alias("s"), F.col(place).cast("string").alias("p")).mapInArrow(run, _HASHED)


def heads(batch: DataFrame, often: np.ndarray, least: float) -> DataFrame:
    """(key, content, n_words) of the paragraphs by which each content is found; ``often`` are the hashes put last, sorted."""
    shared = batch.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            content, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            hashes, sizes = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())
            last = np.isin(hashes, shared.value)
            order = np.lexsort((hashes, -sizes, last, owner))
            hashes, sizes, owner = hashes[order], sizes[order], owner[order]
            before = np.cumsum(sizes) - sizes
            first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            ahead = before - np.maximum.accumulate(np.where(first, before, 0))
            head = ahead <= (1 - least) * n[owner] + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(hashes[head]), pa.array(content[owner[head]]), pa.array(n[owner[head]])], ["key", "content", "n_words"])

    return batch.select("content", "n_words", "hashes", "sizes").mapInArrow(run, _BUCKETED["heads"])


class HashIndex:
    """Tables of the hashes of everything accepted so far, in a folder.

    With a ``path`` the index stays there and is opened again by it, by any
    session; without one it is made in the shared folder and goes at exit.
    ``buckets`` is how many buckets its tables have; it is stored with a new
    index, and where the index exists that number holds. ``least`` is the
    similarity it is made for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, least: float = words.SIMILAR):
        self.spark, self.name = spark, f"rosterlake_{uuid.uuid4().hex[:12]}"
        self.path = path.rstrip("/") if path else f"{shared_dir(spark).rstrip('/')}/rosterlake/{self.name}"
        if not path:
            atexit.register(_delete, spark, self.path)
        atexit.register(self.close)
        made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + "/made")
        self.filled = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(made)
        self._open: set[str] = set()
        if self.filled:
            self.buckets, self.least = spark.read.parquet(self.path + "/made").select("buckets", "least").first()
            self.often = self._often()
        else:
            self.buckets, self.least, self.often = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), least, np.array([], np.int64)

    def close(self) -> None:
        """Forget the tables' names in the catalog; the files stay."""
        try:
            for part in self._open:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
        except Exception:  # the session may be gone already
            pass
        self._open = set()

    def _often(self) -> np.ndarray:
        return np.sort(self.spark.read.schema("key bigint").parquet(self.path + "/often").toArrow().column("key").to_numpy())

    def _start(self, batch: DataFrame) -> None:
        """Which paragraphs are put last is settled by the first batch, as heads must mean the same ever after."""
        n = batch.count()
        counts = heads(batch, self.often, self.least).groupBy("key").agg(F.count("*").alias("n"))
        counts.filter(F.col("n") > F.lit(max(2.0, n * OFTEN))).select("key").write.parquet(self.path + "/often")
        self.often = self._often()
        self.spark.createDataFrame([(self.buckets, self.least)], "buckets int, least double").coalesce(1).write.parquet(self.path + "/made")

    def append(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add the rows of :func:`hashed`. Of equal contents one is found again, and none that the index has already.

        Returns the rows, and the contents among them that the index had
        before. Of the index only the column of contents is read.
        """
        old = self.contents().select("content").distinct() if self.filled else None
        where = f"{self.path}/contents/{uuid.uuid4().hex}"
        batch.write.option("compression", "zstd").parquet(where)
        rows = self.spark.read.schema(_HASHED).parquet(where)
        if old is None:
            stored = self.spark.createDataFrame([], "content bigint")
            new = rows
        else:
            stored = materialise(rows.select("content").distinct().join(old, "content", "left_semi"), "stored")
            new = rows.join(stored, "content", "left_anti")
        several = materialise(new.groupBy("content").count().filter("count > 1").select("content"), "several")
        few = several.limit(neardup.BROADCAST_ROWS + 1).count() <= neardup.BROADCAST_ROWS
        repeated = F.broadcast(several) if few else several
        parts = new.select("content", "n_words", "hashes", "sizes", *_SKETCH, "bands")
        once = parts.join(repeated, "content", "left_anti").unionByName(parts.join(repeated, "content", "left_semi").dropDuplicates(["content"]))
        if not self.filled:
            self._start(once)
        self._write(heads(once, self.often, self.least), "heads")
        self._write(once.select(F.explode("bands").alias("key"), "content", "n_words", *_SKETCH), "bands")
        self.filled = True
        return rows, stored

    def _write(self, df: DataFrame, part: str) -> None:
        by = _BUCKETED[part].split()[0]
        name = self._named(part)
        df.repartition(self.buckets, by).write.mode("append").format("parquet").bucketBy(self.buckets, by).saveAsTable(name)

    def _named(self, part: str) -> str:
        """The table's name in the catalog, which it has while the index is open."""
        name = f"{self.name}_{part}"
        if part not in self._open:
            by = _BUCKETED[part].split()[0]
            self.spark.sql(f"CREATE TABLE {name} ({_BUCKETED[part]}) USING parquet OPTIONS (path '{self.path}/{part}', compression 'zstd') CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS")
            self._open.add(part)
        return name

    def contents(self) -> DataFrame:
        """The rows of :func:`hashed` of everything appended."""
        return self.spark.read.schema(_HASHED).option("recursiveFileLookup", "true").parquet(self.path + "/contents")

    def keyed(self, part: str) -> DataFrame:
        """A bucketed table: ``heads`` (key, content, n_words) or ``bands`` (key, content, n_words and the sketch)."""
        return self.spark.table(self._named(part))

    def asked(self, batch: DataFrame) -> dict[str, DataFrame]:
        """The batch's own rows of ``heads`` and ``bands``."""
        own = batch.dropDuplicates(["content"])
        return {
            "heads": heads(own, self.often, self.least),
            "bands": own.select(F.explode("bands").alias("key"), "content", "n_words", *_SKETCH),
        }

    def _fits(self, part: str) -> F.Column:
        size = F.least("n", "n_words") >= self.least * F.greatest("n", "n_words")
        if part == "bands":
            low, high, low2, high2 = (F.col(c).bitwiseXOR(F.col(f"asked_{c}")) for c in _SKETCH)
            size = size & (F.bit_count(low) + F.bit_count(high) <= neardup.RADIUS) & (F.bit_count(low.bitwiseOR(low2)) + F.bit_count(high.bitwiseOR(high2)) <= neardup.RADIUS_BOTH)
        return size & (F.col("asked") != F.col("other"))

    def find_hot(self, asked: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The keys of ``asked``, by table, that more than ``HOT`` contents of the index have; tables without any are left out."""
        out = {}
        for part, mine in asked.items():
            rows = self.keyed(part).select("key").join(mine.select("key").distinct(), "key", "left_semi")
            hot = materialise(rows.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot")
            several = hot.limit(neardup.BROADCAST_ROWS + 1).count()
            if several:
                out[part] = F.broadcast(hot) if several <= neardup.BROADCAST_ROWS else hot
        return out

    def meeting(self, asked: dict[str, DataFrame], hot: dict[str, DataFrame], among: DataFrame | None = None) -> DataFrame:
        """(asked, other): contents that share a head or a band and whose sizes, and sketches, allow the similarity.

        Of the contents with a hot key only some leaders are met; given
        ``among``, (content), these contents meet all that share their hot keys,
        and nothing else.
        """
        both = None
        for part, mine in asked.items():
            theirs = self.keyed(part).withColumnRenamed("content", "other")
            mine = mine.withColumnsRenamed({"content": "asked", "n_words": "n"} | {c: f"asked_{c}" for c in _SKETCH})
            if among is not None:
                if part not in hot:
                    continue
                mine = mine.join(hot[part], "key", "left_semi").join(among.withColumnRenamed("content", "asked"), "asked", "left_semi")
                sides = [(mine, theirs)]
            elif part in hot:
                # two joins and no union of rows, which would lose the buckets
                columns = [c for c in theirs.columns if c not in ("key", "other")]
                classes = theirs.join(hot[part], "key", "left_semi").groupBy("key", F.pmod("other", F.lit(LEADERS)))
                first = classes.agg(F.min(F.struct("other", *columns)).alias("f")).select("key", "f.*")
                sides = [(mine.join(hot[part], "key", "left_anti"), theirs), (mine.join(hot[part], "key", "left_semi"), first)]
            else:
                sides = [(mine, theirs)]
            for left, right in sides:
                met = left.join(right, "key").filter(self._fits(part)).select("asked", "other")
                both = met if both is None else both.unionByName(met)
        return materialise(both.distinct(), "met")

    def _ends(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Columns of the contents that stand in the pairs, once each."""
        ends = materialise(pairs.select(F.col("asked").alias("content")).union(pairs.select(F.col("other").alias("content"))).distinct(), "ends")
        few = ends.limit(neardup.BROADCAST_ROWS + 1).count() <= neardup.BROADCAST_ROWS
        rows = self.contents().select("content", *columns).join(F.broadcast(ends) if few else ends, "content", "left_semi")
        return materialise(rows.dropDuplicates(["content"]), "held")

    def similar(self, met: DataFrame) -> DataFrame:
        """(asked, other) of the pairs that are similar: by the coverage of shared paragraphs, else by their words."""

        def joined(pairs: DataFrame, *columns: str) -> DataFrame:
            held = self._ends(pairs, *columns)
            for name, mark in (("asked", "_a"), ("other", "_b")):
                pairs = pairs.join(held.select(F.col("content").alias(name), *[F.col(c).alias(c + mark) for c in columns]), name)
            return pairs

        apart = joined(met, "n_words", "marks")
        common = None
        for x, y in ("_a", "_b"), ("_b", "_a"):
            own = F.aggregate(F.zip_with(f"marks{x}", f"marks{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
            most = F.col(f"n_words{x}") - own
            common = most if common is None else F.least(common, most)
        enough = common * (1 + self.least) >= self.least * (F.col("n_words_a") + F.col("n_words_b")) - 1e-9
        pairs = joined(materialise(apart.filter(enough).select("asked", "other"), "near"), "n_words", "hashes", "sizes", "tokens")
        shared = F.array_intersect("hashes_a", "hashes_b")
        covered = F.aggregate(
            shared, F.lit(0), lambda s, h: s + F.least(F.element_at("sizes_a", F.array_position("hashes_a", h).cast("int")), F.element_at("sizes_b", F.array_position("hashes_b", h).cast("int")))
        )
        coverage = covered / (F.col("n_words_a") + F.col("n_words_b") - covered)
        alike = (coverage >= self.least) | (neardup.share_in_common(F.col("tokens_a"), F.col("tokens_b")) >= self.least)
        return materialise(pairs.filter(alike).select("asked", "other"), "similar")


def pending_records(requests: DataFrame) -> DataFrame:
    """(request_id, record_no, record, received_at) of pending requests, each once however often it was delivered."""
    held = requests.filter(F.col("status") == "pending").filter(F.col("candidates").isNotNull())
    once = held.groupBy("request_id").agg(F.min("received_at").alias("received_at"), F.min_by("candidates", "received_at").alias("candidates"))
    empty = requests.limit(0).select(F.col("request_id"), F.lit(None).cast("int").alias("record_no"), F.lit(None).cast("string").alias("source"))
    return records(empty, once).join(once.select("request_id", "received_at"), "request_id")


def refused(candidates: DataFrame | None, requests: DataFrame, index: HashIndex | None = None) -> DataFrame:
    """(request_id, record_no) of pending records that repeat a stored or an earlier pending record; then all of them are accepted.

    Stored is what ``index`` holds and what ``candidates`` adds to it; with an
    index that holds the history already, ``candidates`` is None and nothing
    but the batch is hashed. Afterwards the index holds the batch too. Earlier
    means by received_at, then record_no, then request_id.

    Records that are null, aren't JSON objects or hold under 25 words neither
    are refused nor refuse others. Of equal records the first stays, unless
    history has it. Requests delivered twice count once; other columns don't
    matter, whatever their names; empty tables give no rows.
    """
    index = index or HashIndex(requests.sparkSession)
    if candidates is not None:
        index.append(hashed(candidates.filter(F.col("id").isNotNull()), "source", "id"))
    # the place in the order of arrival: microseconds, then record_no; request_id breaks what ties are left
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    place = F.concat_ws(" ", at.cast("string"), F.col("record_no").cast("string"), F.col("request_id").cast("string"))
    batch, stored = index.append(hashed(pending_records(requests).select("record", place.alias("place")), "record", "place"))
    parts = F.split("place", " ").cast("array<bigint>")
    new = batch.select("content", parts.alias("p")).select("content", F.col("p")[0].alias("at"), F.col("p")[1].cast("int").alias("record_no"), F.col("p")[2].alias("request_id"))
    order = F.struct("at", "record_no", "request_id")
    firsts = new.groupBy("content").agg(F.min(order).alias("first"))
    known = materialise(firsts.join(stored.withColumn("stored", F.lit(True)), "content", "left"), "known")
    # what history has is refused already, and nobody else needs to be compared for it
    asked = index.asked(batch.join(stored, "content", "left_anti"))
    asked = {part: materialise(rows, part) for part, rows in asked.items()}

    def judged(similar: DataFrame) -> DataFrame:
        """(content, like_stored, like_first): history counts as before everything."""
        theirs = similar.join(known.select(F.col("content").alias("other"), "first", "stored"), "other", "left")
        old = F.col("first").isNull() | F.coalesce(F.col("stored"), F.lit(False))
        return theirs.groupBy(F.col("asked").alias("content")).agg(F.max(old).alias("like_stored"), F.min("first").alias("like_first"))

    hot = index.find_hot(asked)
    similar = index.similar(index.meeting(asked, hot))
    if hot:
        # whoever repeats a stored record, or one before its own first, is settled; the others meet all that have their hot keys
        settled = judged(similar).join(known, "content").filter(F.col("like_stored") | (F.col("like_first") < F.col("first")))
        unsettled = materialise(known.filter(F.col("stored").isNull()).select("content").join(settled.select("content"), "content", "left_anti"), "unsettled")
        similar = similar.unionByName(index.similar(index.meeting(asked, hot, unsettled)))
    everyone = new.join(known, "content").join(judged(similar), "content", "left")
    earlier = (
        F.coalesce("stored", F.lit(False)) | F.coalesce("like_stored", F.lit(False))
        | (order > F.col("first")) | F.coalesce(order > F.col("like_first"), F.lit(False))
    )
    return everyone.filter(earlier).select("request_id", "record_no").distinct()
