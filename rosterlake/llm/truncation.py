"""Values that lost their end on the way.

A backward character n-gram model: for the last characters of a value it says
how often the corpus goes on after just these characters and how often a value
ends there. A cut can fall anywhere, so it falls where the corpus nearly always
goes on; a context after which values often end is a natural end, however often
others go on. The log-odds of going on against ending, with what the value's
length adds (values cut at a field limit share its length), are compared
with a threshold per column and language, put where fewest values lie.

Names, rare words and numbers stand for themselves nowhere else, so they are
masked before counting: ``N`` and ``0``. The last word is tried as it stands
first, since a cut in a word leaves a piece that the corpus goes on after; of a
word that is masked everywhere, a piece is known by the frequent words that
begin with it.

Counts cover all values. Contexts that end no value can't be asked for and are
sifted out before anything is shuffled, by a Bloom filter whose size follows
from the number of contexts asked for, up to a fixed most; a full one sifts
less, the counts stay right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import materialise

#: Lengths of the contexts, in characters, longest first.
ORDERS = (44, 32, 23, 16, 11, 7, 4)
#: A context decides if, besides the value itself, so many values end after it or it goes on so often.
ENDS, GOES_ON = 2, 12
#: What the last word being a piece of a frequent word adds to the log-odds, and the most that the length adds.
PIECE, PILE = 12.0, 1.5
#: What a sign of a cut at the very end (an ellipsis, an opened bracket or tag) adds.
MARK = 16.0
#: Words kept as they are: those of at least this share of a column's values, so 1 / ``SHARE`` times the words of a value at most.
SHARE = 1 / 2000
#: Bits of the Bloom filter for each context asked for, and the most it has (32 MB), as a power of two.
BITS_EACH, MOST_BITS = 12, 28
#: What counts as seen ends of a context that ended no other value.
PRIOR = 0.05
#: The threshold is sought in this range of log-odds; a column and language with few values gets ``USUAL``.
LOWEST, HIGHEST, USUAL, FEW = 1.5, 4.5, 3.0, 500

_WORD = re.compile(r"[^\W\d_][^\W_]*(?:[+#]+|\.js|-[^\W_]+)*|\d+")
_MARK = re.compile(r"(?:…|\.\.\.?|\[\s*(?:…|\.\.\.|more|cut|truncated)\s*\]|\((?:more|cut|truncated|continued)\)|�)\s*$", re.I)
#: An opened tag, bracket, placeholder or entity at the very end.
_OPEN = re.compile(r"(?:<[^<>\s][^<>]{0,30}|\[[A-Z][^\[\]]{0,30}|&#?\w{1,8}|\\u?[0-9a-fA-F]{0,3}|%[0-9A-F]?)$")
#: A few of the most frequent words of each language.
_COMMON = {
    "en": "the and of to in for with on is was they that who", "de": "der die das und für mit von ist auf nicht den dem",
    "fr": "le la les et des pour avec une est dans du sur", "es": "el los las y para con una es del por que en",
    "pt": "o os e para com uma é do da em que não", "nl": "de het een en voor met van is op niet dat die", "ru": "и в на с для по не что из от как за",
}
_LANGUAGE = {w: code for code, ws in _COMMON.items() for w in ws.split()}


def language(text: str) -> str:
    """The language most of whose frequent words stand in the text; English if fewer than two do."""
    votes: dict[str, int] = {}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if (code := _LANGUAGE.get(w)) is not None:
            votes[code] = votes.get(code, 0) + 1
    best = max(votes, key=lambda k: (votes[k], k == "en")) if votes else "en"
    return best if votes.get(best, 0) > 1 else "en"


class Mask:
    """Numbers as 0; words out of the vocabulary, and words with a capital that begin no sentence, as N."""

    def __init__(self, vocabulary: frozenset[str]):
        self.vocabulary = vocabulary
        self.fixed = {w: w for w in vocabulary if w.islower()}

    def _one(self, m: re.Match) -> str:
        word = m.group()
        if (same := self.fixed.get(word)) is not None:
            return same
        if word[0].isdigit():
            return "0"
        if word not in self.vocabulary:
            return "N"
        text, i = m.string, m.start() - 1
        while i >= 0 and text[i] in " \n\t":
            i -= 1
        return word if i < 0 or text[i] in ".!?" else "N"

    def __call__(self, text: str) -> str:
        return _WORD.sub(self._one, text)


_LAST = re.compile(rf"(?:{_WORD.pattern})$")


def endings(text: str, mask: Mask) -> tuple[str, str | None, bool]:
    """The value masked; masked but for its last word, where that differs; whether that word is a piece of frequent ones."""
    full = mask(text)
    last = _LAST.search(text[-200:])
    if last is None or full.endswith(word := last.group()):
        return full, None, False
    cut = len(full) - 1  # the last word is one character when masked
    piece = word not in mask.vocabulary and any(w.startswith(word) for w in mask.vocabulary)
    return full, full[:cut] + word, piece


class Runs:
    """Hashes of all runs of characters of some texts, from one pass of prefix sums."""

    _BASE = 0x9E3779B97F4A7C15
    _INVERSE = pow(_BASE, -1, 1 << 64)

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.stops = np.cumsum(self.lengths)
        n = len(self.points)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, self._BASE, np.uint64))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.points * power)])
            self.inverse = np.cumprod(np.full(n, self._INVERSE, np.uint64))

    def hashes(self, size: int, salt: int, first: np.ndarray | slice) -> np.ndarray:
        """The hashes of the runs of ``size`` characters that begin at the places ``first``."""
        with np.errstate(over="ignore"):
            if isinstance(first, slice):
                h = self.sums[size:] - self.sums[: len(self.sums) - size]
                h *= self.inverse[: len(h)]
            else:
                h = (self.sums[first + size] - self.sums[first]) * self.inverse[first]
            h ^= np.uint64(salt)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h


def _salt(column: str, lang: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{column}|{lang}|{size}")


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    top = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        return (h >> top).astype(np.int64), ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> top).astype(np.int64)


def _vocabulary(values: DataFrame) -> dict[str, frozenset[str]]:
    """The frequent words of each column; their number is bounded by 1 / SHARE times the words of a value."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for column, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[column] = rows.get(column, 0) + 1
                for w in set(_WORD.findall(text)):
                    if not w[0].isdigit():
                        seen[column, w] = seen.get((column, w), 0) + 1
            if len(seen) > 500_000:
                yield _counted(seen, rows)
                seen, rows = {}, {}
        yield _counted(seen, rows)

    words = values.select("field_name", "value").mapInArrow(count, "field_name string, word string, n bigint")
    words = materialise(words.groupBy("field_name", "word").agg(F.sum("n").alias("n")), "words")
    total = {r["field_name"]: r["n"] for r in words.filter("word = ''").collect()}
    out = {}
    for column, n in total.items():
        top = words.filter((F.col("field_name") == column) & (F.col("word") != "") & (F.col("n") >= max(5, n * SHARE)))
        out[column] = frozenset(r["word"] for r in top.select("word").collect())
    return out


def _counted(seen: dict, rows: dict) -> pa.RecordBatch:
    found = [(c, w, n) for (c, w), n in seen.items()] + [(c, "", n) for c, n in rows.items()]
    a, b, c = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["field_name", "word", "n"])


_PREPARED = "value_id bigint, field_name string, lang string, size int, marked boolean, piece boolean, masked string, plain string, n bigint"
_ASKED = "value_id bigint, masked int, context int, hash bigint"


def prepare(values: DataFrame) -> DataFrame:
    """Each value with its language, its length, what marks it as cut, and its masked forms."""
    vocabulary = values.sparkSession.sparkContext.broadcast(_vocabulary(values))
    names = [x.split()[0] for x in _PREPARED.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {c: Mask(v) for c, v in vocabulary.value.items()}
        for batch in batches:
            out = []
            for vid, column, text, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                full, plain, piece = endings(text.rstrip(), masks[column])
                marked = bool(_MARK.search(text) or _OPEN.search(text))
                out.append((vid, column, language(text), len(text), marked, piece, "\x02" + full, None if plain is None else "\x02" + plain, n))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return values.select("value_id", "field_name", "value", "n").mapInArrow(run, _PREPARED)


def _groups(batch: pa.RecordBatch, column: int, lang: int) -> Iterator[tuple[str, str, np.ndarray]]:
    """(field_name, lang, rows) of the groups in a batch."""
    names = np.array([f"{a}\x00{b}" for a, b in zip(batch.column(column).to_pylist(), batch.column(lang).to_pylist(), strict=True)])
    for name in np.unique(names):
        yield *name.split("\x00"), np.flatnonzero(names == name)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the last characters of each value, for every order."""
    for whole in batches:
        for at in range(0, whole.num_rows, 10_000):
            batch = whole.slice(at, 10_000)
            ids = batch.column(0).to_numpy()
            for column, lang, rows in _groups(batch, 1, 2):
                for masked, texts in ((1, batch.column(3)), (0, batch.column(4))):
                    own = [(i, t) for i, t in zip(rows, texts.take(pa.array(rows)).to_pylist(), strict=True) if t is not None]
                    if not own:
                        continue
                    runs, vid = Runs([t for _, t in own]), ids[[i for i, _ in own]]
                    for k, size in enumerate(ORDERS):
                        long = runs.lengths >= size
                        h = runs.hashes(size, _salt(column, lang, size), (runs.stops - size)[long])
                        n = len(h)
                        yield pa.RecordBatch.from_arrays([pa.array(vid[long]), pa.array(np.full(n, masked, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(h.view(np.int64))], ["value_id", "masked", "context", "hash"])


def score(values: DataFrame) -> DataFrame:
    """(value_id, field_name, lang, size, marked, ratio, context) of (value_id, field_name, value, n) rows, values neither null nor blank.

    ratio is the log-odds of going on against ending; context says which order
    decided; marked says that the value shows that it was cut. Values should be
    distinct per field, n says how many ids have each.
    """
    spark = values.sparkSession
    prepared = materialise(prepare(values), "prepared")
    columns = prepared.select("value_id", "field_name", "lang", "masked", "plain")
    asked = materialise(columns.mapInArrow(_ask, _ASKED), "asked")
    bloom = spark.sparkContext.broadcast(_bloom(asked))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                batch = whole.slice(at, 10_000)
                often = batch.column(3).to_numpy()
                for column, lang, rows in _groups(batch, 0, 1):
                    for part in (rows[often[rows] == 1], rows[often[rows] > 1]):
                        if len(part):
                            yield from _inside(column, lang, batch.column(2).take(pa.array(part)).to_pylist(), often[part], table)

    on = prepared.select("field_name", "lang", "masked", "n").mapInArrow(inside, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("goes_on"))
    # the wholly masked ending is the end that counts; the other one is a question about the same end
    ends = asked.filter("masked = 1").join(prepared.select("value_id", "n"), "value_id").groupBy("hash").agg(F.sum("n").alias("ends"))
    counts = materialise(ends.join(on, "hash", "full").fillna(0, ["ends", "goes_on"]), "counts")
    odds = asked.join(counts, "hash", "left").fillna(0, ["ends", "goes_on"])
    # one occurrence of the value is the one in question and no evidence
    odds = odds.withColumn("ends", F.greatest(F.lit(0), F.col("ends") - F.col("masked")))
    enough = F.when((F.col("ends") >= ENDS) | (F.col("goes_on") >= GOES_ON), F.struct("context", "ends", "goes_on"))
    # the longest context that was seen often enough; with the last word as it stands if any was, else with it masked
    best = odds.groupBy("value_id").agg(
        F.min(F.when((F.col("masked") == 0) & (F.col("context") <= F.lit(len(ORDERS) - 2)), enough)).alias("plain"),
        F.min(F.when(F.col("masked") == 1, enough)).alias("full"),
    )
    chosen = best.select("value_id", F.coalesce("plain", "full").alias("c"))
    ratio = F.log((F.coalesce("c.goes_on", F.lit(0)) + PRIOR) / (F.coalesce("c.ends", F.lit(0)) + PRIOR))
    rest = prepared.select("value_id", "field_name", "lang", "size", "marked", "piece").join(chosen, "value_id", "left")
    ratio = ratio + F.when(F.col("piece"), F.lit(PIECE)).otherwise(F.lit(0.0))
    return rest.select("value_id", "field_name", "lang", "size", "marked", ratio.alias("ratio"), "c.context")


def _inside(column: str, lang: str, texts: list[str], often: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each asked context goes on in the texts: (hash, n)."""
    runs = Runs(texts)
    weight = np.repeat(often, runs.lengths)
    # how many characters of its own text come after each place
    rest = np.repeat(runs.stops, runs.lengths) - np.arange(len(runs.points))
    for size in ORDERS:
        if len(runs.points) < size:
            continue
        h = runs.hashes(size, _salt(column, lang, size), slice(None))
        inside = rest[: len(h)] > size  # the run and one character more
        h = h[inside]
        asked = np.ones(len(h), bool)
        for place in _bits(h, (table.size * 8).bit_length() - 1):
            asked &= (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        h = h[asked]
        if not len(h):
            continue
        if often.max() == 1:
            found, n = np.unique(h, return_counts=True)
        else:
            found, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, weights=weight[: len(inside)][inside][asked])
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])


def _bloom(asked: DataFrame) -> np.ndarray:
    """A filter of all asked contexts as bytes: two bits for each, filled where the contexts are."""
    bits = min(MOST_BITS, max(16, (BITS_EACH * asked.count() - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False), bits))
            cells, at = np.unique(both >> 6, return_inverse=True)
            words = np.zeros(len(cells), np.uint64)
            np.bitwise_or.at(words, at, np.uint64(1) << (both & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(words.view(np.int64))], ["place", "bits"])

    rows = asked.select("hash").mapInArrow(fill, "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(1 << (bits - 6), np.int64)
    got = rows.toArrow()
    words[got.column("place").to_numpy()] = got.column("bits").to_numpy()
    return words.view(np.uint8)


def cut_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, field_name, value, lang, log_odds, is_cut) of every distinct value of every id.

    Null and blank values give no row; so do null ids. An id with several
    values has a row for each. Values whose ending was never seen elsewhere
    have log-odds 0 and count as whole unless they are marked. Other columns
    don't matter, whatever their names.
    """
    parts = [df.select(F.col(key).alias("id"), F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.filter(F.col("id").isNotNull() & (F.trim("value") != "")).distinct()
    long = materialise(long.withColumn("value_id", F.xxhash64("field_name", "value")), "values")
    values = long.groupBy("value_id").agg(F.first("field_name").alias("field_name"), F.first("value").alias("value"), F.count("*").alias("n"))
    scored = materialise(score(values), "scored")
    odds = scored.join(F.broadcast(_limits(scored)), ["field_name", "size"], "left")
    odds = odds.select("value_id", "field_name", "lang", "marked", (F.col("ratio") + F.coalesce("pile", F.lit(0.0)) + F.when(F.col("marked"), F.lit(MARK)).otherwise(F.lit(0.0))).alias("log_odds"))
    limit = _thresholds(odds)
    judged = odds.join(F.broadcast(limit), ["field_name", "lang"], "left")
    cut = F.col("log_odds") > F.coalesce("threshold", F.lit(USUAL))
    return long.join(judged.select("value_id", "lang", "log_odds", cut.alias("is_cut")), "value_id").select("id", "field_name", "value", "lang", "log_odds", "is_cut")


def _thresholds(odds: DataFrame) -> DataFrame:
    """(field_name, lang, threshold): the quarter of log-odds with fewest values round it; a row per column and language."""
    step = 0.25
    bins = odds.filter(~F.col("marked")).groupBy("field_name", "lang", F.floor(F.col("log_odds") / step).alias("bin")).agg(F.count("*").alias("n"))
    every = bins.groupBy("field_name", "lang").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"))
    low, high = int(LOWEST / step), int(HIGHEST / step)
    at = F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))
    around = F.transform(at, lambda b: F.struct(sum(F.coalesce(F.try_element_at("n", b + k), F.lit(0)) for k in (-1, 0, 1)).alias("n"), F.abs(b * step - USUAL).alias("off"), (b * step + step / 2).alias("t")))
    return every.filter(F.col("all") >= FEW).select("field_name", "lang", F.array_min(around)["t"].alias("threshold"))


def _limits(scored: DataFrame) -> DataFrame:
    """(field_name, size, pile): how much likelier a value of that length is among those that look cut than among whole ones.

    Values far on either side of the threshold stand for cut and whole ones. The
    lengths that stand out are those of field limits: each holds a five
    hundredth of the cut values or more, so there are 500 at most.
    """
    cut, whole = F.count_if(F.col("ratio") > USUAL + 0.5), F.count_if(F.col("ratio") < LOWEST)
    sizes = scored.filter(~F.col("marked")).groupBy("field_name", "size").agg(cut.alias("cut"), whole.alias("whole"))
    total = sizes.groupBy("field_name").agg(F.sum("cut").alias("all_cut"), F.sum("whole").alias("all_whole"))
    share = ((F.col("cut") + 1) / (F.col("all_cut") + 100)) / ((F.col("whole") + 1) / (F.col("all_whole") + 100))
    both = sizes.join(F.broadcast(total), "field_name").filter((F.col("cut") >= F.greatest(F.lit(5.0), F.col("all_cut") / 500)) & (share >= 2))
    return both.select("field_name", "size", F.least(F.lit(PILE), F.log(share)).alias("pile"))
