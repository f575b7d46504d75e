"""The language of documents and of their segments.

Multinomial naive Bayes over hashed character n-grams. Texts are cut into
segments once and written. The counts come from a bounded sample of the
documents whose label names one of the languages; a second round leaves out
segments that the first one reads otherwise, so wrong labels don't teach. The
matrix of log-probabilities has a fixed size and is broadcast; a batch is scored
as sparse rows against it in numpy.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rosterlake.session import materialise

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru")
BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3, 4)

#: Notations of the languages in labels, after lower case and without region or script.
NOTATIONS = {
    "en": "en eng english englisch anglais inglés inglês engels английский",
    "de": "de deu ger german deutsch allemand alemán alemão duits немецкий",
    "fr": "fr fra fre french français francais französisch francés francês frans французский",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol spaans испанский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portugees португальский",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés holandês голландский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}
#: Labels that name no language.
NO_LANGUAGE = frozenset("? ?? - -- und unk unknown undefined undetermined xx zxx mis mul none null nan n/a na other auto".split())
_OF = {n: code for code, names in NOTATIONS.items() for n in names.split()}


def label_language(label: str | None) -> str | None:
    """The language a label names: a code of ``LANGUAGES``, another name as it stands, or None if it names none."""
    text = unicodedata.normalize("NFC", label or "").strip().lower()
    if not text or text in NO_LANGUAGE:
        return None
    if text in _OF:
        return _OF[text]
    head = re.split(r"[-_ ./(]", text, maxsplit=1)[0]
    if head in NO_LANGUAGE or not re.search(r"[^\W\d_]", head):
        return None
    return _OF.get(head, head)


_CODE = re.compile(r"```.*?```|`[^`\n]{1,200}`", re.S)
_STATEMENT = re.compile(r"\bSELECT\b[^\n.]{1,120}?\bFROM\b[^\n;]*;?|^[^\n]*(?:[<>=!]=|\bdef \w+\(|\breturn \w+\W|;;|\(\)\s*\{)[^\n]*$", re.M)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]{0,300}>")
_NOISE = re.compile(r"https?://\S+|(?<!\S)\S+@\S+|[#@]\w+|\{[^{}\n]{0,300}\}|(?<!\S)\S*[\\/=_$]\S*|&\w{1,8};|\d+")
_CUT = re.compile(r"(?<=[.!?…:;])\s+|\n\s*\n+|\n\s*(?:[-–—•*>]|\d+[.)])\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_PAGE = re.compile(r"^[^\w\n]*\[[^\[\]\n]{1,40}\][^\w\n]*$|^[^\w\n]*-{2,}[^\n]{1,40}-{2,}[^\w\n]*$", re.M)


#: Characters without which nothing is noise, and parts without one of which no line is a statement.
_NOISY = re.compile(r"[\\/=_$@#{&\d]")
_STATED = ("SELECT", "==", "!=", "<=", ">=", "def ", "return ", ";;", "()")


def segments(text: str, longest: int = 30) -> list[str]:
    """The sentences of a text in order, long runs without a stop in pieces.

    Markup, code, links, addresses and numbers are left out; a line end inside a
    paragraph is no end of a sentence.
    """
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    if "`" in text:
        text = _CODE.sub(" ", text)
    if any(part in text for part in _STATED):
        text = _STATEMENT.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group(2).lower() in ("b", "i", "em", "strong", "a", "span", "u") else "\n\n", text)
    if "[" in text or "--" in text:
        text = _PAGE.sub(" ", text)
    out = []
    for piece in _CUT.split(text):
        if not piece:
            continue
        line = " ".join([x for x in piece.split("\n") if not (len(x) < 60 and x.isupper())]) if "\n" in piece or len(piece) < 60 else piece
        words = _LETTERS.findall((_NOISE.sub(" ", line) if _NOISY.search(line) else line).lower())
        if len(words) <= longest:
            if words:
                out.append(" ".join(words))
            continue
        out.extend(pieces(words, longest))
    return out


def pieces(words: list[str], longest: int = 30) -> list[str]:
    """A long run of words in pieces of about that many words."""
    size = -(-len(words) // max(1, round(len(words) / longest)))
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


#: A segment of fewer words has a language, but no say in that of its document if there are longer ones.
FEWEST = 4


def has_say(segment: str) -> bool:
    return segment.count(" ") >= FEWEST - 1


def readable(documents: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, label, named, segments) of every document with words, written once for training and scoring.

    A text whose sentences are all too short, or all look like headings or
    code, is judged by all its words, in pieces of the usual length.
    """
    schema = StructType([StructField(key, documents.schema[key].dataType), *StructType.fromDDL("label string, named string, segments array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                found = segments(body) if body else []
                if body and not any(map(has_say, found)):
                    rest = _LETTERS.findall(_NOISE.sub(" ", _TAG.sub(" ", body)).lower())
                    found = pieces(rest) if rest else found
                if found:
                    keep.append(i)
                    texts.append(found)
            rows = pa.array(keep, pa.int32())
            labels = batch.column(2).take(rows)
            named = pa.array([label_language(x) for x in labels.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), labels, named, pa.array(texts, pa.list_(pa.string()))], [key, "label", "named", "segments"])

    rows = documents.select(F.col(key), F.col(text).alias("t"), F.col(label).cast("string").alias("l"))
    return materialise(rows.mapInArrow(run, schema), "segments")


#: Characters that are looked at together; what a batch needs of memory goes with it.
CHUNK = 150_000


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 2
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets of the character n-grams, first and last place of each text's) for each order.

    Between the last n-gram of a text and the first of the next stand some that reach over the border.
    """
    lengths = np.array([len(t) + 2 for t in texts])
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.cumsum(lengths)
    starts = stops - lengths
    h = np.full(len(points), 0x811C9DC5, np.uint32)
    for n in ORDERS:  # each order's hash goes on from the one before
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] ^ points[n - 1 :]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        yield ((h * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BITS)).astype(np.int32), starts, stops - n + 1


def score(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Posterior probability of each language, one row per text; the prior is even. ``matrix`` has a row per language.

    n-grams of one place depend on each other, so log-likelihoods are divided
    by the number of orders before they are normalised.
    """
    total = np.zeros((len(texts), len(LANGUAGES)))
    for start, stop in _chunks(texts):
        part = total[start:stop]
        for buckets, first, last in features(texts[start:stop]):
            has = first < last
            edges = np.stack([first, last], axis=1)[has].reshape(-1)
            for j in range(len(LANGUAGES)):
                part[has, j] += np.add.reduceat(np.append(matrix[j][buckets], np.float32(0)), edges)[::2]
    total /= len(ORDERS)
    total -= total.max(axis=1, keepdims=True)
    odds = np.exp(total)
    return odds / odds.sum(axis=1, keepdims=True)


def _matrix(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.5
    return np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))


#: About so many labelled documents of each language train the model; where there are more, a sample by hash.
PER_LANGUAGE = 4_000


def train(texts: DataFrame, rounds: int = 2, per_language: int = PER_LANGUAGE) -> np.ndarray:
    """The log-probability matrix, a row per language of ``LANGUAGES``, from the rows of :func:`readable`.

    A bounded sample of the labelled documents counts: about ``per_language`` of
    each language, taken by a hash of their segments, all where there are fewer.
    Each batch is summed up before anything is shuffled; what reaches the
    driver is one fixed-size matrix.
    """
    spark = texts.sparkSession
    known_label = texts.filter(F.col("named").isin(*LANGUAGES)).select("named", "segments")
    counts = {r["named"]: r["n"] for r in known_label.groupBy("named").agg(F.count("*").alias("n")).collect()}
    part = F.lit(False)
    for code, n in sorted(counts.items()):
        share = F.pmod(F.xxhash64("segments"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, per_language / n))
        part = part | ((F.col("named") == code) & share)
    sample = materialise(known_label.filter(part), "sample")
    matrix = None
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(matrix)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(LANGUAGES), BUCKETS))
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    held = [(s, LANGUAGES.index(code)) for code, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in found if has_say(s)]
                    if not held:
                        continue
                    lines, own = [s for s, _ in held], np.array([c for _, c in held])
                    if known.value is not None:
                        right = score(lines, known.value).argmax(axis=1) == own
                        lines, own = [t for t, r in zip(lines, right, strict=True) if r], own[right]
                    for start, stop in _chunks(lines):
                        for buckets, first, last in features(lines[start:stop]):
                            size = np.maximum(0, last - first)
                            place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                            cells = np.repeat(own[start:stop], size) * BUCKETS + buckets[place]
                            sums += np.bincount(cells, minlength=sums.size).reshape(sums.shape)
            at = np.flatnonzero(sums.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.reshape(-1)[at])], ["cell", "n"])

        cells = sample.mapInArrow(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        summed = np.zeros(len(LANGUAGES) * BUCKETS)
        summed[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
        matrix = _matrix(summed.reshape(len(LANGUAGES), BUCKETS))
    return matrix


SURE = 0.98

_FOUND = (
    "label string, named string, langs array<string>, main string, confidence double, "
    "segments array<struct<ord:int,segment:string,lang:string,confidence:double>>"
)


def identify(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", matrix: np.ndarray | None = None) -> DataFrame:
    """(doc_id, label, named, langs, main, confidence, segments) of every document with words.

    ``named`` is the language that the label names, null if it names none;
    ``langs`` are the languages of its whole sentences, the most frequent first;
    ``main`` is the first and ``confidence`` its mean posterior; ``segments`` is
    an array of (ord, segment, lang, confidence), ord numbering the segments.
    Sentences that the model isn't sure of (``SURE``) have a language but don't
    make a text mixed; nor do segments of under four words, unless there are no
    others. Null, blank and wordless texts give no row; a text whose sentences
    are all too short is judged by all its words. Other columns don't
    matter, whatever their names.
    """
    held = readable(documents, key, text, label)
    shared = held.sparkSession.sparkContext.broadcast(train(held) if matrix is None else matrix)
    schema = StructType([StructField(key, documents.schema[key].dataType), *StructType.fromDDL(_FOUND).fields])
    inner = pa.list_(pa.struct([("ord", pa.int32()), ("segment", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = batch.column(3).to_pylist()
                texts = [s for one in found for s in one]
                if not texts:
                    continue
                odds = score(texts, shared.value)
                best, sure = odds.argmax(axis=1), odds.max(axis=1)
                says = np.fromiter(map(has_say, texts), bool, len(texts))
                langs, main, confidence, parts, start = [], [], [], [], 0
                for n in map(len, found):
                    heard = says[start : start + n]
                    heard = heard if heard.any() else np.ones(n, bool)
                    names, trust = best[start : start + n], sure[start : start + n]
                    weight = np.bincount(names[heard], np.where(trust[heard] >= SURE, 1.0, 0.001), minlength=len(LANGUAGES))
                    order = [j for j in np.argsort(-weight, kind="stable") if weight[j] >= 1]
                    first = order[0] if order else int(np.argmax(weight))
                    langs.append([LANGUAGES[j] for j in (order or [first])])
                    main.append(LANGUAGES[first])
                    confidence.append(float(odds[start : start + n, first][heard].mean()))
                    parts.append([{"ord": k, "segment": texts[start + k], "lang": LANGUAGES[names[k]], "confidence": float(trust[k])} for k in range(n)])
                    start += n
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(langs, pa.list_(pa.string())), pa.array(main), pa.array(confidence), pa.array(parts, inner)],
                    [key, "label", "named", "langs", "main", "confidence", "segments"],
                )

    return held.mapInArrow(run, schema)


def mislabelled(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, lang): the languages of documents whose label is missing or wrong, or whose text mixes languages.

    A label in another notation isn't wrong; one that names no language is
    missing. See :func:`identify` for the texts that don't count.
    """
    found = identify(documents, key, text, label).drop("segments")
    bad = F.col("named").isNull() | (F.col("named") != F.col("main")) | (F.size("langs") > 1)
    return found.filter(bad).select(key, F.explode("langs").alias("lang")).distinct()
