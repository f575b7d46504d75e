"""Schemas that drift between the files of a feed.

Tagged-union inference: every file's top-level schema is inferred in parallel
and the schemas are fused per field, keeping each alternative type with its
count. Conflicting fields split into one typed branch per alternative beside a
canonical text, and the fused schemas, read in order of export, give the list
of changes.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.nested import kind_of
from rosterlake.session import materialise

#: Most rows of a table that is broadcast; its size is counted first.
BROADCAST_ROWS = 200_000

_RECORDS = "request_id bigint, record_no int, record string"
_SHAPE = "request_id bigint, record_no int, fields array<struct<name:string,kind:string>>"


def records(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per record of a file: (request_id, record_no, record as JSON text).

    Accepted records are rows of ``candidates``; a pending request's are in its
    body, a bare array or an object with key ``candidates``. Bodies that aren't
    JSON and elements that aren't objects give nothing. A record delivered
    twice may appear twice.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    got = json.loads(body)
                except (TypeError, ValueError, RecursionError):
                    continue
                if isinstance(got, dict):
                    got = got.get("candidates")
                if isinstance(got, list):
                    rows = [(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(got) if isinstance(x, dict)]
                    if rows:
                        no, text = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([rid] * len(no), pa.int64()), pa.array(no, pa.int32()), pa.array(text)], ["request_id", "record_no", "record"])

    bodies = requests.filter(F.col("candidates").isNotNull()).select(F.col("request_id").cast("bigint"), "candidates")
    stored = candidates.select(F.col("request_id").cast("bigint"), F.col("record_no").cast("int"), F.col("source").alias("record"))
    return stored.unionByName(bodies.mapInArrow(unpack, _RECORDS))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())]))
    for batch in batches:
        keep, out = [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            try:
                record = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                continue
            if isinstance(record, dict):
                keep.append(i)
                out.append([{"name": k, "kind": kind_of(v)} for k, v in record.items() if v is not None])
        at = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, kinds)], ["request_id", "record_no", "fields"])


def file_schemas(every: DataFrame, requests: DataFrame) -> DataFrame:
    """The fused schema of each file: one row per (feed, file, field).

    Columns: feed, request_id, exported_at, field_name, ``kind`` (the type of
    most of the file's records; of equally frequent types the one that comes
    first in the file), ``kinds`` (each type with its count) and ``n_records``.
    """
    shapes = every.mapInArrow(_shapes, _SHAPE).dropDuplicates(["request_id", "record_no"])
    one = shapes.select("request_id", "record_no", F.explode("fields").alias("f"))
    per_kind = one.groupBy("request_id", F.col("f.name").alias("field_name"), F.col("f.kind").alias("kind")).agg(
        F.count("*").alias("n"), F.min("record_no").alias("first")
    )
    fused = per_kind.groupBy("request_id", "field_name").agg(
        F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"),
        F.sum("n").alias("n_records"),
    )
    return fused.join(_files(requests).select("request_id", "feed", "exported_at"), "request_id")


def _files(requests: DataFrame) -> DataFrame:
    """One row per file with its place in the feed and the file after it."""
    one = requests.groupBy(F.col("request_id").cast("bigint").alias("request_id")).agg(
        F.min("feed").alias("feed"), F.min("exported_at").alias("exported_at")
    )
    order = Window.partitionBy("feed").orderBy("exported_at", "request_id")
    return one.select(
        "*", F.row_number().over(order).alias("place"),
        F.lead("request_id").over(order).alias("next_request"),
    )


def changes(every: DataFrame, requests: DataFrame, alike: float = 0.28, renames: bool = True) -> DataFrame:
    """Each change of a feed's schema with the file that brought it.

    (feed, request_id, change, field_name, new_name), change being ``added``,
    ``removed``, ``type_changed`` or ``renamed``. A field that ends where
    another begins is taken as renamed if their contents are at least
    ``alike`` (cosine of their value profiles); each name is used once, the
    most alike pair first. Files of a feed exported at the same instant are
    ordered by request_id; a file without readable records has no field.
    Without ``renames`` such pairs stay an added and a removed field.

    The windows run over one row per (file, field), thousands of times fewer
    than records, and stream in order, so a feed that holds a third of all
    files needs no memory of its size.
    """
    files = materialise(_files(requests), "files")
    schemas = file_schemas(every, requests).select("request_id", "field_name", "kind")
    placed = materialise(schemas.join(files, "request_id"), "placed")
    order = Window.partitionBy("feed", "field_name").orderBy("place")
    lag = placed.withColumn("before", F.lag("kind").over(order))
    retyped = lag.filter(F.col("before").isNotNull() & (F.col("before") != F.col("kind"))).select(
        "feed", "request_id", F.lit("type_changed").alias("change"), "field_name", F.lit("").alias("new_name")
    )
    span = materialise(placed.groupBy("feed", "field_name").agg(
        F.min(F.struct("place", "request_id")).alias("start"),
        F.max(F.struct("place", "request_id", "next_request")).alias("end"),
    ), "spans")
    added = span.filter("start.place > 1").select("feed", "field_name", F.col("start.request_id").alias("request_id"), F.col("start.request_id").alias("seen_in"))
    removed = span.filter("end.next_request is not null").select("feed", "field_name", F.col("end.next_request").alias("request_id"), F.col("end.request_id").alias("seen_in"))
    if not renames:
        both = ((added, "added"), (removed, "removed"))
        plain = [x.select("feed", "request_id", F.lit(what).alias("change"), "field_name", F.lit("").alias("new_name")) for x, what in both]
        return plain[0].unionByName(plain[1]).unionByName(retyped)
    renamed = materialise(_renamed(every, added, removed, alike), "renamed")
    new = added.join(renamed.select("feed", "request_id", F.col("new_name").alias("field_name")), ["feed", "request_id", "field_name"], "left_anti")
    old = removed.join(renamed.select("feed", "request_id", "field_name"), ["feed", "request_id", "field_name"], "left_anti")
    plain = [
        x.select("feed", "request_id", F.lit(what).alias("change"), "field_name", F.lit("").alias("new_name"))
        for x, what in ((new, "added"), (old, "removed"))
    ]
    return plain[0].unionByName(plain[1]).unionByName(retyped).unionByName(
        renamed.select("feed", "request_id", F.lit("renamed").alias("change"), "field_name", "new_name")
    )


_WORD = re.compile(r"[^\W\d_]+")
_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def _class(text: str) -> str:
    """The coarse class of a text: address, link, mostly digits, or prose by length."""
    if "@" in text and " " not in text.strip():
        return "address"
    if re.match(r"(https?://)?[\w.-]+\.[a-z]{2,}/", text):
        return "link"
    digits = sum(c.isdigit() for c in text)
    if digits >= 7 and digits >= 0.6 * len(text.replace(" ", "")):
        return "number"
    return f"prose{min(6, len(text).bit_length())}"


#: What all words of a string count for together at most, and what its shape does.
WORDS, SHAPE = 40.0, 2.0


def profile(value) -> Counter:
    """Features of a value's content: structure, character shape, words.

    The whole of every string counts. So that long texts don't outweigh short
    ones, all words of one share a weight of ``WORDS`` if there are more, and
    the pieces of its shape share one of ``SHAPE``.
    """
    out: Counter = Counter()
    stack = [("", value)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                out[f"k{at}.{k}"] += 3
                stack.append((f"{at}.{k}", v))
        elif isinstance(x, list):
            stack.extend((at + "[]", v) for v in x)
        elif isinstance(x, str):
            shape = _RUN.sub(r"\1", _DIGITS.sub("9", _LETTERS.sub("a", x)))
            pieces = [shape[i : i + 12] for i in range(0, len(shape), 12)] or [""]
            for piece in pieces:
                out[f"s{at}{piece}"] += SHAPE / len(pieces)
            out["c" + _class(x)] += 4
            found = _WORD.findall(x.lower())
            weight = min(1.0, WORDS / max(1, len(found)))
            for w in found:
                out["w" + w] += weight
        elif x is not None:
            out[f"{kind_of(x)}{at}{len(str(x)) if not isinstance(x, bool) else ''}"] += 2
    return out


def _renamed(every: DataFrame, added: DataFrame, removed: DataFrame, alike: float) -> DataFrame:
    """(feed, request_id, field_name, new_name) of fields that go on under another name.

    Only the two files at each such break are read again: the one that brings
    the new field and the last one with the old field.
    """
    both = added.select("feed", "request_id").distinct().join(removed.select("feed", "request_id").distinct(), ["feed", "request_id"], "left_semi")
    ends = added.withColumn("side", F.lit("new")).unionByName(removed.withColumn("side", F.lit("old"))).join(both, ["feed", "request_id"], "left_semi")
    wanted = ends.groupBy("seen_in").agg(F.collect_set("field_name").alias("names"))
    wanted = wanted.withColumnRenamed("seen_in", "request_id")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = every.join(F.broadcast(wanted) if few else wanted, "request_id")

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, Counter] = {}
            for rid, text, names in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    record = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    continue
                if isinstance(record, dict):
                    for name in names:
                        if record.get(name) is not None:
                            sums.setdefault((rid, name), Counter()).update(profile(record[name]))
            rows = [(rid, name, f, n) for (rid, name), got in sums.items() for f, n in got.items()]
            if rows:
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(c), pa.array(d, pa.float64())], ["seen_in", "field_name", "feature", "n"])

    vectors = (
        texts.select("request_id", "record", "names").mapInArrow(profiles, "seen_in bigint, field_name string, feature string, n double")
        .groupBy("seen_in", "field_name", "feature").agg(F.sum("n").alias("n"))
        .groupBy("seen_in", "field_name").agg(F.map_from_entries(F.collect_list(F.struct("feature", "n"))).alias("vector"))
    )
    ends = ends.join(vectors, ["seen_in", "field_name"])
    old = ends.filter("side = 'old'").select("feed", "request_id", "field_name", F.col("vector").alias("a"))
    new = ends.filter("side = 'new'").select("feed", "request_id", F.col("field_name").alias("new_name"), F.col("vector").alias("b"))
    pairs = old.join(new, ["feed", "request_id"]).select("feed", "request_id", "field_name", "new_name", _cosine(F.col("a"), F.col("b")).alias("cosine"))

    def match(rows) -> Column:
        """Greedy one-to-one: most alike first. A file brings few fields, so the list is short."""
        start = F.array().cast("array<struct<cosine:double,field_name:string,new_name:string>>")

        def add(done: Column, x: Column) -> Column:
            taken = F.exists(done, lambda y: (y["field_name"] == x["field_name"]) | (y["new_name"] == x["new_name"]))
            return F.when(taken, done).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(F.sort_array(rows, asc=False), start, add)

    chosen = pairs.filter(F.col("cosine") >= alike).groupBy("feed", "request_id").agg(F.collect_list(F.struct("cosine", "field_name", "new_name")).alias("rows"))
    return chosen.select("feed", "request_id", F.explode(match(F.col("rows"))).alias("m")).select("feed", "request_id", "m.field_name", "m.new_name", "m.cosine")


def _cosine(a: Column, b: Column) -> Column:
    def norm(m: Column) -> Column:
        return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))

    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    dot = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))
    return dot / (norm(a) * norm(b))


_BRANCH = {"string": "string", "number": "double", "boolean": "boolean", "array": "string", "object": "string"}


def consistent_table(every: DataFrame, requests: DataFrame, fields: list[str] | None = None, most_fields: int = 2_000) -> DataFrame:
    """All records as one table of consistent columns.

    The key columns are feed, request_id and record_no. Each top-level field
    gives ``field`` (canonical text), ``field__kind`` (the alternative that the
    record holds) and one typed branch per alternative seen anywhere,
    ``field__string``, ``field__number`` (with ``field__integer``, exact where
    it is a whole number), ``field__boolean``; arrays and objects are JSON text. An absent field is null in every column; records
    that aren't JSON objects are left out; ``most_fields`` guards the driver.
    """
    got = file_schemas(every, requests).select("field_name", F.explode(F.map_keys("kinds")).alias("kind")).distinct()
    if fields is not None:
        got = got.filter(F.col("field_name").isin(fields))
    rows = got.limit(most_fields * 5 + 1).collect()
    if len(rows) > most_fields * 5:
        raise ValueError("too many top-level fields: the keys look like data")
    kinds: dict[str, set] = {}
    for row in rows:
        kinds.setdefault(row["field_name"], set()).add(row["kind"])
    schema = "request_id bigint, record_no int, kinds map<string,string>, texts map<string,string>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.map_(pa.string(), pa.string())
        for batch in batches:
            keep, seen, texts = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                try:
                    record = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    continue
                if isinstance(record, dict):
                    keep.append(i)
                    held = [(k, v) for k, v in record.items() if v is not None and k in kinds]
                    seen.append([(k, kind_of(v)) for k, v in held])
                    texts.append([(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in held])
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(seen, pairs), pa.array(texts, pairs)], ["request_id", "record_no", "kinds", "texts"])

    flat = every.mapInArrow(split, schema).dropDuplicates(["request_id", "record_no"])
    columns = []
    for name, seen in sorted(kinds.items()):
        text, kind = F.element_at("texts", F.lit(name)), F.element_at("kinds", F.lit(name))
        columns += [text.alias(name), kind.alias(f"{name}__kind")]
        if len(seen) > 1:
            columns += [F.when(kind == k, text.try_cast(_BRANCH[k])).alias(f"{name}__{k}") for k in sorted(seen)]
            if "number" in seen:  # whole numbers that a double would round
                columns.append(F.when(kind == "number", text.try_cast("bigint")).alias(f"{name}__integer"))
    return flat.join(_files(requests).select("request_id", "feed"), "request_id").select("feed", "request_id", "record_no", *columns)
