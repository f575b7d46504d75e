"""Deeply nested records to related flat tables.

A merged schema is inferred over all records in one distributed pass, keeping
every alternative kind seen at a place (object, array, scalar); nothing but it
reaches the driver. It says which tables there are, one per place that holds
objects, and leads the explosion: level by level, the objects of one level are
opened only at the fields under which the schema has objects, and each element
of an array there becomes a row of the child table, with a surrogate key of its
own, that of its parent row and its ordinal. All levels are exploded in one
Arrow pass over each record: generated Catalyst expressions overflow the
planner's stack on records nested fifty deep, and a pass per level would parse
each record as often as it has levels.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rosterlake.session import materialise

ITEM = "[]"


@dataclass
class Shape:
    """What was seen at one place of the records, merged over all of them."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Shape] = field(default_factory=dict)
    item: Shape | None = None

    def has_object(self) -> bool:
        below = list(self.fields.values()) + ([self.item] if self.item else [])
        return "object" in self.kinds or any(x.has_object() for x in below)

    def places(self) -> tuple:
        """What the explosion needs of the schema: (fields that hold objects at any depth, each with its own places, places of the items)."""
        below = tuple((k, s.places()) for k, s in sorted(self.fields.items()) if s.has_object())
        return below, self.item.places() if self.item and self.item.has_object() else None

    def item_scalars(self) -> bool:
        """Whether arrays here hold scalars, at any depth of arrays."""
        return self.item is not None and (bool(self.item.kinds - {"object", "array"}) or self.item.item_scalars())


def kind_of(value) -> str:
    """The JSON type of a parsed value."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, str):
        return "string"
    return "null" if value is None else "number"


def alternative(value) -> str:
    """The JSON type of a parsed value, with numbers told apart by what holds them exactly."""
    kind = kind_of(value)
    if kind != "number":
        return kind
    if isinstance(value, float):
        return "double"
    return "integer" if abs(value) <= 1 << 53 else "long" if -(1 << 63) <= value < 1 << 63 else "decimal" if abs(value) < 10**38 else "double"


def _shapes(value, path: tuple, seen: set) -> None:
    stack = [(value, path)]
    while stack:
        x, at = stack.pop()
        seen.add((at, alternative(x)))
        if isinstance(x, dict):
            stack.extend((y, (*at, k)) for k, y in x.items())
        elif isinstance(x, list):
            stack.extend((y, (*at, 0)) for y in x)


def infer_shape(df: DataFrame, source: str, most_places: int = 20_000) -> Shape:
    """The merged schema of a JSON text column.

    Texts that aren't JSON, or whose top isn't an object, count for nothing.
    ``most_places`` guards the driver: a column whose keys are data would give
    a place per row, and is refused with an error.
    """

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            for text in batch["s"]:
                try:
                    record = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    continue
                if isinstance(record, dict):
                    _shapes(record, (), seen)
        rows = [(json.dumps(at), kind) for at, kind in seen]
        yield pd.DataFrame(rows, columns=["place", "kind"])

    found = df.select(F.col(source).alias("s")).mapInPandas(places, "place string, kind string").distinct()
    rows = found.limit(most_places + 1).collect()
    if len(rows) > most_places:
        raise ValueError(f"more than {most_places} places: the keys of {source} look like data")
    root = Shape()
    for row in rows:
        node = root
        for step in json.loads(row["place"]):
            if step == 0:
                node.item = node.item or Shape()
                node = node.item
            else:
                node = node.fields.setdefault(step, Shape())
        node.kinds.add(row["kind"])
    return root


_NODE = "node_path string, parent_path string, kind string, ordinal int"


def _levels(record: dict, places: tuple, keep: bool) -> Iterator[tuple]:
    """The rows of a record, level by level: below an object, only fields under which the merged schema has objects are opened."""
    level = [(record, places, "", None, "", None)]
    top = True
    while level:
        below = []
        for value, (fields, _), path, parent, kind, ordinal in level:
            if not top:
                yield path, parent, kind, ordinal, _own(value) if keep else None
            elif keep:
                yield "", None, "", None, _own(value)
            for k, place in fields:
                v = value.get(k)
                if isinstance(v, dict):
                    below.append((v, place, path and f"{path}.{k}" or k, path, kind and f"{kind}.{k}" or k, None))
                elif isinstance(v, list):
                    arrays = [(v, place, path and f"{path}.{k}" or k, kind and f"{kind}.{k}" or k)]
                    for array, outer, at, of in arrays:
                        inner, of = outer[1], of + ITEM
                        if inner is None:
                            continue
                        for i, x in enumerate(array):
                            if isinstance(x, dict):
                                below.append((x, inner, f"{at}[{i}]", path, of, i))
                            elif isinstance(x, list):
                                arrays.append((x, inner, f"{at}[{i}]", of))
        level, top = below, False


def _own(value: dict) -> str:
    """The object's own scalars and arrays as JSON text; objects inside arrays, which are rows themselves, leave a null in their place."""
    own = {}
    for k, v in value.items():
        if not _holds_object(v):
            own[k] = v
        elif isinstance(v, list):
            rest, scalars = _without_objects(v)
            if scalars:
                own[k] = rest
    try:
        return json.dumps(own, ensure_ascii=False, allow_nan=False)
    except ValueError:  # NaN and infinities are no JSON
        return json.dumps({k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in own.items()}, ensure_ascii=False)


def _without_objects(items: list) -> tuple[list, bool]:
    """(the array with null for each object, whether it holds scalars), without recursion."""
    top: list = []
    stack, scalars = [(items, top)], False
    while stack:
        old, new = stack.pop()
        for x in old:
            if isinstance(x, list):
                new.append([])
                stack.append((x, new[-1]))
            else:
                new.append(None if isinstance(x, dict) else x)
                scalars = scalars or not isinstance(x, dict)
    return top, scalars


def _holds_object(value) -> bool:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            return True
        if isinstance(x, list):
            stack.extend(x)
    return False


def nodes(df: DataFrame, key: str, source: str, keep: bool = False, shape: Shape | None = None) -> DataFrame:
    """One row per object below the top of each record: the rows of all child tables.

    Columns: the key, ``node_path``, ``parent_path`` ('' for the record), the
    ``kind`` (the path with ``[]`` for places, which names the child table), the
    ``ordinal`` in the nearest array (null outside arrays), the surrogate keys
    ``row_key`` and ``parent_key`` and, with ``keep``, the object's scalar
    fields as JSON text in ``node``; then the record itself has a row too, with
    the path and kind '' and no parent. ``shape`` is the merged schema, inferred
    here if not given.

    A source that is null, isn't JSON, or isn't an object gives no rows; where
    a key is repeated the last value holds; a null key stays null; repeated
    rows give repeated nodes with the same keys; other columns of ``df`` are
    left out, whatever their names.
    """
    places = df.sparkSession.sparkContext.broadcast((shape or infer_shape(df, source)).places())
    of_key = df.schema[key].dataType
    own = StructField("node", StringType())
    schema = StructType([StructField(key, of_key), *StructType.fromDDL(_NODE).fields, own, StructField("__record", LongType())])
    arrow = to_arrow_schema(schema)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            took: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    record = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    continue
                if isinstance(record, dict):
                    before = len(rows)
                    rows.extend(_levels(record, known, keep))
                    took.extend([i] * (len(rows) - before))
                if len(rows) > 50_000:
                    yield _batch(batch, took, rows, arrow)
                    took, rows = [], []
            if rows:
                yield _batch(batch, took, rows, arrow)

    rows = df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.xxhash64(key, source).alias("r")).mapInArrow(explode, schema)
    parent = F.when(F.col("parent_path").isNotNull(), F.xxhash64("__record", "parent_path"))
    return rows.select(key, "node_path", "parent_path", "kind", "ordinal", F.xxhash64("__record", "node_path").alias("row_key"), parent.alias("parent_key"), *(["node"] if keep else []))


def _batch(batch: pa.RecordBatch, took: list[int], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    at = pa.array(took, pa.int32())
    columns = zip(zip(*rows, strict=True), list(schema)[1:-1], strict=True)
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, f.type) for c, f in columns), batch.column(2).take(at)], schema=schema)


def _branches(kinds: set[str]) -> list[tuple[str, str]]:
    """(label, SQL type) of the columns that hold a field's scalars, one per JSON type; numbers in the narrowest type that keeps all of them exactly."""
    out = [(k, k) for k in ("boolean", "string") if k in kinds]
    wide, whole = kinds & {"long", "decimal"}, "decimal(38,0)" if "decimal" in kinds else "bigint"
    if "double" in kinds:
        out.append(("number", "double"))
        if wide:  # doubles would round these
            out.append(("integer", whole))
    elif wide or "integer" in kinds:
        out.append(("number", whole))
    return sorted(out)


def child_tables(df: DataFrame, key: str, source: str) -> dict[str, DataFrame]:
    """One flat table per kind of object, named by its path with ``[]`` for places.

    Each has the key, ``node_path``, ``parent_path``, ``ordinal`` and the
    surrogate keys ``row_key`` and ``parent_key``, then one column per scalar
    field of that kind, sorted by name. A field whose kinds conflict gets one
    column per kind, ``name__kind``; whole numbers are bigint, or decimal where
    that is too narrow, and other numbers double (``name__integer`` beside
    ``name__number`` where a double would round some). Arrays that hold scalars
    stay as JSON text in ``name__array``, with null for each object among them.
    The record itself is the kind '', if it has such columns. Field columns
    begin with ``f_``, so they can't clash with the keys. NaN and infinities,
    which aren't JSON, are null.

    The rows of all tables are exploded and written once, sorted by table, so
    that reading one skips the others.
    """
    shape = infer_shape(df, source)
    found: dict[str, dict[str, Shape]] = {}

    def gather(node: Shape, kind: str) -> None:
        if "object" in node.kinds:
            found[kind] = node.fields
        for k, s in node.fields.items():
            gather(s, f"{kind}.{k}" if kind else k)
        if node.item:
            gather(node.item, kind + ITEM)

    gather(shape, "")
    if not found:
        return {}
    every = materialise(nodes(df, key, source, keep=True, shape=shape).sortWithinPartitions("kind"), "nodes")
    tables = {}
    for kind, fields in sorted(found.items()):
        columns = []
        for name, s in sorted(fields.items()):
            value = F.element_at("fields", F.lit(name))
            branches = _branches(s.kinds)
            for label, sql in branches:
                columns.append(typed(value, label, sql).alias(f"f_{name}" if len(branches) == 1 else f"f_{name}__{label}"))
            if "array" in s.kinds and (s.item_scalars() or not s.has_object()):
                columns.append(F.to_json(F.try_variant_get(value, "$", "array<variant>")).alias(f"f_{name}__array"))
        if kind == "" and not columns:
            continue
        rows = every.filter(F.col("kind") == kind).withColumn("fields", F.try_variant_get(F.try_parse_json("node"), "$", "map<string,variant>"))
        tables[kind] = rows.select(key, "node_path", "parent_path", "ordinal", "row_key", "parent_key", *columns)
    return tables


_OF_LABEL = {"string": "^STRING", "boolean": "^BOOLEAN", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)", "integer": r"^(BIGINT|INT|DECIMAL\(\d+,0\))"}


def typed(value: Column, label: str, sql: str) -> Column:
    """A variant as the given type, null if it is of another JSON type."""
    of = F.schema_of_variant(value)
    right = of.rlike(_OF_LABEL[label])
    if label == "integer":  # numbers that a double holds are in the other column
        return F.when(right & (F.abs(F.try_variant_get(value, "$", "decimal(38,0)")) > 1 << 53), F.try_variant_get(value, "$", sql))
    return F.when(right, F.try_variant_get(value, "$", sql))
