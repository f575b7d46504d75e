"""Reading, importing and writing the pool of candidates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlake.functions import credentials as secret
from rosterlake.functions import scrub, text
from rosterlake.operators.retrieve import sync_plan
from rosterlake.session import materialise

#: Keys that a name or a headline stands under, in the order in which they are tried, and the stand-in for a name.
NAME_KEYS = ("name", "full_name", "fullName", "candidate_name", "displayName", "username")
HEADLINE_KEYS = ("headline", "title", "current_role", "currentRole", "position", "summary")
NOBODY = "Unknown candidate"
#: The fewest and most records of one import.
BATCH = (1, 2_000)

CANDIDATES = "id string, name string, headline string, source string, imported_at bigint, score double, recommendation string, rationale string, analyzed_at bigint"


def read_pool(spark: SparkSession, where: str, form: str = "parquet", **options: str) -> DataFrame:
    """The pool from files of any form Spark reads, or from a database (``form="jdbc"``, ``where`` its URL)."""
    reader = spark.read.format(form).options(**options)
    return reader.option("url", where).load() if form == "jdbc" else reader.load(where)


def create_table(spark: SparkSession, name: str) -> None:
    """The table of candidates, if it isn't there; other tables are left alone."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CANDIDATES}) USING parquet")


def exists(spark: SparkSession, where: str) -> bool:
    """Whether there is anything at a path, on whatever file system it names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write_pool(pool: DataFrame, where: str, mode: str = "append") -> None:
    """Append to, or replace, a pool of parquet files."""
    pool.write.mode(mode).parquet(where)


def read_envelopes(spark: SparkSession, where: str) -> DataFrame:
    """(file_name, body) of JSON files, each a bare array or an object with key candidates."""
    files = spark.read.text(where, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("body"))


def unpack(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, record_no, record) of every record in an import body, a bare array or an object with key candidates.

    Bodies that are null or aren't JSON, and elements that are no objects, give
    nothing. Records keep their numbers as they are written.
    """
    schema = StructType([bodies.schema[key], *StructType.fromDDL("record_no int, record string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, out = [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    got = json.loads(raw)
                except (TypeError, ValueError, RecursionError):
                    continue
                got = got.get("candidates") if isinstance(got, dict) else got
                for n, record in enumerate(got if isinstance(got, list) else []):
                    if isinstance(record, dict):
                        at.append(i)
                        no.append(n)
                        out.append(json.dumps(record, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(no, pa.int32()), pa.array(out, pa.string())], [key, "record_no", "record"])

    return bodies.select(key, body).mapInArrow(run, schema)


def checked(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, n_records, reason): why an import is refused, null if it is good."""
    counts = unpack(bodies, key, body).groupBy(key).agg(F.count("*").alias("n_records"))
    n = F.coalesce("n_records", F.lit(0))
    reason = F.when(n < BATCH[0], "empty").when(n > BATCH[1], "too many records")
    return bodies.select(key).distinct().join(counts, key, "left").select(key, n.alias("n_records"), reason.alias("reason"))


def first_text(record: dict, keys: tuple[str, ...]) -> str:
    """The first value that is a string and not blank, stripped."""
    return next((v.strip() for k in keys if isinstance(v := record.get(k), str) and v.strip()), "")


_SECRETS = None


def _redact(value: str) -> str:
    """Credentials replaced, in plain Python: the same patterns as the column expression."""
    import re

    global _SECRETS
    if _SECRETS is None:
        _SECRETS = [(re.compile(p.replace("(?U)", "").replace("(?iU)", "(?i)")), t.replace("$1", r"\1")) for p, t in secret.PATTERNS]
    for pattern, token in _SECRETS:
        value = pattern.sub(token, value)
    return value


def candidate(record: dict, guard_credentials: bool = True) -> tuple[str, str, str, bool]:
    """(name, headline, source, held identifiers) of a record, as it is stored.

    Name and headline are scrubbed before they are cut to length. The record is
    scrubbed value by value, credentials first unless ``guard_credentials`` is off.
    """
    tidy: Callable[[str], str] = _redact if guard_credentials else lambda x: x
    clean = scrub.sanitise(record, tidy)
    name = scrub.scrub(tidy(first_text(record, NAME_KEYS) or NOBODY))[: text.CAPS["name"]]
    headline = scrub.scrub(tidy(first_text(record, HEADLINE_KEYS)))[: text.CAPS["headline"]]
    return name, headline, json.dumps(clean, ensure_ascii=False), clean != record or bool(scrub.detect(json.dumps(record, ensure_ascii=False)))


def ingest(records: DataFrame, keys: list[str], record: str, imported_at: int, guard_credentials: bool = True) -> DataFrame:
    """Records as rows of the pool, with their keys and ``held_pii``.

    The id is derived from the keys, so importing a file again gives the same
    rows. Texts that give no row are those of :func:`rejected`.
    """
    schema = StructType([*[records.schema[k] for k in keys], *StructType.fromDDL("id string, name string, headline string, source string, held_pii boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            own = [batch.column(i).to_pylist() for i in range(len(keys))]
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    got = json.loads(raw)
                except (TypeError, ValueError, RecursionError):
                    continue
                if isinstance(got, dict):
                    try:
                        row = candidate(got, guard_credentials)
                    except RecursionError:  # nested deeper than Python can walk
                        continue
                    h = hashlib.blake2b(repr([c[i] for c in own]).encode(), digest_size=16).hexdigest()
                    at.append(i)
                    out.append((f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", *row))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            take = pa.array(at, pa.int32())
            arrays = [batch.column(i).take(take) for i in range(len(keys))] + [pa.array(c, pa.bool_() if j == 4 else pa.string()) for j, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "id", "name", "headline", "source", "held_pii"])

    rows = records.select(*keys, record).mapInArrow(run, schema)
    empty = {"score": "double", "recommendation": "string", "rationale": "string", "analyzed_at": "bigint"}
    return rows.withColumn("imported_at", F.lit(imported_at).cast("bigint")).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})


def rejected(records: DataFrame, keys: list[str], record: str) -> DataFrame:
    """(keys, reason) of the records that :func:`ingest` leaves out: null, not JSON, no object, or nested too deep for a JSON reader."""
    schema = StructType([*[records.schema[k] for k in keys], *StructType.fromDDL("reason string").fields])

    def why(raw: str | None) -> str | None:
        try:
            got = json.loads(raw)
            json.dumps(got)
        except RecursionError:
            return "too deep"
        except (TypeError, ValueError):
            return "null" if raw is None else "not JSON"
        return None if isinstance(got, dict) else "no object"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [why(raw) for raw in batch.column(len(keys)).to_pylist()]
            at = pa.array([i for i, r in enumerate(reasons) if r], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), pa.array([r for r in reasons if r], pa.string())], [*keys, "reason"])

    return records.select(*keys, record).mapInArrow(run, schema)


def imported(pool: DataFrame, bodies: DataFrame, key: str, body: str, imported_at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One import of any number of files: (rows to append, totals, sync plan of an index that holds the pool).

    totals is one row: the records imported, those that held identifiers or
    credentials, and the size of the pool afterwards. The rows are written out
    once, so that appending, counting and syncing don't scrub them again.
    """
    rows = materialise(ingest(unpack(bodies, key, body), [key, "record_no"], "record", imported_at), "imported")
    after = pool.select("id").union(rows.select("id"))
    total = after.agg(F.count_distinct("id")).first()[0]
    totals = rows.agg(F.count("*").alias("imported"), F.count_if("held_pii").alias("redacted"), F.lit(total).alias("total"))
    return rows, totals, sync_plan(after, pool)


def delete(pool: DataFrame, gone: DataFrame) -> DataFrame:
    """The pool without the given ids."""
    return pool.join(gone.select("id").distinct(), "id", "left_anti")


def export(pool: DataFrame) -> DataFrame:
    """(record): every source, ready to be imported again; sources that aren't JSON are left out."""
    return pool.filter(F.try_parse_json("source").isNotNull()).select("id", F.col("source").alias("record"))


def seed(pool: DataFrame, records: list[dict], imported_at: int) -> DataFrame:
    """Fixed records as rows of an empty pool; a pool that holds rows is refused."""
    if not pool.isEmpty():
        raise ValueError("the pool isn't empty")
    spark = pool.sparkSession
    rows = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)], "record_no int, record string")
    return ingest(rows, ["record_no"], "record", imported_at)


def storage(where: str, environment: str) -> tuple[str, bool]:
    """(kind of storage, whether its rows may be lost): a folder of one machine is no place for production."""
    kind = where.split(":", 2)[1] if where.startswith("jdbc:") else where.split("://", 1)[0] if "://" in where else "file"
    return kind, kind in ("file", "sqlite") and environment == "production"


def ready(spark: SparkSession) -> bool:
    """Whether the session answers."""
    return spark.sql("SELECT 1 AS one").first().one == 1
