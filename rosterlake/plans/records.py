"""Queries over nested and drifting records (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import drift, nested
from rosterlake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, node_path, parent_path) of every object below the top of a record."""
    found = nested.nodes(table(spark, d, "candidates"), "id", "source")
    return found.select("id", "node_path", "parent_path").distinct()


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each child table: (kind, n_rows, n_candidates, n_parents)."""
    found = nested.nodes(table(spark, d, "candidates"), "id", "source")
    one = found.groupBy("kind", "id", "node_path", "parent_path").agg(F.lit(1).alias("n"))
    per = one.groupBy("kind", "id", "parent_path").agg(F.count("*").alias("n"))
    per = per.groupBy("kind", "id").agg(F.sum("n").alias("n"), F.count("*").alias("parents"))
    return per.groupBy("kind").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_candidates"), F.sum("parents").alias("n_parents"))


def p1_projects(spark: SparkSession, d: str) -> DataFrame:
    """The child table of projects in arrays, joined to the table of experience by the parent's surrogate key."""
    tables = nested.child_tables(table(spark, d, "candidates"), "id", "source")
    projects, experience = tables["experience[].projects[]"], tables["experience[]"]
    title = next(c for c in projects.columns if c in ("f_title", "f_title__string"))
    parents = experience.select(F.col("row_key").alias("parent_key"), F.col("ordinal").alias("parent_ordinal")).distinct()
    return projects.join(parents, "parent_key").select("id", "node_path", "parent_path", "ordinal", "parent_ordinal", F.col(title).alias("title")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(feed, request_id, change, field_name, new_name)."""
    requests = table(spark, d, "import_requests")
    return drift.changes(drift.records(table(spark, d, "candidates"), requests), requests)


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """(feed, request_id, change, field_name): fields that are added, removed or change type, before renames are told."""
    requests = table(spark, d, "import_requests")
    found = drift.changes(drift.records(table(spark, d, "candidates"), requests), requests, renames=False)
    return found.select("feed", "request_id", "change", "field_name")


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    """All records of all files as one table of consistent columns."""
    requests = table(spark, d, "import_requests")
    return drift.consistent_table(drift.records(table(spark, d, "candidates"), requests), requests)


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p1_projects, p4_found, p4_fields, p4_consistent)}
_NODES = r"""nodes AS (
  SELECT DISTINCT c.id, substr(n.fullkey, 3) AS node_path, regexp_replace(substr(n.fullkey, 3), '(^|\.)[^.\[\]]+(\[\d+\])*$', '') AS parent_path
  FROM (SELECT id, source FROM candidates WHERE json_valid(source) AND json_type(source) = 'OBJECT') c, json_tree(c.source) AS n WHERE n.type = 'OBJECT' AND n.fullkey <> '$'),
kinds AS (SELECT *, regexp_replace(node_path, '\[\d+\]', '[]', 'g') AS kind FROM nodes)"""

SQL = {
    "p1_found": f"WITH {_NODES} SELECT id, node_path, parent_path FROM nodes",
    "p1_projects": r"""WITH found AS (SELECT c.id, substr(n.fullkey, 3) AS node_path, n.value AS v
  FROM (SELECT id, source FROM candidates WHERE json_valid(source) AND json_type(source) = 'OBJECT') c, json_tree(c.source) AS n WHERE n.type = 'OBJECT' AND n.fullkey <> '$')
SELECT DISTINCT id, node_path, regexp_extract(node_path, '^(experience\[\d+\])', 1) AS parent_path, CAST(regexp_extract(node_path, '\[(\d+)\]$', 1) AS INTEGER) AS ordinal,
CAST(regexp_extract(node_path, '^experience\[(\d+)\]', 1) AS INTEGER) AS parent_ordinal, CASE WHEN json_type(v, '$.title') = 'VARCHAR' THEN v->>'$.title' END AS title
FROM found WHERE regexp_full_match(node_path, 'experience\[\d+\]\.projects\[\d+\]')""",
    "p4_fields": """WITH files AS (SELECT request_id, min(feed) AS feed, min(exported_at) AS written FROM import_requests GROUP BY request_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY written, request_id) AS place, lead(request_id) OVER (PARTITION BY feed ORDER BY written, request_id) AS next FROM files),
bodies AS (SELECT request_id, TRY_CAST(candidates AS JSON) AS j FROM import_requests WHERE candidates IS NOT NULL GROUP BY ALL),
arrays AS (SELECT request_id, CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE j->'$.candidates' END AS j FROM bodies),
pending AS (SELECT request_id, CAST(e.key AS BIGINT) AS record_no, e.value AS r FROM arrays, json_each(arrays.j) AS e WHERE json_type(arrays.j) = 'ARRAY'),
every AS (SELECT DISTINCT ON (request_id, record_no) request_id, record_no, r FROM
  (SELECT request_id, record_no, TRY_CAST(source AS JSON) AS r FROM candidates UNION ALL SELECT request_id, record_no, r FROM pending) WHERE json_type(r) = 'OBJECT'),
one AS (SELECT request_id, record_no, f.key AS field_name,
  CASE f.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
  row_number() OVER (PARTITION BY request_id, record_no, f.key ORDER BY f.id DESC) AS n FROM every, json_each(every.r) AS f WHERE f.type <> 'NULL'),
kinds AS (SELECT request_id, field_name, kind, count(*) AS n, min(record_no) AS first FROM one WHERE n = 1 GROUP BY ALL),
fused AS (SELECT request_id, field_name, arg_max(kind, n * 1000000 - first) AS kind FROM kinds GROUP BY ALL),
held AS (SELECT feed, place, next, request_id, field_name, kind, lag(kind) OVER (PARTITION BY feed, field_name ORDER BY place) AS before FROM fused JOIN placed USING (request_id))
SELECT feed, arg_min(request_id, place) AS request_id, 'added' AS change, field_name FROM held GROUP BY feed, field_name HAVING min(place) > 1
UNION ALL SELECT feed, arg_max(next, place), 'removed', field_name FROM (SELECT *, max(place) OVER (PARTITION BY feed, field_name) AS last FROM held) WHERE place = last AND next IS NOT NULL GROUP BY feed, field_name
UNION ALL SELECT feed, request_id, 'type_changed', field_name FROM held WHERE before IS NOT NULL AND before <> kind""",
    "p1_kinds": f"WITH {_NODES} SELECT kind, count(*) AS n_rows, count(DISTINCT id) AS n_candidates, count(DISTINCT id || ' ' || parent_path) AS n_parents FROM kinds GROUP BY kind",
}
