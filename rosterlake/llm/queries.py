"""Named queries over the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import incremental, langid, leaks, names, neardup, pii, tokens, truncation
from rosterlake.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, place, kind) of places that hold personal information."""
    return pii.found_spans(table(spark, d, "candidates")).select("id", "place", "kind").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, headline, source) with typed placeholders for personal information."""
    candidates = table(spark, d, "candidates")
    return pii.redacted(candidates, pii.found_spans(candidates))


_CUT_COLUMNS = ["headline", "rationale"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, field_name) of candidates with a value that lost its end."""
    cut = truncation.cut_values(table(spark, d, "candidates"), "id", _CUT_COLUMNS)
    return cut.filter("is_cut").select("id", "field_name").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """(feed, field_name, n_values, n_cut, share): how often each feed's values are cut."""
    candidates = table(spark, d, "candidates")
    cut = truncation.cut_values(candidates, "id", _CUT_COLUMNS).groupBy("id", "field_name").agg(F.max("is_cut").alias("is_cut"))
    feeds = candidates.select("id", "feed").distinct()
    return cut.join(feeds, "id").groupBy("feed", "field_name").agg(
        F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"), F.round(F.count_if("is_cut") / F.count("*"), 6).alias("share")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, record_no) of pending records that repeat an older record."""
    return incremental.refused(table(spark, d, "candidates"), table(spark, d, "import_requests"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(name_a, name_b): different values of candidates.name for one person or agency."""
    return names.variants(table(spark, d, "candidates"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """(name, group_name, n_links): spellings that belong together."""
    return names.groups(table(spark, d, "candidates"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """(id, group_id, n_links): groups of candidates that share most of their records' text."""
    return neardup.similar_groups(table(spark, d, "candidates"), "id", "source")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b) of candidates whose records repeat each other."""
    return neardup.similar_pairs(table(spark, d, "candidates"), "id", "source")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids): every document by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) of documents and the evaluation items that leaked into them."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang) of documents without a right label or in several languages."""
    return langid.mislabelled(table(spark, d, "documents"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, confidence): the main language of every document with words."""
    return langid.identify(table(spark, d, "documents")).select("doc_id", F.col("main").alias("lang"), F.round("confidence", 6).alias("confidence"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, lang, confidence, n_chars) of every segment."""
    found = langid.identify(table(spark, d, "documents")).select("doc_id", F.explode("segments").alias("s"))
    return found.select("doc_id", "s.ord", "s.lang", F.round("s.confidence", 6).alias("confidence"), F.length("s.segment").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    p2_found, p2_redacted, p3_found, p3_rates, p5_found, p6_found, p6_groups, p7_found, p7_groups, p8_ids, p9_found, p10_found, p10_documents, p10_segments,
)}

# Brute force over all pairs, for small tables: words as often as they occur, words in common over words in either.
_BAGS = r"""words AS (SELECT r, unnest(regexp_extract_all(lower(t.value->>'$'), '[\p{L}\p{N}]+')) AS w FROM records, json_tree(records.source) AS t WHERE t.type = 'VARCHAR'),
bags AS (SELECT r, w, count(*) AS n FROM words GROUP BY ALL),
sizes AS (SELECT r, sum(n) AS s FROM bags GROUP BY r HAVING sum(n) >= 25),
large AS (SELECT r, w, n, s FROM bags JOIN sizes USING (r))"""
_PAIRS = "SELECT a.r AS ra, b.r AS rb, sum(least(a.n, b.n)) AS shared, any_value(a.s + b.s) AS total FROM large a JOIN {} b ON a.w = b.w AND a.r < b.r AND least(a.s, b.s) >= 0.7 * greatest(a.s, b.s) GROUP BY a.r, b.r"

SQL = {
    "p5_found": rf"""WITH bodies AS (SELECT request_id, min(received_at) AS arrived, arg_min(candidates, received_at) AS body FROM import_requests WHERE status = 'pending' AND candidates IS NOT NULL GROUP BY request_id),
arrays AS (SELECT request_id, arrived, CASE WHEN json_type(body) = 'ARRAY' THEN CAST(body AS JSON) ELSE CAST(body AS JSON)->'$.candidates' END AS j FROM bodies WHERE json_valid(body)),
pending AS (SELECT request_id, arrived, CAST(e.key AS INTEGER) AS record_no, e.value AS source FROM arrays, json_each(arrays.j) AS e WHERE json_type(arrays.j) = 'ARRAY' AND e.type = 'OBJECT'),
stored AS (SELECT DISTINCT source FROM candidates WHERE id IS NOT NULL AND json_valid(source) AND json_type(source) = 'OBJECT'),
records AS (SELECT row_number() OVER (ORDER BY request_id IS NOT NULL, arrived, record_no, request_id) AS r, * FROM
  (SELECT CAST(source AS JSON) AS source, NULL::BIGINT AS request_id, NULL::TIMESTAMP AS arrived, NULL::INTEGER AS record_no FROM stored UNION ALL SELECT source, request_id, arrived, record_no FROM pending)),
{_BAGS}, asked AS (SELECT large.* FROM large JOIN records USING (r) WHERE request_id IS NOT NULL), pairs AS ({_PAIRS.format("asked")})
SELECT DISTINCT request_id, record_no FROM pairs JOIN records ON r = rb WHERE shared >= 0.7 * (total - shared)""",
    "p7_found": rf"""WITH good AS (SELECT DISTINCT id, source FROM candidates WHERE id IS NOT NULL AND json_valid(source) AND json_type(source) = 'OBJECT'),
records AS (SELECT row_number() OVER () AS r, id, source FROM good), {_BAGS}, pairs AS ({_PAIRS.format("large")})
SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM pairs JOIN records x ON x.r = ra JOIN records y ON y.r = rb WHERE x.id <> y.id AND shared >= 0.7 * (total - shared)""",
}
