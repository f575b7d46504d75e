"""Identifiers in the pool's records, credentials in documents, and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.functions import credentials, scrub
from rosterlake.operators import views
from rosterlake.plans.common import FLAT, NEWEST, strip
from rosterlake.session import table
from rosterlake.sources.pool import HEADLINE_KEYS, NAME_KEYS, NOBODY, first_text

#: Fixed for reproducible fingerprints of test data; production passes a key of its own.
KEY = scrub.key_from("test data")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return views.newest(table(spark, d, "candidates"), "source").select("id", F.col("source").alias("text"))


def _scrubbed(spark: SparkSession, d: str) -> DataFrame:
    return scrub.scrubbed(_texts(spark, d), "text", KEY)


def credential_redact(spark: SparkSession, d: str) -> DataFrame:
    """Documents with credentials replaced."""
    return table(spark, d, "documents").select("doc_id", credentials.redacted(F.col("text")).alias("text"))


def credential_count(spark: SparkSession, d: str) -> DataFrame:
    """Credentials in each document."""
    return table(spark, d, "documents").select("doc_id", credentials.counted(F.col("text")).alias("n"))


def pii_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Records as text with identifiers replaced, credentials first."""
    texts = _texts(spark, d).withColumn("text", credentials.redacted(F.col("text")))
    return scrub.scrubbed(texts, "text", KEY).select("id", "scrubbed", F.size("findings").alias("n_findings"))


def pii_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every identifier in the records: what it is, where, its ordinal of its kind and its fingerprint."""
    found = _scrubbed(spark, d).select("id", F.posexplode("findings").alias("ord", "f"))
    nth = F.row_number().over(Window.partitionBy("id", "f.kind").orderBy("ord")) - 1
    return found.select("id", "ord", "f.kind", "f.start", "f.stop", "f.token", "f.fingerprint", nth.alias("nth"))


def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of each kind in each record, as a map."""
    found = _scrubbed(spark, d).select("id", F.explode("findings.kind").alias("kind")).groupBy("id", "kind").agg(F.count("*").alias("n"))
    return found.groupBy("id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n"))))).alias("counts"))


def pii_summary(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of each kind in all records."""
    return _scrubbed(spark, d).select(F.explode("findings.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def pii_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each replacement ends in the original and in the result, and how far the text has moved by then."""
    found = _scrubbed(spark, d).select("id", F.explode("findings").alias("f"))
    return found.select("id", "f.start", "f.stop", "f.new_stop", "f.delta")


def fingerprint_links(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that several records share: one row per record and fingerprint, with how many others have it."""
    found = _scrubbed(spark, d).select("id", F.explode("findings").alias("f")).select("id", "f.fingerprint").distinct()
    often = found.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(often, "fingerprint").select("id", "fingerprint", (F.col("n") - 1).alias("n_links"))


#: Detectors that stand by themselves, without markers near them, by their place among the detectors.
_ALONE = {"email": 0, "payment_card": 1, "korean_rrn": 2, "aadhaar": 3, "ssn": 4, "pan": 6, "passport": 7, "mobile": 11}


def pii_hits(spark: SparkSession, d: str) -> DataFrame:
    """How often each detector matches in each record, taken by itself; no Python."""
    counts = [F.regexp_count("text", F.lit("(?U)" + scrub.DETECTORS[n][4])).alias(kind) for kind, n in _ALONE.items()]
    return _texts(spark, d).select("id", *counts)


def pii_email_records(spark: SparkSession, d: str) -> DataFrame:
    """Whether each record holds an address, as the scrubber finds it."""
    return _scrubbed(spark, d).select("id", F.array_contains("findings.kind", "email").alias("holds"))


def json_promote(spark: SparkSession, d: str) -> DataFrame:
    """Name and headline of each record, from whichever key holds them."""
    pool = views.newest(table(spark, d, "candidates"), "source")
    named = scrub.json_column(pool, "source", "name", lambda r: (first_text(r, NAME_KEYS) or NOBODY) if isinstance(r, dict) else NOBODY)
    return scrub.json_column(named, "source", "headline", lambda r: first_text(r, HEADLINE_KEYS) if isinstance(r, dict) else "").select("id", "name", "headline")


def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values of each record as one text."""
    pool = views.newest(table(spark, d, "candidates"), "source")
    return scrub.json_column(pool, "source", "flat", lambda v: scrub.flatten(v)).select("id", "flat")


def json_sanitise(spark: SparkSession, d: str) -> DataFrame:
    """Each record with identifiers replaced in values and keys."""
    pool = views.newest(table(spark, d, "candidates"), "source")
    return scrub.json_column(pool, "source", "clean", lambda v: scrub.sanitise(v)).select("id", "clean")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Sums over a path of the events' JSON, by type."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


QUERIES = {
    f.__name__: f
    for f in (
        credential_redact, credential_count, pii_scrub, pii_findings, pii_counts, pii_summary, pii_offsets, fingerprint_links, pii_hits, pii_email_records,
        json_promote, json_flatten, json_sanitise, json_props,
    )
}

_D, _SEP = r"[0-9]", r"(?:[ .\-\x{a0}]{2})?"
_MAIL = r"(^|[^\p{L}\p{N}_.+-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}($|[^\p{L}\p{N}_\-.]|\.($|[^\p{L}\p{N}_]))"


def _numbers(pattern: str, edge: str = "0-9") -> str:
    """Matches between characters that aren't of the edge; these are doubled first, so that neighbours don't share one."""
    doubled = f"regexp_replace(text, '([^{edge}])', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({doubled}, '(?:^|[^{edge}])(?:{pattern})(?:$|[^{edge}])'))"


_SSN = "(?:[0-578][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])--(?:[0-9][1-9]|[1-9]0)--(?:[0-9]{3}[1-9]|[0-9]{2}[1-9]0|[0-9][1-9]00|[1-9]000)"
_COUNTS = {
    "email": f"len(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_.+%@\\-])', '\\1\\1', 'g'), '{_MAIL}'))",
    "payment_card": _numbers(f"(?:{_D}{{4}}{_SEP}){{3}}{_D}{{1,7}}"), "korean_rrn": _numbers(f"{_D}{{6}}{_SEP}[1-8]{_D}{{6}}"), "aadhaar": _numbers(f"{_D}{{4}}{_SEP}{_D}{{4}}{_SEP}{_D}{{4}}"),
    "ssn": f"len(list_filter(regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])({_SSN})(?:$|[^0-9])', 1), lambda x: left(x, 3) <> '000'))",
    "pan": _numbers("[A-Z]{5}[0-9]{4}[A-Z]", "A-Z0-9"), "mobile": _numbers("[6-9][0-9]{9}"),
    "passport": "len(regexp_extract_all(regexp_replace(text, '([^A-Z0-9])', '\\1\\1', 'g'), '(?:^|[^A-Z0-9])(?:[A-PR-WY][0-9]{7}|(?:[a-pr-wy])[0-9]{7})(?:$|[^A-Za-z0-9])'))",
}


def _first(keys: tuple[str, ...]) -> str:
    """The first of the keys whose last value is a string that isn't blank."""
    tests = " ".join(f"WHEN v['{k}'] <> '' THEN v['{k}']" for k in keys)
    return f"CASE {tests} END"


def _redacted(text: str) -> str:
    """Credentials replaced one pattern after the other; edges that may be no part of a word are taken along and put back."""
    edge = lambda body, no: (f"(^|[^{no}]){body}($|[^{no}])", rf"\1{credentials.TOKEN}\2")
    word = r"\p{L}\p{N}_"
    steps = (
        (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", credentials.TOKEN),
        edge(rf"eyJ[{word}-]{{8,}}\.[{word}-]{{8,}}\.[{word}-]{{8,}}", word + "."), edge(r"AIza[0-9A-Za-z_\-]{35}", word + "-"), edge(r"(?:AKIA|ASIA)[0-9A-Z]{16}", word + "-"),
        edge(r"(?:sk|pk|rk|lf|lk|ghp|gho|xoxb|xoxp)[_-][0-9A-Za-z_\-]{16,}", word + "-"), (r"(?i)\b(?:bearer|basic|token)\s+[0-9A-Za-z._\-+/=]{12,}", credentials.TOKEN),
        (r"(?i)\b([\w.\-]*(?:api[_-]?key|secret|password|passwd|token|credential)[\w.\-]*)[\"'']?\s*[:=]\s*[\"'']?([^\s\"'',;}]{8,})[\"'']?", rf"\1={credentials.TOKEN}"),
    )
    for pattern, token in steps:
        text = f"regexp_replace({text}, '{pattern}', '{token}', 'g')"
    return text


_PROMOTE = f"""WITH {NEWEST}, good AS (SELECT id, source FROM pool WHERE json_valid(source) AND json_type(source) = 'OBJECT'),
each_ AS (SELECT good.id, e.key AS k, e.type AS t, e.value->>'$' AS v, row_number() OVER (PARTITION BY good.id, e.key ORDER BY e.id DESC) AS n FROM good, json_each(good.source) AS e),
v AS (SELECT id, map_from_entries(list((k, CASE WHEN t = 'VARCHAR' THEN {strip('v')} ELSE '' END))) AS v FROM each_ WHERE n = 1 AND k IN {(*NAME_KEYS, *HEADLINE_KEYS)} GROUP BY id)
SELECT pool.id, CASE WHEN json_valid(source) THEN coalesce({_first(NAME_KEYS)}, '{NOBODY}') END AS name, CASE WHEN json_valid(source) THEN coalesce({_first(HEADLINE_KEYS)}, '') END AS headline FROM pool LEFT JOIN v ON v.id = pool.id"""

SQL = {
    "pii_hits": f"WITH {NEWEST}, t AS (SELECT id, source AS text FROM pool) SELECT id, " + ", ".join(f"CAST({sql} AS INTEGER) AS {kind}" for kind, sql in _COUNTS.items()) + " FROM t",
    "pii_email_records": f"WITH {NEWEST} SELECT id, coalesce(regexp_matches(source, '{_MAIL}'), false) AS holds FROM pool",
    "json_promote": _PROMOTE,
    "json_flatten": f"WITH {NEWEST}, {FLAT} SELECT pool.id, flat FROM pool LEFT JOIN flat ON pool.id = flat.id",
    "credential_redact": f"SELECT doc_id, {_redacted('text')} AS text FROM documents",
    "credential_count": f"SELECT doc_id, CAST((length(r) - length(replace(r, '{credentials.TOKEN}', ''))) / {len(credentials.TOKEN)} AS INTEGER) AS n FROM (SELECT doc_id, coalesce({_redacted('text')}, '') AS r FROM documents)",
    "json_props": "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'$.k' AS BIGINT)) AS largest FROM events GROUP BY event_type",
}
