"""Views of the pool, the analyst's rankings, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import text, verdicts
from rosterlake.operators import order, rank, views
from rosterlake.plans.common import NEWEST, SPACE, strip
from rosterlake.session import table
from rosterlake.sources import pool as source

NOW = 1_767_225_600
SOUGHT = "stream processing"


def _pool(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return views.newest(table(spark, d, "candidates"), *columns)


def pool_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The pool, best first, unscored last."""
    return order.ranked(views.summary(_pool(spark, d, *views.SUMMARY)), views.pool_order())


def pool_ranked_plain(spark: SparkSession, d: str) -> DataFrame:
    """The pool where unscored rows count as 0."""
    return order.ranked(_pool(spark, d, "score").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), views.plain_order())


def pool_head(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 rows by id: the scan that fits one analysis."""
    return _pool(spark, d, "name").select("id", "name").orderBy("id").limit(200)


def pool_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All rows of one candidate, by its id; the filter reaches the scan."""
    candidates = table(spark, d, "candidates")
    wanted = candidates.agg(F.min("id")).first()[0]
    return candidates.filter(F.col("id") == F.lit(wanted)).select("id", "name", "headline", "feed", "record_no").distinct()


def pool_delete(spark: SparkSession, d: str) -> DataFrame:
    """The pool without the candidates that pass."""
    pool = _pool(spark, d, "recommendation")
    return source.delete(pool, views.with_verdict(pool, "PASS")).select("id", "recommendation")


def pool_filter_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Candidates to interview."""
    return views.with_verdict(_pool(spark, d, "name", "score", "recommendation"), "INTERVIEW").select("id", "name", "score")


def pool_search(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose name, headline or rationale holds the words."""
    return views.search(_pool(spark, d, "name", "headline", "rationale"), SOUGHT).select("id", "name")


def pool_display_rank(spark: SparkSession, d: str) -> DataFrame:
    """Places within a filtered view."""
    seen = views.search(views.with_verdict(_pool(spark, d, "name", "headline", "rationale", "score", "recommendation"), "INTERVIEW"), SOUGHT).select("id", "name", "score")
    return order.ranked(seen, views.pool_order()).select("id", "rank")


def pool_analysed(spark: SparkSession, d: str) -> DataFrame:
    return views.analysed(_pool(spark, d, "analyzed_at")).select("id", "analyzed_at")


def pool_cards(spark: SparkSession, d: str) -> DataFrame:
    """Initials, per cent, label and age of each candidate."""
    return views.cards(_pool(spark, d, "name", "score", "recommendation", "analyzed_at"), NOW)


def pool_caps(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to what is stored of them."""
    pool = _pool(spark, d, "name", "headline", "rationale")
    return pool.select("id", *[text.capped(F.col(c), c).alias(c) for c in ("name", "headline", "rationale")])


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.verdict_counts(_pool(spark, d, "score", "recommendation"))


def pool_status(spark: SparkSession, d: str) -> DataFrame:
    return views.status(_pool(spark, d, "analyzed_at"))


def verdicts_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as they stand and as the ladder has them."""
    rows = table(spark, d, "candidates").groupBy(verdicts.normalised(F.col("recommendation")).alias("verdict")).agg(F.count("*").alias("n"))
    return rows


def assign_handles(spark: SparkSession, d: str) -> DataFrame:
    """The handle of every record in its file."""
    return rank.handles(table(spark, d, "candidates"))


def prompt_roster(spark: SparkSession, d: str) -> DataFrame:
    """How many records each file brought, and the first eight names."""
    once = table(spark, d, "candidates").select("request_id", "record_no", F.coalesce("name", F.lit("")).alias("name")).groupBy("request_id", "record_no").agg(F.min("name").alias("name"))
    return rank.roster(once, "request_id", "record_no", "name")


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """The size of each file's prompt, made safe record by record, and its number of records; files without records have the fixed sentence."""
    once = table(spark, d, "candidates").groupBy("request_id", "record_no").agg(F.min(F.struct("name", "source")).alias("r"))
    parts = once.select("request_id", "record_no", rank.rendered(rank.handle(F.col("record_no")), F.col("r.name"), F.col("r.source")).alias("part"))
    joined = rank.context_or_empty(table(spark, d, "import_requests"), rank.context(parts, "request_id", "record_no", "part"), "request_id")
    return joined.select("request_id", F.length("context").alias("n_chars"), F.regexp_count("context", F.lit("### Candidate C")).alias("n_records"))


def richness_rank(spark: SparkSession, d: str) -> DataFrame:
    """Documents scored by how much they say."""
    return rank.offline_scores(table(spark, d, "documents"), "doc_id", "text")


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    return rank.rankings(table(spark, d, "ranking_payloads"), ["payload_id", "request_id", "created_at"], "payload")


def parse_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Every ranking in the analyst's answers."""
    return rank.scrubbed_rankings(_rankings(spark, d)).drop("created_at")


def unknown_handles(spark: SparkSession, d: str) -> DataFrame:
    """Rankings for handles that no record has."""
    found = _rankings(spark, d)
    return rank.unknown(found, rank.handles(table(spark, d, "candidates")), "request_id").select("payload_id", "handle").distinct()


def apply_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The pool after the last answer for each record was applied."""
    last = rank.last_wins(_rankings(spark, d), "request_id", ["created_at", "payload_id", "position"])
    done = rank.apply(_pool(spark, d, "score", "recommendation", "rationale", "analyzed_at"), last, rank.handles(table(spark, d, "candidates")), "request_id", NOW)
    return done.select("id", "score", "recommendation", "analyzed_at", "applied")


def analysis_tally(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates an analysis reached, and how many it skipped."""
    done = apply_rankings(spark, d)
    return done.agg(F.count_if("applied").alias("analyzed"), F.count_if(~F.col("applied")).alias("skipped"))


def baseline_join(spark: SparkSession, d: str) -> DataFrame:
    """The pool with the fixed verdicts of the named candidates."""
    done = rank.apply_baseline(_pool(spark, d, "name", "score", "recommendation", "rationale"), table(spark, d, "baseline_verdicts"))
    return done.select("id", "score", "recommendation", "applied")


def import_envelope(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, n_records, reason) of every pending import."""
    pending = table(spark, d, "import_requests").filter((F.col("status") == "pending") & F.col("candidates").isNotNull())
    once = pending.groupBy("request_id").agg(F.min("candidates").alias("body"))
    return source.checked(once, "request_id", "body")


def import_pool(spark: SparkSession, d: str) -> DataFrame:
    """Pending records as rows of the pool, scrubbed."""
    pending = table(spark, d, "import_requests").filter((F.col("status") == "pending") & F.col("candidates").isNotNull())
    once = pending.groupBy("request_id").agg(F.min("candidates").alias("body"))
    return source.ingest(source.unpack(once, "request_id", "body"), ["request_id", "record_no"], "record", NOW)


def import_summary(spark: SparkSession, d: str) -> DataFrame:
    """Imported and redacted records of each pending import."""
    return import_pool(spark, d).groupBy("request_id").agg(F.count("*").alias("imported"), F.count_if("held_pii").alias("redacted"))


def import_totals(spark: SparkSession, d: str) -> DataFrame:
    """What one import of all pending files brings, and the size of the pool after it."""
    pending = table(spark, d, "import_requests").filter((F.col("status") == "pending") & F.col("candidates").isNotNull())
    once = pending.groupBy("request_id").agg(F.min("candidates").alias("body"))
    _, totals, _ = source.imported(_pool(spark, d, "feed"), once, "request_id", "body", NOW)
    return totals.select("imported", "total")


def pool_export(spark: SparkSession, d: str) -> DataFrame:
    """Every record, ready to be imported again."""
    return source.export(_pool(spark, d, "source"))


def history_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last ten posts of each forum, as turns of a conversation."""
    posts = table(spark, d, "documents").filter("doc_type = 'forum_post'").select("source", "collected_at", "doc_id")
    return views.last_turns(posts, "source", ["collected_at", "doc_id"]).select("source", "doc_id", "turn")


def message_validate(spark: SparkSession, d: str) -> DataFrame:
    """Why each document would be refused as a message."""
    docs = table(spark, d, "documents").withColumn("role", F.when(F.col("doc_type") == "forum_post", "user").when(F.col("doc_type") == "interview_note", "model").otherwise("system"))
    return views.checked_messages(docs, "role", "text").select("doc_id", "reason")


def history_validate(spark: SparkSession, d: str) -> DataFrame:
    """Forums as conversations: how many turns, and which are too long to be sent."""
    posts = table(spark, d, "documents").filter("doc_type = 'forum_post'")
    return views.checked_histories(posts, "source")


QUERIES = {
    f.__name__: f
    for f in (
        pool_ranked, pool_ranked_plain, pool_head, pool_lookup, pool_delete, pool_filter_verdict, pool_search, pool_display_rank, pool_analysed, pool_cards,
        pool_caps, verdict_counts, pool_status, verdicts_normalised, assign_handles, prompt_roster, prompt_context, richness_rank, parse_rankings, unknown_handles,
        apply_rankings, analysis_tally, baseline_join, import_envelope, import_pool, import_summary, pool_export, history_tail, message_validate, history_validate, import_totals,
    )
}

_WORDS = f"len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda w: w <> ''))"
_NORMAL = "CASE WHEN v IN ('INTERVIEW', 'MAYBE', 'PASS') THEN v ELSE 'MAYBE' END"
_OBJECT = f"""
tidy AS (SELECT payload_id, request_id, created_at, {strip("coalesce(payload, '')")} AS t FROM ranking_payloads),
fenced AS (SELECT *, list_filter(string_split(t, '```'), lambda x: contains(x, '{{')) AS parts FROM tidy),
inner_ AS (SELECT payload_id, request_id, created_at, CASE WHEN contains(t, '```') AND len(parts) > 0 THEN parts[1] ELSE t END AS t FROM fenced),
objects AS (SELECT payload_id, request_id, created_at, TRY_CAST(nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') AS JSON) AS j FROM inner_),
rows_ AS (SELECT payload_id, request_id, created_at, r.value AS r, CAST(r.key AS BIGINT) AS position FROM objects, json_each(j, '$.rankings') AS r
  WHERE json_type(j, '$.rankings') = 'ARRAY'),
rankings AS (SELECT payload_id, request_id, created_at, position, r->>'$.id' AS handle,
  greatest(0.0, least(1.0, coalesce(TRY_CAST(r->>'$.score' AS DOUBLE), 0.0))) AS score,
  replace(upper({strip("coalesce(r->>'$.verdict', '')")}), ' ', '_') AS v, r FROM rows_ WHERE json_type(r) = 'OBJECT' AND coalesce(r->>'$.id', '') NOT IN ('', '0', 'false'))"""
_HANDLES = "handles AS (SELECT DISTINCT request_id, 'C' || (record_no + 1) AS handle, id FROM candidates)"
_APPLIED = f"""WITH {NEWEST}, {_OBJECT}, {_HANDLES},
last_ AS (SELECT * FROM rankings QUALIFY row_number() OVER (PARTITION BY request_id, handle ORDER BY created_at DESC, payload_id DESC, position DESC) = 1),
new_ AS (SELECT id, score, {_NORMAL} AS verdict, request_id FROM last_ JOIN handles USING (request_id, handle)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC, score DESC, {_NORMAL} DESC) = 1),
done AS (SELECT pool.id, CASE WHEN new_.id IS NULL THEN pool.score ELSE new_.score END AS score, CASE WHEN new_.id IS NULL THEN recommendation ELSE verdict END AS recommendation,
  CASE WHEN new_.id IS NULL THEN analyzed_at ELSE {NOW} END AS analyzed_at, new_.id IS NOT NULL AS applied FROM pool LEFT JOIN new_ ON pool.id = new_.id)"""

SQL = {
    "pool_ranked": f"WITH {NEWEST} SELECT id, name, headline, imported_at, score, recommendation, rationale, analyzed_at, row_number() OVER (ORDER BY score DESC NULLS LAST, lower(name) NULLS FIRST, id) AS rank FROM pool",
    "pool_ranked_plain": f"WITH {NEWEST} SELECT id, coalesce(score, 0.0) AS score, row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, id) AS rank FROM pool",
    "pool_head": f"WITH {NEWEST} SELECT id, name FROM pool ORDER BY id LIMIT 200",
    "pool_lookup": "SELECT DISTINCT id, name, headline, feed, record_no FROM candidates WHERE id = (SELECT min(id) FROM candidates)",
    "pool_delete": f"WITH {NEWEST} SELECT id, recommendation FROM pool WHERE recommendation IS DISTINCT FROM 'PASS'",
    "pool_filter_verdict": f"WITH {NEWEST} SELECT id, name, score FROM pool WHERE recommendation = 'INTERVIEW'",
    "pool_search": f"WITH {NEWEST} SELECT id, name FROM pool WHERE contains(lower(coalesce(name, '')), '{SOUGHT}') OR contains(lower(coalesce(headline, '')), '{SOUGHT}') OR contains(lower(coalesce(rationale, '')), '{SOUGHT}')",
    "pool_display_rank": f"WITH {NEWEST} SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, lower(name) NULLS FIRST, id) AS rank FROM pool WHERE recommendation = 'INTERVIEW' AND (contains(lower(coalesce(name, '')), '{SOUGHT}') OR contains(lower(coalesce(headline, '')), '{SOUGHT}') OR contains(lower(coalesce(rationale, '')), '{SOUGHT}'))",
    "pool_analysed": f"WITH {NEWEST} SELECT id, analyzed_at FROM pool WHERE analyzed_at IS NOT NULL",
    "pool_cards": f"""WITH {NEWEST}, w AS (SELECT *, list_filter(regexp_split_to_array({strip("coalesce(name, '')")}, '{SPACE}+'), lambda x: x <> '') AS words, {NOW} - analyzed_at AS gone FROM pool)
SELECT id, name, upper(coalesce(left(words[1], 1), '') || coalesce(left(words[2], 1), '')) AS initials, CAST(coalesce(floor(score * 100 + 0.5), 0) AS BIGINT) AS percent,
CASE WHEN score IS NULL THEN '--' ELSE CAST(CAST(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS percent_label,
CASE WHEN score IS NULL THEN 'Unscored' WHEN recommendation = 'INTERVIEW' THEN 'Interview' WHEN recommendation = 'MAYBE' THEN 'Maybe' WHEN recommendation = 'PASS' THEN 'Pass' ELSE 'Unscored' END AS verdict_label,
CASE WHEN analyzed_at IS NULL OR analyzed_at = 0 THEN 'never' WHEN gone < 60 THEN 'just now' WHEN gone < 3600 THEN CAST(CAST(floor(gone / 60) AS BIGINT) AS VARCHAR) || 'm ago'
WHEN gone < 86400 THEN CAST(CAST(floor(gone / 3600) AS BIGINT) AS VARCHAR) || 'h ago' ELSE CAST(CAST(floor(gone / 86400) AS BIGINT) AS VARCHAR) || 'd ago' END AS analyzed FROM w""",
    "pool_caps": f"WITH {NEWEST} SELECT id, left(name, 200) AS name, left(headline, 400) AS headline, left(rationale, 1000) AS rationale FROM pool",
    "verdict_counts": f"WITH {NEWEST} SELECT count(*) FILTER (recommendation = 'INTERVIEW') AS interview, count(*) FILTER (recommendation = 'MAYBE') AS maybe, count(*) FILTER (recommendation = 'PASS') AS pass, count(*) FILTER (score IS NULL) AS unscored, count(*) AS total FROM pool",
    "pool_status": f"WITH {NEWEST} SELECT count(*) AS candidates, count(analyzed_at) AS analyzed, coalesce(max(analyzed_at), 0) AS last_analyzed FROM pool",
    "verdicts_normalised": f"WITH x AS (SELECT replace(upper({strip(chr(99) + 'oalesce(recommendation, ' + chr(39) * 2 + ')')}), ' ', '_') AS v FROM candidates) SELECT {_NORMAL} AS verdict, count(*) AS n FROM x GROUP BY 1",
    "assign_handles": f"WITH {_HANDLES} SELECT request_id, handle, id FROM handles",
    "prompt_roster": """WITH once AS (SELECT request_id, record_no, min(coalesce(name, '')) AS name FROM candidates GROUP BY ALL)
SELECT request_id, count(*) AS n, coalesce(string_agg(name, ', ' ORDER BY record_no) FILTER (record_no < 8), 'no candidates yet') AS roster FROM once GROUP BY request_id""",
    "richness_rank": f"""WITH w AS (SELECT doc_id, {_WORDS} AS n FROM documents) SELECT doc_id, CAST(n AS INTEGER) AS n_words, round(least(1.0, n / 220.0), 3) AS score,
CASE WHEN least(1.0, n / 220.0) > 0.66 THEN 'INTERVIEW' WHEN least(1.0, n / 220.0) > 0.33 THEN 'MAYBE' ELSE 'PASS' END AS verdict FROM w""",
    "unknown_handles": f"WITH {_OBJECT}, {_HANDLES} SELECT DISTINCT payload_id, handle FROM rankings r WHERE NOT EXISTS (SELECT 1 FROM handles h WHERE h.request_id = r.request_id AND h.handle = r.handle)",
    "apply_rankings": f"{_APPLIED} SELECT * FROM done",
    "analysis_tally": f"{_APPLIED} SELECT count(*) FILTER (applied) AS analyzed, count(*) FILTER (NOT applied) AS skipped FROM done",
    "baseline_join": f"""WITH {NEWEST}, one AS (SELECT name, score AS s, verdict FROM baseline_verdicts QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC NULLS LAST, verdict DESC NULLS LAST, rationale DESC) = 1)
SELECT id, CASE WHEN one.name IS NULL THEN score ELSE s END AS score, CASE WHEN one.name IS NULL THEN recommendation ELSE verdict END AS recommendation, one.name IS NOT NULL AS applied FROM pool LEFT JOIN one ON pool.name = one.name""",
    "import_envelope": """WITH once AS (SELECT request_id, TRY_CAST(min(candidates) AS JSON) AS j FROM import_requests WHERE status = 'pending' AND candidates IS NOT NULL GROUP BY ALL),
n AS (SELECT request_id, coalesce(CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) ELSE json_array_length(j, '$.candidates') END, 0) AS n FROM once)
SELECT request_id, CAST(n AS BIGINT) AS n_records, CASE WHEN n < 1 THEN 'empty' WHEN n > 2000 THEN 'too many records' END AS reason FROM n""",
    "import_totals": f"""WITH {NEWEST}, once AS (SELECT request_id, TRY_CAST(min(candidates) AS JSON) AS j FROM import_requests WHERE status = 'pending' AND candidates IS NOT NULL GROUP BY ALL),
items AS (SELECT request_id, unnest(CAST(CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE j->'$.candidates' END AS JSON[])) AS r FROM once WHERE j IS NOT NULL),
n AS (SELECT count(*) AS imported FROM items WHERE json_type(r) = 'OBJECT') SELECT imported, imported + (SELECT count(*) FROM pool) AS total FROM n""",
    "pool_export": f"WITH {NEWEST} SELECT id, source AS record FROM pool WHERE json_valid(source)",
    "parse_rankings": f"""WITH {_OBJECT} SELECT payload_id, request_id, position, handle, score, {_NORMAL} AS verdict, left({strip("coalesce(r->>'$.rationale', '')")}, 1000) AS rationale FROM rankings""",
    "history_validate": """SELECT source, count(*) AS n_turns, CASE WHEN count(*) > 20 THEN 'too many turns' END AS reason FROM documents WHERE doc_type = 'forum_post' GROUP BY source""",
    "history_tail": """WITH x AS (SELECT source, doc_id, collected_at, row_number() OVER (PARTITION BY source ORDER BY collected_at DESC, doc_id DESC) AS b FROM documents WHERE doc_type = 'forum_post')
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY collected_at, doc_id) AS INTEGER) AS turn FROM x WHERE b <= 10""",
    "message_validate": f"""SELECT doc_id, CASE WHEN doc_type IS NULL OR doc_type NOT IN ('forum_post', 'interview_note') THEN 'role' WHEN text IS NULL OR {strip('text')} = '' THEN 'blank' WHEN length(text) > 8000 THEN 'too long' END AS reason FROM documents""",
}
