"""SQL that several queries share."""

from __future__ import annotations

from rosterlake.functions.text import SPACE, STOPWORDS

NEWEST = """
pool AS (
  SELECT id, name, headline, source, imported_at, score, recommendation, rationale, analyzed_at, request_id, record_no, feed
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(analyzed_at, -1) DESC, imported_at DESC, request_id DESC, record_no DESC,
    name DESC NULLS LAST, headline DESC NULLS LAST, source DESC NULLS LAST) AS rn
    FROM candidates WHERE id IS NOT NULL) WHERE rn = 1
)"""

STOP = "'" + "','".join(STOPWORDS) + "'"


def terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9+.#_-]*'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


POSTINGS = f"""
docs AS (SELECT doc_id, unnest({terms('text')}) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum((1 + ln(tf)) * (1 + ln(tf)))) AS norm FROM postings GROUP BY doc_id),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


#: (id, flat): keys and values of each record of the pool as one text, down to the sixth level; a repeated key has its first place and its last value.
FLAT = r"""
good AS (SELECT id, source FROM pool WHERE json_valid(source)),
tree AS (SELECT good.id, t.id AS node, t.fullkey AS path, CASE WHEN t.fullkey <> '$' AND NOT suffix(t.fullkey, ']') THEN t.key END AS k, t.type AS kind, t.value AS v,
  len(regexp_extract_all(t.fullkey, '\.("([^"\\]|\\.)*"|[^.\[\]"]+)|\[\d+\]')) AS depth FROM good, json_tree(good.source) AS t),
parts AS (SELECT id, path, node, k, CASE WHEN depth > 6 OR kind IN ('NULL', 'BOOLEAN') OR v IN ('{}', '[]') THEN '' WHEN kind NOT IN ('OBJECT', 'ARRAY') THEN v->>'$' END AS own FROM tree WHERE depth <= 7),
once AS (SELECT id, min(node) AS node, any_value(k) AS k, arg_max(struct_pack(o := own), node).o AS own FROM parts GROUP BY id, path),
flat AS (SELECT id, string_agg(CASE WHEN k IS NULL THEN own WHEN own IS NULL THEN k ELSE k || ' ' || own END, ' ' ORDER BY node) AS flat FROM once GROUP BY id)"""
