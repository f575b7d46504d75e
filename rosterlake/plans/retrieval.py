"""Retrieval queries over documents, candidates and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import text
from rosterlake.functions.scrub import flatten, json_column
from rosterlake.operators import answer, order, retrieve, views
from rosterlake.plans.common import FLAT, NEWEST, POSTINGS, strip, terms
from rosterlake.session import table

QUESTION = "Who led the move of stream processing to Kafka and wrote the migration guide for the data quality team?"
ANALYST = "security analyst with Kafka and incident response"
NOTHING = "zzzzz quantum basketweaving"


def _asked(spark: SparkSession, *questions: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(questions, 1)), "question_id bigint, question string")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every item whose id is divisible by 50."""
    return table(spark, d, "eval_items").filter(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twelve documents most relevant to one question."""
    scored = retrieve.scores(table(spark, d, "documents"), "doc_id", "text", _asked(spark, QUESTION))
    return retrieve.best(scored, "doc_id").select("doc_id", "score", "rank")


def retrieve_batch(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best documents of each of many questions at once."""
    scored = retrieve.scores(table(spark, d, "documents"), "doc_id", "text", _items(spark, d))
    return retrieve.best(scored, "doc_id").select("question_id", "doc_id", "score", "rank")


def retrieve_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """As above for two questions, one of which nothing matches: it gets the head of the documents."""
    docs = table(spark, d, "documents")
    asked = _asked(spark, QUESTION, NOTHING)
    hits = retrieve.best(retrieve.scores(docs, "doc_id", "text", asked), "doc_id")
    return retrieve.with_fallback(hits, docs, "doc_id", asked, [F.col("doc_id")])


def candidate_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The twelve candidates most relevant to a question, with their names, in order."""
    pool = views.newest(table(spark, d, "candidates"), "name", "headline", "source")
    total = views.newest(table(spark, d, "candidates"), "name").count()  # without flattening any record
    flat = json_column(pool, "source", "flat", lambda v: flatten(v))
    docs = flat.select("id", "name", retrieve.document_text(F.col("name"), F.col("headline"), F.col("flat")).alias("body"))
    best = retrieve.best(retrieve.scores(docs, "id", "body", _asked(spark, ANALYST), total=total), "id")
    return best.join(pool.select("id", "name"), "id").select("id", "name", "score", "rank")


def answer_considered(spark: SparkSession, d: str) -> DataFrame:
    """What each question was answered from: the ids in order, and how many; the head of the pool where nothing matches."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("name"), F.lit("{}").alias("source"), F.col("text").alias("body"))
    rows = answer.prompts(docs, _asked(spark, QUESTION, NOTHING))
    return rows.select("question_id", F.array_join("considered", " ").alias("considered"), F.size("considered").alias("n"), "backend")


def scope_sentence(spark: SparkSession, d: str) -> DataFrame:
    """What part of the pool each question was answered from."""
    docs = table(spark, d, "documents")
    asked = _asked(spark, QUESTION, NOTHING)
    found = retrieve.best(retrieve.scores(docs, "doc_id", "text", asked), "doc_id").groupBy("question_id").agg(F.count("*").alias("n"))
    total = docs.count()
    n = F.coalesce("n", F.lit(0))
    part = F.concat(n.cast("string"), F.lit(f" most relevant of a pool of {total}"))
    return asked.join(found, "question_id", "left").select("question_id", n.alias("n"), F.when(n > 0, part).otherwise(f"whole pool of {total}").alias("scope"))


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each document: how many, and how many different."""
    found = text.terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", found.alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which each term stands."""
    return retrieve.document_frequency(retrieve.postings(table(spark, d, "documents"), "doc_id", "text"))


def doc_norms(spark: SparkSession, d: str) -> DataFrame:
    """The length of each document's vector."""
    found = retrieve.norms(retrieve.postings(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return found.select("doc_id", F.round("norm", 9).alias("norm"))


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings")
    return retrieve.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), "vec_id", "embedding")


def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    """What to add to, delete from and keep in an index of the candidates that documents name."""
    indexed = table(spark, d, "documents").select(F.col("candidate_id").alias("id"))
    accepted = table(spark, d, "candidates").filter(F.col("score").isNotNull())
    return retrieve.sync_plan(accepted, indexed)


def pool_rank(spark: SparkSession, d: str) -> DataFrame:
    """The place of every candidate in the pool's order."""
    pool = views.newest(table(spark, d, "candidates"), "name", "score")
    return order.ranked(pool, views.pool_order()).select("id", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        retrieve_topk, retrieve_batch, retrieve_with_fallback, candidate_retrieve, answer_considered, scope_sentence, tokenize_stats, doc_frequency, doc_norms,
        semantic_topk, sync_diff, pool_rank,
    )
}


def _scored(questions: str) -> str:
    return f"""
questions AS ({questions}),
asked AS (SELECT DISTINCT question_id, unnest({terms('question')}) AS term FROM questions),
scored AS (
  SELECT question_id, doc_id, round(sum((1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1.0) / (1 + df)) + 1)) / any_value(norm), 9) AS score
  FROM asked JOIN postings USING (term) JOIN freq USING (term) JOIN norms USING (doc_id) GROUP BY question_id, doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


_ONE = f"SELECT 1 AS question_id, '{QUESTION}' AS question"
_TWO = f"{_ONE} UNION ALL SELECT 2, '{NOTHING}'"

SQL = {
    "retrieve_topk": f"WITH {POSTINGS}, {_scored(_ONE)} SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 12",
    "retrieve_batch": f"WITH {POSTINGS}, {_scored('SELECT item_id AS question_id, text AS question FROM eval_items WHERE item_id % 50 = 0')} SELECT question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 12",
    "retrieve_with_fallback": f"""WITH {POSTINGS}, {_scored(_TWO)}, hits AS (SELECT question_id, doc_id, score, rank FROM best WHERE rank <= 12),
head AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 12)
SELECT CAST(question_id AS BIGINT) AS question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM hits UNION ALL
SELECT CAST(question_id AS BIGINT), doc_id, 0.0, CAST(rank AS INTEGER) FROM head, questions WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.question_id = questions.question_id)""",
    "candidate_retrieve": f"""WITH {NEWEST}, {FLAT},
documents AS (SELECT pool.id AS doc_id, left({strip("coalesce(name, '') || '. ' || coalesce(headline, '') || '. ' || coalesce(name, '') || '. ' || coalesce(flat, '')")}, 20000) AS text FROM pool LEFT JOIN flat ON pool.id = flat.id),
{POSTINGS}, {_scored(f"SELECT 1 AS question_id, '{ANALYST}' AS question")}
SELECT best.doc_id AS id, pool.name, best.score, CAST(rank AS INTEGER) AS rank FROM best JOIN pool ON pool.id = best.doc_id WHERE rank <= 12""",
    "answer_considered": f"""WITH {POSTINGS}, {_scored(_TWO)}, hits AS (SELECT question_id, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 12),
head AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS rank FROM documents QUALIFY rank <= 12),
every AS (SELECT * FROM hits UNION ALL SELECT question_id, id, rank FROM head, questions q WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.question_id = q.question_id))
SELECT CAST(question_id AS BIGINT) AS question_id, string_agg(id, ' ' ORDER BY rank) AS considered, CAST(count(*) AS INTEGER) AS n, 'local' AS backend FROM every GROUP BY question_id""",
    "scope_sentence": f"""WITH {POSTINGS}, {_scored(_TWO)}, n AS (SELECT question_id, count(*) AS n FROM best WHERE rank <= 12 GROUP BY ALL)
SELECT CAST(question_id AS BIGINT) AS question_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN n || ' most relevant of a pool of ' || (SELECT count(*) FROM documents)
ELSE 'whole pool of ' || (SELECT count(*) FROM documents) END AS scope FROM questions LEFT JOIN n USING (question_id)""",
    "tokenize_stats": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {terms('text')} AS t FROM documents)",
    "doc_frequency": f"WITH {POSTINGS} SELECT term, df FROM freq",
    "doc_norms": f"WITH {POSTINGS} SELECT doc_id, round(norm, 9) AS norm FROM norms",
    "semantic_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 5""",
    "sync_diff": """WITH cur AS (SELECT DISTINCT id FROM candidates WHERE score IS NOT NULL AND id IS NOT NULL), idx AS (SELECT DISTINCT candidate_id AS id FROM documents WHERE candidate_id IS NOT NULL)
SELECT coalesce(cur.id, idx.id) AS id, CASE WHEN idx.id IS NULL THEN 'add' WHEN cur.id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM cur FULL JOIN idx ON cur.id = idx.id""",
    "pool_rank": f"WITH {NEWEST} SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, lower(name) NULLS FIRST, id) AS rank FROM pool",
}
