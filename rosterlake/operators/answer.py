"""Answers with their provenance: what a question was answered from, and by what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.credentials import redacted
from rosterlake.functions.scrub import scrubbed
from rosterlake.operators import provider, rank, retrieve
from rosterlake.operators.index import LexicalIndex, PoolIndex


def scope(considered: F.Column, total: int, matched: F.Column) -> F.Column:
    """What part of the pool a question was answered from."""
    part = F.concat(considered.cast("string"), F.lit(f" most relevant of a pool of {total}"))
    return F.when(matched, part).otherwise(F.lit(f"whole pool of {total}"))


def considered(pool: DataFrame, questions: DataFrame, index: PoolIndex | None = None, k: int = retrieve.TOP) -> DataFrame:
    """(question_id, id, score, rank): the hits of each question, or the head of the pool where there are none."""
    hits = (index or LexicalIndex()).search(pool, questions, k)
    return retrieve.with_fallback(hits, pool, "id", questions, [F.col("id")], k)


def prompts(pool: DataFrame, questions: DataFrame, index: PoolIndex | None = None, k: int = retrieve.TOP) -> DataFrame:
    """(question_id, prompt, considered, backend) of every question over a pool of (id, name, source, body).

    ``considered`` are the ids in order. The prompt holds the scope, the records
    (each made safe by itself) under handles, and the question, from which
    credentials and identifiers are replaced too. A pool without rows gives the
    fixed sentence instead of records.
    """
    index = index or LexicalIndex()
    total = pool.select("id").count()
    rows = considered(pool, questions, index, k)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    lists = rows.groupBy("question_id").agg(ids.alias("considered"), (F.max("score") > 0).alias("matched"))
    parts = rows.join(pool.select("id", "name", "source"), "id").select("question_id", "rank", rank.rendered(rank.handle(F.col("rank") - 1), F.col("name"), F.col("source")).alias("part"))
    context = rank.context_or_empty(questions, rank.context(parts, "question_id", "rank", "part"), "question_id")
    asked = scrubbed(questions.select("question_id", redacted(F.col("question")).alias("question")), "question", into="asked").select("question_id", "asked")
    whole = asked.join(lists, "question_id", "left").join(context, "question_id")
    said = F.concat_ws("\n\n", scope(F.size("considered"), total, F.coalesce("matched", F.lit(False))), F.col("context"), F.coalesce("asked", F.lit("")))
    return whole.select("question_id", said.alias("prompt"), F.coalesce("considered", F.array().cast("array<string>")).alias("considered"), F.lit(index.backend).alias("backend"))


def answers(pool: DataFrame, questions: DataFrame, model: provider.Provider, index: PoolIndex | None = None, k: int = retrieve.TOP) -> DataFrame:
    """(question_id, reply, considered, backend): what a provider says to each question, and what it was told."""
    from rosterlake.session import materialise

    asked = materialise(prompts(pool, questions, index, k), "prompts")
    said = provider.answers(asked, "question_id", "prompt", model)
    return asked.join(said, "question_id", "left").select("question_id", F.col("payload").alias("reply"), "considered", "backend")
