"""The pool as its readers see it: order, filter, search, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import text, verdicts

SUMMARY = ("id", "name", "headline", "imported_at", "score", "recommendation", "rationale", "analyzed_at")


def newest(candidates: DataFrame, *columns: str) -> DataFrame:
    """One row per id: the one analysed last, then imported last; all columns, or the id and those named.

    Name the columns that are needed: only they are read and shuffled.

    Partial maxima per id, so an id that stands in very many rows is no burden
    to one task. Null ids are left out.
    """
    rest = [c for c in columns or candidates.columns if c != "id"]
    order = [F.coalesce("analyzed_at", F.lit(-1)), "imported_at", "request_id", "record_no"]
    row = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))
    best = candidates.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("best"))
    return best.select("id", "best.row.*").select(*(columns and ["id", *rest] or candidates.columns))


def pool_order() -> list[Column]:
    """Scored rows first, best first, then by name without regard to case; the id breaks ties."""
    return [F.col("score").desc_nulls_last(), F.lower("name").asc(), F.col("id").asc()]


def plain_order() -> list[Column]:
    """Unscored rows count as 0; the id breaks ties."""
    return [F.coalesce("score", F.lit(0.0)).desc(), F.col("id").asc()]


def summary(pool: DataFrame) -> DataFrame:
    return pool.select(*SUMMARY)


def with_verdict(pool: DataFrame, verdict: str) -> DataFrame:
    """Rows of a verdict; ``ALL`` keeps every row."""
    return pool if verdict == "ALL" else pool.filter(F.col("recommendation") == verdict)


def search(pool: DataFrame, words: str) -> DataFrame:
    """Rows whose name, headline or rationale contains the words, upper or lower case."""
    return pool.filter(text.holds(words, F.col("name"), F.col("headline"), F.col("rationale")))


def analysed(pool: DataFrame) -> DataFrame:
    return pool.filter(F.col("analyzed_at").isNotNull())


def verdict_counts(pool: DataFrame) -> DataFrame:
    """One row: the rows of each verdict, those without a score, and all."""
    by = [F.count_if(F.col("recommendation") == v).alias(v.lower()) for v in verdicts.LADDER]
    return pool.agg(*by, F.count_if(F.col("score").isNull()).alias("unscored"), F.count("*").alias("total"))


def status(pool: DataFrame) -> DataFrame:
    """One row: all rows, the analysed ones, and when the last was analysed (0 for never)."""
    return pool.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("analyzed_at").isNotNull()).alias("analyzed"),
        F.coalesce(F.max(F.coalesce(F.col("analyzed_at"), F.lit(0))), F.lit(0)).alias("last_analyzed"),
    )


def cards(pool: DataFrame, now: int) -> DataFrame:
    """What a card shows: initials, the score in per cent, the verdict's label, how long ago."""
    score = F.col("score")
    verdict = F.when(score.isNull(), F.lit(None)).otherwise(F.col("recommendation"))
    return pool.select(
        "id", "name", text.initials(F.col("name")).alias("initials"), text.percent(score).alias("percent"), text.percent_label(score).alias("percent_label"),
        verdicts.label(verdict).alias("verdict_label"), text.time_ago(F.col("analyzed_at"), F.lit(now)).alias("analyzed"),
    )


def last_turns(messages: DataFrame, conversation: str, order: list[str], keep: int = 10) -> DataFrame:
    """The last turns of each conversation, with ``turn`` counting from 1 in order."""
    from pyspark.sql import Window

    back = Window.partitionBy(conversation).orderBy(*[F.col(c).desc() for c in order])
    on = Window.partitionBy(conversation).orderBy(*order)
    tail = messages.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= keep).drop("__back")
    return tail.withColumn("turn", F.row_number().over(on))


#: The longest text of a turn and of a new message, and the most turns that are sent along.
LONGEST_TURN, LONGEST_MESSAGE, MOST_TURNS = 8_000, 4_000, 20


def checked_histories(messages: DataFrame, conversation: str, most: int = MOST_TURNS) -> DataFrame:
    """(conversation, n_turns, reason): why a conversation can't be sent along, null if it can."""
    counts = messages.groupBy(conversation).agg(F.count("*").alias("n_turns"))
    return counts.withColumn("reason", F.when(F.col("n_turns") > most, "too many turns"))


def checked_messages(messages: DataFrame, role: str, content: str, longest: int = LONGEST_TURN) -> DataFrame:
    """``messages`` with ``reason``: why a turn is refused, null if it is good; a new message has ``LONGEST_MESSAGE``."""
    size = F.length(content)
    reason = (
        F.when(F.col(role).isNull() | ~F.col(role).isin("user", "model"), "role")
        .when(F.col(content).isNull() | (text.strip(F.col(content)) == ""), "blank")
        .when(size > longest, "too long")
    )
    return messages.withColumn("reason", reason)
