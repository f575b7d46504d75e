"""Ranking: handles, prompts, the analyst's payloads and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import text, verdicts
from rosterlake.functions.credentials import redacted
from rosterlake.functions.scrub import scrubbed

#: Fixed value: what stands in a prompt where there are no records.
EMPTY_POOL = "The candidate pool is empty. No records have been imported yet."


def handle(place: Column) -> Column:
    """The handle of the record at a place, from 0."""
    return F.concat(F.lit("C"), (place + 1).cast("string"))


def handles(candidates: DataFrame) -> DataFrame:
    """(request_id, handle, id): a file's records by their place in it."""
    return candidates.select("request_id", handle(F.col("record_no")).alias("handle"), "id").distinct()


def rendered(handle_: Column, name: Column, record: Column) -> Column:
    """A record as the analyst reads it: a line with handle and name, then its JSON with sorted keys.

    A record with a repeated key or that isn't JSON is given as it stands.
    """
    body = F.coalesce(F.to_json(F.try_parse_json(record)), record, F.lit("{}"))
    return F.concat(F.lit("### Candidate "), handle_, F.lit(" ("), F.coalesce(name, F.lit("")), F.lit(")\n"), body)


def context(records: DataFrame, group: str, place: str, rendered_: str) -> DataFrame:
    """(group, context): the rendered records of a group in order, an empty line between them.

    Meant for groups that fit a prompt. Records are made safe one by one before
    they are joined: credentials are replaced first, then identifiers.
    """
    safe = scrubbed(records.select(group, place, redacted(F.col(rendered_)).alias("text")), "text", into="safe").select(group, place, "safe")
    parts = F.transform(F.sort_array(F.collect_list(F.struct(place, "safe"))), lambda x: x["safe"])
    return safe.groupBy(group).agg(F.array_join(parts, "\n\n").alias("context"))


def context_or_empty(groups: DataFrame, contexts: DataFrame, group: str) -> DataFrame:
    """(group, context) of every group; one without records has the fixed sentence."""
    known = groups.select(group).distinct().join(contexts, group, "left")
    return known.select(group, F.coalesce("context", F.lit(EMPTY_POOL)).alias("context"))


def roster(records: DataFrame, group: str, place: str, name: str, most: int = 8) -> DataFrame:
    """(group, n, roster): how many records and the first names in order."""
    first = records.filter(F.col(place) < most)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, name))), lambda x: x[name]), ", ")
    return records.groupBy(group).agg(F.count("*").alias("n")).join(first.groupBy(group).agg(names.alias("roster")), group, "left").fillna("no candidates yet", ["roster"])


def offline_scores(records: DataFrame, key: str, body: str) -> DataFrame:
    """(key, n_words, score, verdict) by how much a record says: the stand-in where no model is at hand."""
    words = text.word_count(F.col(body))
    share = verdicts.richness(F.col("n_words"))
    return records.select(key, words.alias("n_words")).select(key, "n_words", F.round(share, 3).alias("score"), verdicts.by_richness(share).alias("verdict"))


def payload_object(payload: Column) -> Column:
    """The JSON object inside an answer: from the first fence that holds one, from its first to its last brace; null if there is none."""
    tidy = text.strip(F.coalesce(payload, F.lit("")))
    fenced = F.filter(F.split(tidy, "```"), lambda x: x.contains("{"))
    inner = F.when(tidy.contains("```") & (F.size(fenced) > 0), fenced[0]).otherwise(tidy)
    found = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def rankings(payloads: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys, ``position``, ``handle``, ``score``, ``verdict`` and ``rationale`` of every ranking in the answers.

    Answers without a readable object, or whose ``rankings`` is no array, give
    nothing; so do rankings that aren't objects or have no id. Scores that are
    no numbers count as 0, others are held between 0 and 1; unknown verdicts are
    MAYBE.
    """
    found = payloads.select(*keys, F.try_parse_json(payload_object(F.col(payload))).alias("v"))
    rows = found.select(*keys, F.posexplode(F.try_variant_get("v", "$.rankings", "array<variant>")).alias("position", "r"))
    field = lambda name, kind: F.try_variant_get("r", f"$.{name}", kind)
    named = field("id", "string")
    good = rows.filter(F.schema_of_variant("r").startswith("OBJECT") & named.isNotNull() & ~named.isin("", "0", "false"))
    return good.select(
        *keys, "position", named.alias("handle"), verdicts.clamped(field("score", "string")).alias("score"), verdicts.normalised(field("verdict", "string")).alias("verdict"),
        text.capped(text.strip(F.coalesce(field("rationale", "string"), F.lit(""))), "rationale").alias("rationale"),
    )


def scrubbed_rankings(ranked: DataFrame) -> DataFrame:
    """Rankings with identifiers in the rationale replaced."""
    done = scrubbed(ranked, "rationale", into="clean")
    return done.withColumn("rationale", F.col("clean")).drop("clean", "findings")


def last_wins(ranked: DataFrame, group: str, order: list[str]) -> DataFrame:
    """One ranking per group and handle: the last one, by ``order``. Partial maxima, no window."""
    rest = [c for c in ranked.columns if c not in (group, "handle")]
    row = F.max(F.struct(*order, F.struct(*rest).alias("row"))).alias("m")
    return ranked.groupBy(group, "handle").agg(row).select(group, "handle", "m.row.*")


def unknown(ranked: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """Rankings whose handle no record of the group has."""
    return ranked.join(known.select(group, "handle").distinct(), [group, "handle"], "left_anti")


def apply(pool: DataFrame, ranked: DataFrame, known: DataFrame, group: str, now: int) -> DataFrame:
    """The pool with score, recommendation, rationale and analyzed_at of the rankings; other rows stay. ``applied`` says which."""
    new = ranked.join(known, [group, "handle"]).groupBy("id").agg(F.max(F.struct(group, "score", "verdict", "rationale")).alias("r"))
    joined = pool.join(new, "id", "left")
    hit = F.col("r").isNotNull()
    return joined.withColumns(
        {
            "score": F.when(hit, F.col("r.score")).otherwise(F.col("score")), "recommendation": F.when(hit, F.col("r.verdict")).otherwise(F.col("recommendation")),
            "rationale": F.when(hit, F.col("r.rationale")).otherwise(F.col("rationale")), "analyzed_at": F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("analyzed_at")), "applied": hit,
        }
    ).drop("r")


def apply_baseline(pool: DataFrame, baseline: DataFrame) -> DataFrame:
    """The pool with the fixed verdicts of the named; of names listed twice the row with the greatest verdict counts. ``applied`` says which."""
    one = baseline.groupBy("name").agg(F.max(F.struct("score", "verdict", "rationale")).alias("b"))
    hit = F.col("b").isNotNull()
    joined = pool.join(one, "name", "left")
    return joined.withColumns(
        {c: F.when(hit, F.col(f"b.{v}")).otherwise(F.col(c)) for c, v in (("score", "score"), ("recommendation", "verdict"), ("rationale", "rationale"))} | {"applied": hit}
    ).drop("b")
