"""Retrieval: TF-IDF and vectors, and keeping an index in step with the pool."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import text

#: Records a question is answered from.
TOP = 12


def document_text(name: Column, headline: Column, body: Column) -> Column:
    """What a record is found by; the name counts twice."""
    empty = F.lit("")
    name, headline, body = (F.coalesce(c, empty) for c in (name, headline, body))
    return text.capped(text.strip(F.concat(name, F.lit(". "), headline, F.lit(". "), name, F.lit(". "), body)), "document")


def postings(docs: DataFrame, key: str, body: str, strip_end: bool = False) -> DataFrame:
    """(key, term, tf) of every document; documents without terms have no row."""
    found = docs.select(F.col(key), F.explode(text.terms(F.col(body), strip_end)).alias("term"))
    return found.groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(found: DataFrame) -> DataFrame:
    """(term, df)."""
    return found.groupBy("term").agg(F.count("*").alias("df"))


def norms(found: DataFrame, key: str) -> DataFrame:
    """(key, norm): the length of a document's vector of sublinear term frequencies."""
    weight = 1 + F.log(F.col("tf").cast("double"))
    return found.groupBy(key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def scores(docs: DataFrame, key: str, body: str, questions: DataFrame, question_key: str = "question_id", question: str = "question", total: int | None = None) -> DataFrame:
    """(question_id, key, score) of every document that shares a term with a question.

    A document's norm comes from its own row, so only occurrences of the
    questions' terms are shuffled. Empty documents count in n. Scores are
    rounded to 9 places, which makes them independent of the order of summing.
    Null documents and blank questions give no rows. ``total`` is the number of
    documents, where it is cheaper known than counted.
    """
    asked = questions.select(F.col(question_key).alias("question_id"), F.explode(F.array_distinct(text.terms(F.col(question)))).alias("term"))
    n = docs.count() if total is None else total
    # in steps: an expression beside an explode would be computed for every exploded row
    counted = docs.select(F.col(key), text.terms(F.col(body)).alias("terms")).select(key, "terms", _norm(F.col("terms")).alias("norm"))
    rows = counted.select(key, "norm", F.explode("terms").alias("term"))
    hits = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("norm").alias("norm"))
    idf = hits.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((F.lit(n) + 1) / (1 + F.col("df"))) + 1).alias("idf"))
    parts = hits.join(idf, "term").join(asked, "term").select("question_id", key, "norm", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("part"))
    return parts.groupBy("question_id", key).agg(F.round(F.sum("part") / F.first("norm"), 9).alias("score")).filter("score > 0")


def _norm(found: Column) -> Column:
    """The length of the vector of sublinear term frequencies, in one pass over the sorted terms."""
    start = F.struct(F.lit("").alias("term"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def closed(s: Column) -> Column:
        weight = 1 + F.log(s["run"].cast("double"))
        return s["sum"] + F.when(s["run"] > 0, weight * weight).otherwise(F.lit(0.0))

    def step(s: Column, term: Column) -> Column:
        same = s["term"] == term
        return F.struct(term.alias("term"), F.when(same, s["run"] + 1).otherwise(F.lit(1)).alias("run"), F.when(same, s["sum"]).otherwise(closed(s)).alias("sum"))

    return F.aggregate(F.sort_array(found), start, step, lambda s: F.sqrt(closed(s)))


def best(scored: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each question with their rank; ties go to the smaller key."""
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_fallback(hits: DataFrame, pool: DataFrame, key: str, questions: DataFrame, order: list[Column], k: int = TOP) -> DataFrame:
    """Hits, and for questions without any the head of the pool, scored 0."""
    head = [r[0] for r in pool.orderBy(*order).limit(k).select(key).collect()]  # k values
    lost = questions.select("question_id").distinct().join(hits.select("question_id").distinct(), "question_id", "left_anti")
    first = F.posexplode(F.array(*[F.lit(x) for x in head])) if head else F.posexplode(F.array().cast(f"array<{pool.schema[key].dataType.simpleString()}>"))
    filled = lost.select("question_id", first.alias("rank", key)).select("question_id", key, F.lit(0.0).alias("score"), (F.col("rank") + 1).alias("rank"))
    return hits.select("question_id", key, "score", "rank").unionByName(filled)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 2_000, other: str = "neighbour") -> DataFrame:
    """(query key, neighbour, score): the ``k`` vectors of greatest cosine to each query, itself left out.

    Exact. Queries go out ``block`` at a time as one matrix; each batch of
    vectors is multiplied with it and keeps its own best ``k``, so little is
    shuffled. Null, empty and zero vectors, and those of another length, are no
    neighbours and have none. Scores are rounded to 6 places; ties go to the
    smaller key.
    """
    spark = vectors.sparkSession
    out = None
    base = vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def part(held: list) -> DataFrame:
        size = max(len(r[1]) for r in held)
        same = [r for r in held if len(r[1]) == size]
        matrix = np.array([r[1] for r in same], dtype=np.float64)
        length = np.linalg.norm(matrix, axis=1)
        ids = np.array([r[0] for r in same])[length > 0]
        shared = spark.sparkContext.broadcast((ids, matrix[length > 0] / length[length > 0][:, None]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, unit = shared.value
            for batch in batches:
                rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == unit.shape[1] and None not in v]
                if not rows:
                    continue
                own, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
                size = np.linalg.norm(m, axis=1)
                cosine = np.round(unit @ (m / np.where(size > 0, size, 1)[:, None]).T, 6)
                cosine[:, size == 0] = -2
                cosine[names[:, None] == own[None, :]] = -2
                order = np.lexsort((np.broadcast_to(own, cosine.shape), -cosine), axis=1)[:, :k]
                q = np.repeat(names, order.shape[1])
                got = np.take_along_axis(cosine, order, axis=1).reshape(-1)
                keep = got > -2
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(own[order.reshape(-1)][keep]), pa.array(got[keep])], [key, other, "score"])

        return base.mapInArrow(run, f"`{key}` bigint, `{other}` bigint, score double")

    held: list = []
    for row in queries.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).toLocalIterator():
        if row[0] is not None and row[1] and None not in row[1]:
            held.append((row[0], row[1]))
        if len(held) == block:
            out = part(held) if out is None else out.unionByName(part(held))
            held = []
    if held:
        out = part(held) if out is None else out.unionByName(part(held))
    if out is None:
        return spark.createDataFrame([], f"`{key}` bigint, `{other}` bigint, score double, rank int")
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(other).asc())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sync_plan(current: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """(key, action): add what the index lacks, delete what is gone, keep the rest. Null keys are left out."""
    now = current.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("now", F.lit(True))
    then = indexed.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("then", F.lit(True))
    action = F.when(F.col("then").isNull(), "add").when(F.col("now").isNull(), "delete").otherwise("keep")
    return now.join(then, key, "full").select(key, action.alias("action"))


def known_hits(hits: DataFrame, pool: DataFrame, key: str = "id") -> DataFrame:
    """Hits of an outer index whose rows are still in the pool."""
    return hits.join(pool.select(key).distinct(), key, "left_semi")
