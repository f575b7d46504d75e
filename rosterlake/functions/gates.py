"""Boundaries that no identifier or credential may pass, and the SQL names of the scrubbing functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import credentials, scrub


def guard(*columns: str, mode: str = "strict", boundary: str = "egress") -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform(guard("text"))`` right before a write.

    ``strict`` makes the job fail if a column holds a credential or an
    identifier, naming only their kinds, never their values; ``permissive``
    replaces them. Nulls pass.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"no such mode: {mode}")

    def apply(df: DataFrame) -> DataFrame:
        names = df.columns
        for c in columns:
            text = F.col(f"`{c}`")
            if mode == "permissive":
                df = scrub.scrubbed(df.withColumn(c, credentials.redacted(text)), c, into="__clean", findings="__found")
                df = df.withColumn(c, F.col("__clean")).drop("__clean", "__found")
            else:
                df = scrub.scrubbed(df.withColumn(c, credentials.gate(text)), c, into="__clean", findings="__found")
                kinds = F.array_join(F.array_sort(F.array_distinct(F.col("__found.kind"))), ", ")
                message = F.concat(F.lit(f"identifiers at the {boundary} boundary: "), kinds)
                df = df.withColumn(c, F.when(F.size("__found") == 0, text).otherwise(F.raise_error(message).cast("string"))).drop("__clean", "__found")
        return df.select(*names)

    return apply


def translated(findings: Column, place: Column) -> Column:
    """The place in the scrubbed text of a place in the original, from the findings of :func:`scrub.scrubbed`."""
    before = F.filter(findings, lambda f: f["start"] <= place)
    last = F.try_element_at(before, F.lit(-1))
    return F.when(last.isNull(), place).when(place < last["stop"], last["new_stop"]).otherwise(place + last["delta"])


def scrub_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else scrub.scrub(t))


class Findings:
    """The rows of ``pii_findings(text)``."""

    def eval(self, text: str) -> Iterator[tuple]:
        for n, f in enumerate(scrub.detect(text or "")):
            yield n, f.kind, f.start, f.stop, f.token


def register(spark: SparkSession) -> None:
    """``scrub_pii(text)`` and the table function ``pii_findings(text)`` for SQL."""
    spark.udf.register("scrub_pii", F.pandas_udf(scrub_text, "string"))
    spark.udtf.register("pii_findings", F.udtf(Findings, returnType="ord int, kind string, start int, stop int, token string"))
