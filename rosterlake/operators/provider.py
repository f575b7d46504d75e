"""The seam where a model may be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rosterlake.operators import rank

#: Takes batches of (key, prompt) and gives batches of (key, payload).
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def answers(prompts: DataFrame, key: str, prompt: str, provider: Provider) -> DataFrame:
    """(key, payload): what a provider says to each prompt.

    Prompts go out as they are: put ``gates.guard`` before. A provider that
    fails fails the job; :func:`or_offline` shows how to fall back.
    """
    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, F.col(prompt).alias("prompt")).mapInPandas(provider, f"`{key}` {kind}, payload string")


def or_offline(provider: Provider, offline: Provider) -> Provider:
    """A provider whose failed batches are answered by another one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                done = list(provider(iter([batch])))
            except Exception:
                done = list(offline(iter([batch])))
            yield from done

    return run


def offline_rankings(records: DataFrame, group: str, place: str, body: str) -> DataFrame:
    """(group, handle, score, verdict): the stand-in where no model is configured, by how much each record says."""
    named = records.withColumn("handle", rank.handle(F.col(place)))
    scored = rank.offline_scores(named.withColumn("__key", F.struct(group, "handle")), "__key", body)
    return scored.select(f"__key.{group}", "__key.handle", "score", "verdict")


def measured(df: DataFrame, column: str, edges: tuple[float, ...], name: str) -> tuple[DataFrame, Observation]:
    """``df`` and a histogram of a column, filled while it is written: rows up to each edge, all rows, and their sum. Nulls count in none."""
    seen = Observation(name)
    value = F.col(column)
    below = [F.count_if(value <= edge).alias(f"up_to_{edge:g}") for edge in edges]
    return df.observe(seen, *below, F.count(value).alias("n"), F.coalesce(F.sum(value.cast("double")), F.lit(0.0)).alias("total")), seen


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and the observation that counts its rows, and those with identifiers if it says so, while it is written."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("n_rows")]
    if "held_pii" in df.columns:
        counts.append(F.count_if("held_pii").alias("n_redacted"))
    return df.observe(seen, *counts), seen
