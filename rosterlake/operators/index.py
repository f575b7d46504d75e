"""Indexes that answer questions about the pool: the lexical one, an outer one, and how the second falls back on the first."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import retrieve

HITS = "question_id bigint, id string, score double, rank int"


class PoolIndex(Protocol):
    """What an index has to offer: its name, keeping in step with the pool, and hits for questions."""

    backend: str

    def sync(self, pool: DataFrame) -> None:
        """Bring the index in step with the pool of (id, body)."""

    def search(self, pool: DataFrame, questions: DataFrame, k: int = retrieve.TOP) -> DataFrame:
        """(question_id, id, score, rank) of the best rows for each of (question_id, question)."""


class LexicalIndex:
    """TF-IDF over the pool as it is at the moment of asking, so it is never out of step."""

    backend = "local"

    def sync(self, pool: DataFrame) -> None:
        pass

    def search(self, pool: DataFrame, questions: DataFrame, k: int = retrieve.TOP) -> DataFrame:
        scored = retrieve.scores(pool.select("id", "body"), "id", "body", questions)
        return retrieve.best(scored, "id", k).select("question_id", "id", "score", "rank")


class Client(Protocol):
    """An outer index behind a network."""

    def create(self, documents: DataFrame) -> None: ...
    def add(self, documents: DataFrame) -> None: ...
    def delete(self, ids: DataFrame) -> None: ...
    def query(self, questions: DataFrame, k: int) -> DataFrame: ...


class OuterIndex:
    """An outer index kept in step by differences; any failure of it is counted and answered by the lexical one.

    The first sync creates the index, or adds to one that exists; later ones
    add what is new and delete what is gone. Hits whose rows left the pool are
    dropped.
    """

    def __init__(self, client: Client):
        self.client, self.fallbacks = client, 0
        self.indexed: DataFrame | None = None
        self._local = LexicalIndex()

    @property
    def backend(self) -> str:
        return "outer" if self.indexed is not None else self._local.backend

    def sync(self, pool: DataFrame) -> None:
        try:
            if self.indexed is None:
                try:
                    self.client.create(pool)
                except Exception:  # it exists already
                    self.client.add(pool)
            else:
                plan = retrieve.sync_plan(pool, self.indexed)
                new, gone = (plan.filter(F.col("action") == what).select("id") for what in ("add", "delete"))
                if not new.isEmpty():
                    self.client.add(pool.join(new, "id", "left_semi"))
                if not gone.isEmpty():
                    self.client.delete(gone)
            self.indexed = pool.select("id").distinct()
        except Exception:
            self.fallbacks += 1
            self.indexed = None

    def search(self, pool: DataFrame, questions: DataFrame, k: int = retrieve.TOP) -> DataFrame:
        if self.indexed is not None:
            try:
                return retrieve.known_hits(self.client.query(questions, k), pool)
            except Exception:
                self.fallbacks += 1
        return self._local.search(pool, questions, k)


def index_for(project: str | None, key: str | None, client: Client | None = None) -> PoolIndex:
    """The outer index if it has both credentials and a client, else the lexical one."""
    return OuterIndex(client) if project and key and client is not None else LexicalIndex()
