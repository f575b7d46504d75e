"""Indexes, answers with provenance, imports, and the seams round them."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake import cli, session
from rosterlake.functions import scrub
from rosterlake.operators import answer, index, order, provider, rank, retrieve
from rosterlake.sources import pool as source

PEOPLE = [("a", "Ida", '{"email": "ida@x.example"}', "kafka streams and ledgers"), ("b", "Omar", '{"password": "hunter2hunter2"}', "ledgers"), ("c", "Noa", None, None)]
QUESTIONS = [(1, "kafka ledgers? write to me@y.example"), (2, "basketweaving"), (3, None)]


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame(PEOPLE, "id string, name string, source string, body string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


class Fake:
    """An outer index in memory; ``broken`` names the calls that fail."""

    def __init__(self, spark, broken=()):
        self.spark, self.broken, self.ids, self.calls = spark, broken, set(), []

    def _call(self, name):
        self.calls.append(name)
        if name in self.broken:
            raise OSError(name)

    def create(self, documents):
        self._call("create")
        self.ids = {r.id for r in documents.collect()}

    def add(self, documents):
        self._call("add")
        self.ids |= {r.id for r in documents.collect()}

    def delete(self, ids):
        self._call("delete")
        self.ids -= {r.id for r in ids.collect()}

    def query(self, questions, k):
        self._call("query")
        return self.spark.createDataFrame([(1, i, 1.0, n) for n, i in enumerate(sorted(self.ids | {"stranger"}), 1)], index.HITS)


def test_outer_index_follows_the_pool_by_differences(spark, pool, questions):
    client = Fake(spark)
    outer = index.index_for("project", "key", client)
    assert outer.backend == "local"
    outer.sync(pool.filter("id != 'c'"))
    outer.sync(pool.filter("id != 'a'"))
    outer.sync(pool.filter("id != 'a'"))
    assert client.calls == ["create", "add", "delete"] and client.ids == {"b", "c"} and outer.backend == "outer"
    assert {r.id for r in outer.search(pool, questions).collect()} == {"b", "c"}  # strangers are dropped
    assert outer.fallbacks == 0


def test_outer_index_falls_back_and_counts(spark, pool, questions):
    exists = index.OuterIndex(Fake(spark, broken=("create",)))
    exists.sync(pool)
    assert exists.backend == "outer"
    down = index.OuterIndex(Fake(spark, broken=("create", "add")))
    down.sync(pool)
    assert down.fallbacks == 1 and down.backend == "local"
    mute = index.OuterIndex(Fake(spark, broken=("query",)))
    mute.sync(pool)
    got = [(r.question_id, r.id) for r in mute.search(pool, questions).orderBy("question_id", "rank").collect()]
    assert got == [(1, "a"), (1, "b")] and mute.fallbacks == 1
    assert isinstance(index.index_for("project", None, Fake(spark)), index.LexicalIndex)


def test_answers_say_what_they_were_given(spark, pool, questions):
    rows = {r.question_id: r for r in answer.prompts(pool, questions, k=2).collect()}
    assert rows[1].considered == ["a", "b"] and rows[2].considered == ["a", "b"] and rows[3].considered == ["a", "b"]
    assert rows[1].prompt.startswith("2 most relevant of a pool of 3") and rows[2].prompt.startswith("whole pool of 3")
    assert "### Candidate C1 (Ida)" in rows[1].prompt and "### Candidate C2 (Omar)" in rows[1].prompt
    for secret in ("ida@x.example", "hunter2", "me@y.example"):
        assert secret not in rows[1].prompt
    echo = lambda batches: (pd.DataFrame({"question_id": b["question_id"], "payload": b["prompt"].str.len().astype(str)}) for b in batches)
    said = {r.question_id: r for r in answer.answers(pool, questions, echo, k=1).collect()}
    assert said[1].reply.isdigit() and said[1].considered == ["a"] and said[1].backend == "local"


def test_an_empty_pool_has_the_fixed_sentence(pool, questions):
    rows = answer.prompts(pool.limit(0), questions).collect()
    assert len(rows) == 3 and all(rank.EMPTY_POOL in r.prompt and r.considered == [] for r in rows)


def test_one_import_appends_counts_and_syncs(spark):
    before = spark.createDataFrame([("old",)], "id string")
    bodies = spark.createDataFrame([("f1", json.dumps([{"name": "Ida", "mail": "ida@x.example"}, {"name": "Omar"}, 7])), ("f2", "{cut"), ("f3", None)], "file string, body string")
    rows, totals, plan = source.imported(before, bodies, "file", "body", 5)
    assert [tuple(r) for r in totals.collect()] == [(2, 1, 3)]
    assert sorted(r.action for r in plan.collect()) == ["add", "add", "keep"]
    assert "ida@x.example" not in "".join(r.source for r in rows.collect())


def test_what_an_import_leaves_out_is_listed(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = [(1, '{"a": 1}'), (2, None), (3, "{cut"), (4, "[1]"), (5, '{"a": ' + deep + "}")]
    df = spark.createDataFrame(rows, "n long, record string")
    assert {tuple(r) for r in source.rejected(df, ["n"], "record").collect()} == {(2, "null"), (3, "not JSON"), (4, "no object"), (5, "too deep")}
    assert [r.n for r in source.ingest(df, ["n"], "record", 1).collect()] == [1]


def test_deep_values_are_walked():
    deep = {"mail": "a@b.example"}
    for _ in range(5_000):
        deep = {"x": [deep]}
    clean = scrub.sanitise(deep)
    for _ in range(5_000):
        clean = clean["x"][0]
    assert clean == {"mail": "<EMAIL_REDACTED>"}
    assert scrub.sanitise({"a@b.example": 1, "c@d.example": 2}) == {"<EMAIL_REDACTED>": 2}


def test_other_detectors_and_spans(spark):
    rows = spark.createDataFrame([("ticket AB-1234 and a@b.example",), (None,), ("",)], "text string")
    mine = [("ticket", 10, "<TICKET>", (), r"[A-Z]{2}-\d{4}")]
    got = [r.scrubbed for r in scrub.scrubbed(rows, "text", b"k" * 16, detectors=mine).collect()]
    assert sorted(got, key=str) == sorted(["ticket <TICKET> and a@b.example", None, ""], key=str)
    text = "to a@b.example or c@d.example now"
    found, clean = scrub.detect(text), scrub.scrub(text)
    start, stop = scrub.translate_span(found, text.index("or"), len(text))
    assert clean[start:stop] == "or <EMAIL_REDACTED> now"
    start, stop = scrub.translate_span(found, text.index("b.ex"), text.index(" or"))
    assert clean[start:stop] == "<EMAIL_REDACTED>"


def test_measured(spark):
    df, seen = provider.measured(spark.createDataFrame([(0.1,), (0.4,), (3.0,), (None,)], "s double"), "s", (0.25, 1), "h")
    df.collect()
    assert seen.get == {"up_to_0.25": 1, "up_to_1": 2, "n": 3, "total": 3.5}


def test_ranks_with_few_and_many_slices(spark, monkeypatch):
    df = spark.range(1000).withColumnRenamed("id", "n")
    monkeypatch.setattr(order, "SLICE", 30)
    assert [(r.n, r.rank) for r in order.ranked(df, [F.col("n").desc()]).orderBy("rank").limit(3).collect()] == [(999, 1), (998, 2), (997, 3)]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"candidates": [{"name": "Ida Moll"}, {"name": "Omar Vey"}]}))
    where = f"{tmp_path}/pool"
    assert cli.main(["seed", where, f"{tmp_path}/in"], spark) == 0
    assert cli.main(["verify", where], spark) == 0
    assert cli.main(["export", where, f"{tmp_path}/out"], spark) == 0
    out = capsys.readouterr().out
    assert "2 records imported" in out and "Ida Moll" in out and "Unscored" in out
    assert sorted(json.loads(r.value)["name"] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["Ida Moll", "Omar Vey"]


def test_total_may_be_given(spark, pool, questions):
    few = {tuple(r) for r in retrieve.scores(pool, "id", "body", questions).collect()}
    assert few == {tuple(r) for r in retrieve.scores(pool, "id", "body", questions, total=3).collect()}
