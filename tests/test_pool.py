import json

from pyspark.sql import functions as F

from rosterlake.functions import text, verdicts
from rosterlake.operators import order, rank, retrieve, views
from rosterlake.sources import pool as source

POOL = [
    ("sec", "Anna Ring", "Security engineer", "kernel exploit and security research at scale"), ("mob", "Ravi Menon", "Mobile developer", "swift and kotlin apps"),
    ("dist", "Lea Tok", "Distributed systems", "go kafka postgres ledger throughput"), ("thin", "Go Fan", "Fan of go", " ".join(["go"] * 60)), ("none", None, None, None),
]


def _docs(spark):
    rows = spark.createDataFrame(POOL, "id string, name string, headline string, body string")
    return rows.select("id", retrieve.document_text(F.col("name"), F.col("headline"), F.col("body")).alias("t"), F.lit(1).alias("score"), F.lit("x").alias("term"))


def _search(spark, *questions, k=12):
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    return retrieve.best(retrieve.scores(_docs(spark), "id", "t", asked), "id", k)


def test_terms(spark):
    rows = [("Node.js and C++",), ("p99 latency",), ("GPT-4 fine-tuning",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.terms(F.col("t"))).collect()]
    assert got == [["node.js", "c++"], ["p99", "latency"], ["gpt-4", "fine-tuning"], [], []]


def test_relevance_and_order(spark):
    assert _search(spark, "who has security experience?").filter("rank = 1").first().id == "sec"
    assert [r.id for r in _search(spark, "tell me about Ravi").collect()] == ["mob"]
    hits = sorted(_search(spark, "go engineer kafka").collect(), key=lambda r: r["rank"])
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert _search(spark, "go kafka postgres ledger").filter("rank = 1").first().id == "dist"
    assert _search(spark, "zzzzz quantum", "").count() == 0
    assert _search(spark, "kotlin kafka", k=1).count() == 1


def test_norms_match_plain_python(spark):
    import math
    from collections import Counter

    asked = spark.createDataFrame([(0, "go kafka")], "question_id long, question string")
    got = {r.id: r.score for r in retrieve.scores(_docs(spark), "id", "t", asked).collect()}
    bags = {r.id: Counter(r.x) for r in _docs(spark).select("id", text.terms(F.col("t")).alias("x")).collect()}
    for i, score in got.items():
        idf = {t: math.log((len(POOL) + 1) / (1 + sum(t in b for b in bags.values()))) + 1 for t in ("go", "kafka")}
        norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in bags[i].values()))
        assert abs(score - sum((1 + math.log(bags[i][t])) * idf[t] for t in idf if bags[i][t]) / norm) < 1e-8


def test_fallback_fills_only_what_found_nothing(spark):
    asked = spark.createDataFrame([(1, "kafka"), (2, "zzzz")], "question_id long, question string")
    hits = retrieve.best(retrieve.scores(_docs(spark), "id", "t", asked), "id")
    got = retrieve.with_fallback(hits, _docs(spark), "id", asked, [F.col("id")], k=2).collect()
    assert sorted((r.question_id, r.id) for r in got) == [(1, "dist"), (2, "dist"), (2, "mob")]


def test_nearest_is_exact_in_blocks_and_skips_bad_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1, 100):
        got = [(r.vec_id, r.neighbour, r["rank"]) for r in retrieve.nearest(df, df.filter("vec_id <= 3"), "vec_id", "embedding", k=1, block=block).collect()]
        assert sorted(got) == [(1, 2, 1), (2, 1, 1), (3, 2, 1)]
    assert retrieve.nearest(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_sync_plan(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert {tuple(r) for r in retrieve.sync_plan(a, b).collect()} == {("x", "add"), ("y", "keep"), ("z", "delete")}


def test_newest_row_counts(spark):
    cols = "id string, name string, imported_at long, score double, analyzed_at long, request_id long, record_no int"
    df = spark.createDataFrame([("a", "old", 1, None, None, 1, 0), ("a", "new", 1, 0.5, 9, 1, 0), ("a", "new", 1, 0.5, 9, 1, 0), (None, "x", 1, None, None, 1, 0)], cols)
    assert [r.name for r in views.newest(df).collect()] == ["new"]


def test_order_and_ranks_over_slices(spark):
    rows = [(str(i), f"N{i % 3}", None if i % 5 == 0 else (i % 4) / 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, name string, score double")
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1].lower(), r[0]))]
    got = order.ranked(df, views.pool_order(), slices=5).orderBy("rank").collect()
    assert [r.id for r in got] == want and [r["rank"] for r in got] == list(range(1, 201))
    assert order.ranked(df.limit(0), views.pool_order()).count() == 0


def test_search_takes_patterns_as_text(spark):
    df = spark.createDataFrame([("a", "100% sure", None, None), ("b", "x", "under_score", None), ("c", None, None, "Ünïcode")], "id string, name string, headline string, rationale string")
    assert [r.id for r in views.search(df, "0% S").collect()] == ["a"]
    assert [r.id for r in views.search(df, "_").collect()] == ["b"]
    assert [r.id for r in views.search(df, "ünï").collect()] == ["c"]


def test_small_functions(spark):
    df = spark.createDataFrame([("  ada king lovelace ", 0.125, 100), (None, None, None)], "n string, s double, t long")
    a, b = df.select(text.initials(F.col("n")), text.percent(F.col("s")), text.percent_label(F.col("s")), text.time_ago(F.col("t"), F.lit(100 + 7200)), text.word_count(F.col("n"))).collect()
    assert tuple(a) == ("AK", 13, "13", "2h ago", 3) and tuple(b) == ("", 0, "--", "never", 0)


PAYLOADS = [
    (1, '{"rankings": [{"id": "C1", "score": 2.5, "verdict": "interview"}, {"id": "C2", "score": -4, "verdict": "strong hire", "rationale": " x "}]}'),
    (2, 'Here:\n```json\n{"rankings": [{"id": "C3", "score": "0.7", "verdict": " pass "}]}\n```\nbye'), (3, "no json"), (4, "{not valid}"), (5, "{}"), (6, '{"rankings": 5}'),
    (7, '{"rankings": [{"score": 1}, 3, null, {"id": "", "score": 1}, {"id": "C4", "score": null, "verdict": null}, {"id": "C5", "score": "n/a"}]}'), (8, None), (9, ""),
]


def test_payloads(spark):
    df = spark.createDataFrame(PAYLOADS, "payload_id long, payload string")
    got = {(r.payload_id, r.handle): (r.score, r.verdict, r.rationale) for r in rank.rankings(df, ["payload_id"], "payload").collect()}
    assert got == {
        (1, "C1"): (1.0, "INTERVIEW", ""), (1, "C2"): (0.0, "MAYBE", "x"), (2, "C3"): (0.7, "PASS", ""), (7, "C4"): (0.0, "MAYBE", ""), (7, "C5"): (0.0, "MAYBE", ""),
    }


def test_rankings_change_only_known_rows_and_the_last_wins(spark):
    pool = spark.createDataFrame([("a", 0.1, "PASS", "r", 1), ("b", None, None, None, None)], "id string, score double, recommendation string, rationale string, analyzed_at long")
    known = spark.createDataFrame([(1, "C1", "a"), (1, "C2", "b")], "request_id long, handle string, id string")
    ranked = spark.createDataFrame([(1, "C1", 1, 0.2, "MAYBE", "x"), (1, "C1", 2, 0.9, "INTERVIEW", "y"), (1, "C99", 3, 1.0, "PASS", "")], "request_id long, handle string, position int, score double, verdict string, rationale string")
    last = rank.last_wins(ranked, "request_id", ["position"])
    rows = {r.id: (r.score, r.recommendation, r.analyzed_at, r.applied) for r in rank.apply(pool, last, known, "request_id", 50).collect()}
    assert rows == {"a": (0.9, "INTERVIEW", 50, True), "b": (None, None, None, False)}
    assert [r.handle for r in rank.unknown(ranked, known, "request_id").collect()] == ["C99"]


def test_each_record_is_scored_by_its_own_text(spark):
    df = spark.createDataFrame([(1, "w " * 220), (2, "w " * 100), (3, "w"), (4, None)], "k int, t string")
    got = {r.k: (r.score, r.verdict) for r in rank.offline_scores(df, "k", "t").collect()}
    assert got == {1: (1.0, "INTERVIEW"), 2: (0.455, "MAYBE"), 3: (0.005, "PASS"), 4: (0.0, "PASS")}


def test_verdicts_and_scores(spark):
    df = spark.createDataFrame([(v,) for v in ("interview", " Pass", "strong hire", "", None, "maybe")], "v string")
    assert [r[0] for r in df.select(verdicts.normalised(F.col("v"))).collect()] == ["INTERVIEW", "PASS", "MAYBE", "MAYBE", "MAYBE", "MAYBE"]


def test_import_of_both_envelopes(spark):
    bodies = [("a", json.dumps([{"full_name": " Ada ", "title": "call 9876543210", "n": 1}, 7])), ("b", json.dumps({"candidates": [{"x": {"mail": "a@b.com"}}]})), ("c", "{cut"), ("d", None), ("e", "[]")]
    df = spark.createDataFrame([(k, b, "clash") for k, b in bodies], "k string, body string, record string")
    rows = source.ingest(source.unpack(df, "k", "body"), ["k", "record_no"], "record", 5).collect()
    got = {r.k: r for r in rows}
    assert set(got) == {"a", "b"} and got["a"].name == "Ada" and got["a"].headline == "call <PHONE_REDACTED>" and json.loads(got["a"].source)["n"] == 1
    assert got["b"].name == source.NOBODY and "a@b.com" not in got["b"].source and got["b"].held_pii
    reasons = {r.k: r.reason for r in source.checked(df, "k", "body").collect()}
    assert reasons == {"a": None, "b": None, "c": "empty", "d": "empty", "e": "empty"}


def test_scrub_comes_before_the_cut_and_credentials_before_both():
    name, _, _, _ = source.candidate({"name": "x" * 195 + " 9876543210"})
    assert name == "x" * 195 + " <PHO"
    _, _, stored, held = source.candidate({"name": "A", "note": "api_key = abcdefgh1234"})
    assert "<CREDENTIAL_REDACTED>" in stored and held


def test_names_come_from_the_first_text_that_is_one():
    assert source.first_text({"name": 5, "full_name": "  ", "fullName": " B "}, source.NAME_KEYS) == "B"
    assert source.first_text({}, source.NAME_KEYS) == ""


def test_history_tail_and_messages(spark):
    rows = [("c", i, "user" if i % 2 else "system", "" if i == 3 else "hi") for i in range(1, 15)]
    df = spark.createDataFrame(rows, "conv string, turn_no int, role string, content string")
    tail = views.last_turns(df, "conv", ["turn_no"])
    assert sorted((r.turn_no, r.turn) for r in tail.collect()) == [(n + 4, n) for n in range(1, 11)]
    bad = {r.turn_no: r.reason for r in views.checked_messages(df, "role", "content").collect()}
    assert bad[1] is None and bad[2] == "role" and bad[3] == "blank"
