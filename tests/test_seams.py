import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake.config import Settings
from rosterlake.functions import gates, scrub
from rosterlake.operators import provider, retrieve
from rosterlake.sources import pool as source


def test_settings_fall_back():
    s = Settings.from_env({"ROSTERLAKE_TOP": "5", "ROSTERLAKE_POOL_CAP": "many", "ROSTERLAKE_STRICT": "off", "ROSTERLAKE_ENVIRONMENT": "production"})
    assert (s.top, s.pool_cap, s.strict, s.environment) == (5, 200, False, "production")


def test_guard(spark):
    df = spark.createDataFrame([("fine", "mail a@b.com and 9876543210", 1), (None, "api_key = abcdefgh1234", 2)], "a string, b string, findings int")
    assert [r.a for r in df.transform(gates.guard("a")).collect()].count("fine") == 1
    with pytest.raises(Exception, match="email, phone"):
        df.filter("findings = 1").transform(gates.guard("b")).collect()
    with pytest.raises(Exception, match="credential"):
        df.filter("findings = 2").transform(gates.guard("b")).collect()
    got = {r.findings: r.b for r in df.transform(gates.guard("a", "b", mode="permissive")).collect()}
    assert got == {1: "mail <EMAIL_REDACTED> and <PHONE_REDACTED>", 2: "api_key=<CREDENTIAL_REDACTED>"}
    with pytest.raises(ValueError, match="mode"):
        gates.guard("a", mode="loose")


def test_places_by_column_equal_places_in_python(spark):
    text = "ab a@b.com cd 9876543210 ef"
    df = scrub.scrubbed(spark.createDataFrame([(text,)], "t string"), "t", scrub.key_from("k"))
    places = list(range(len(text)))
    got = [r[0] for r in df.select(F.explode(F.array(*[gates.translated(F.col("findings"), F.lit(p)) for p in places]))).collect()]
    assert got == [scrub.translate(scrub.detect(text), p) for p in places]


def test_sql_functions(spark):
    gates.register(spark)
    assert spark.sql("SELECT scrub_pii('x a@b.com') AS t").first().t == "x <EMAIL_REDACTED>"
    rows = spark.sql("SELECT * FROM pii_findings('a@b.com or 9876543210')").collect()
    assert [(r.ord, r.kind) for r in rows] == [(0, "email"), (1, "phone")]


def test_provider_and_fallback(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "k long, p string")

    def model(batches):
        for b in batches:
            if (b.prompt == "bad").any():
                raise RuntimeError
            yield pd.DataFrame({"k": b.k, "payload": b.prompt + "!"})

    def offline(batches):
        for b in batches:
            yield pd.DataFrame({"k": b.k, "payload": "offline"})

    got = {r.k: r.payload for r in provider.answers(df.repartition(2, "k"), "k", "p", provider.or_offline(model, offline)).collect()}
    assert got[2] == "offline" and got[1] in ("good!", "offline")
    ranked = provider.offline_rankings(spark.createDataFrame([(7, 0, "w " * 230), (7, 1, "w")], "g long, n int, b string"), "g", "n", "b")
    assert {(r.g, r.handle, r.verdict) for r in ranked.collect()} == {(7, "C1", "INTERVIEW"), (7, "C2", "PASS")}


def test_seed_storage_and_counts(spark, tmp_path):
    empty = spark.createDataFrame([], source.CANDIDATES)
    rows = source.seed(empty, [{"name": "Ada", "mail": "a@b.com"}, {"full_name": "Bob"}], 3)
    counted, seen = provider.observed(rows, "import")
    source.write_pool(counted, str(tmp_path / "pool"), "overwrite")
    assert seen.get == {"n_rows": 2, "n_redacted": 1}
    pool = source.read_pool(spark, str(tmp_path / "pool"))
    assert "a@b.com" not in json.dumps([r.source for r in pool.collect()])
    with pytest.raises(ValueError, match="empty"):
        source.seed(pool, [], 3)
    assert source.delete(pool, pool.filter("name = 'Bob'")).count() == 1 and source.ready(spark)
    assert source.storage("/data", "production") == ("file", True) and source.storage("jdbc:postgresql://h/d", "production") == ("postgresql", False)
    source.create_table(spark, "pool_of_tests")
    source.create_table(spark, "pool_of_tests")
    assert spark.table("pool_of_tests").count() == 0
    spark.sql("DROP TABLE pool_of_tests")


def test_hits_that_are_gone_are_dropped(spark):
    hits = spark.createDataFrame([("a", 1.0), ("gone", 0.9)], "id string, score double")
    assert [r.id for r in retrieve.known_hits(hits, spark.createDataFrame([("a",), ("a",)], "id string")).collect()] == ["a"]
