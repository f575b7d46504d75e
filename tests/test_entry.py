import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings candidates import_requests ranking_payloads baseline_verdicts eval_items".split()
CORE = [n for n in entry.oracle_sql()]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", CORE)
def test_sql_gives_the_same_rows(spark, con, small, name):
    a, b = entry.queries()[name](spark, small).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda d: sorted(tuple(map(_plain, r)) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False))
    assert key(a) == key(b)
