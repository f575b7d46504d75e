import json
from datetime import datetime

from rosterlake.operators import drift


def _tables(spark, files, extra=()):
    """files: (request_id, feed, day, records)."""
    rows, requests = [], []
    for rid, feed, day, records in files:
        requests.append((rid, feed, datetime(2024, 1, day), "accepted", None, "clash"))
        rows += [(rid, n, json.dumps(r) if isinstance(r, dict) else r, "clash") for n, r in enumerate(records)]
    requests += list(extra)
    c = spark.createDataFrame(rows, "request_id long, record_no int, source string, kind string")
    q = spark.createDataFrame(requests, "request_id long, feed string, exported_at timestamp, status string, candidates string, field_name string")
    return drift.records(c, q), q


def _changes(spark, *args):
    every, requests = _tables(spark, *args)
    return {tuple(r) for r in drift.changes(every, requests).collect()}


def test_added_removed_and_absence_between(spark):
    files = [(1, "f", 1, [{"a": 1, "b": "x"}]), (2, "f", 2, [{"a": 1}]), (3, "f", 3, [{"a": 1, "b": "x", "c": True}]), (4, "f", 4, [{"a": 2, "b": None}])]
    assert _changes(spark, files) == {("f", 3, "added", "c", ""), ("f", 4, "removed", "c", ""), ("f", 4, "removed", "b", "")}


def test_type_changes_by_majority(spark):
    files = [(1, "f", 1, [{"a": 1}, {"a": "x"}, {"a": 2}]), (2, "f", 2, [{"a": "1"}, {"a": "2"}, {"a": 3}]), (3, "f", 3, [{"a": [1]}])]
    assert _changes(spark, files) == {("f", 2, "type_changed", "a", ""), ("f", 3, "type_changed", "a", "")}


def test_renamed_needs_the_same_content(spark):
    mails = lambda k, n: [{k: f"p{i}@mail{n}.example", "z": i} for i in range(4)]
    files = [(1, "f", 1, mails("email", 1)), (2, "f", 2, mails("mail", 2))]
    assert _changes(spark, files) == {("f", 2, "renamed", "email", "mail")}
    other = [(1, "f", 1, mails("email", 1)), (2, "f", 2, [{"flag": True, "z": 1}])]
    assert _changes(spark, other) == {("f", 2, "removed", "email", ""), ("f", 2, "added", "flag", "")}


def test_order_is_of_export_and_feeds_are_apart(spark):
    files = [(9, "f", 1, [{"a": 1}]), (1, "f", 2, [{"a": 1, "b": 1}]), (5, "g", 1, [{"b": 1}])]
    assert _changes(spark, files) == {("f", 1, "added", "b", "")}


def test_bodies_repeats_and_bad_records(spark):
    body = json.dumps({"candidates": [{"a": "x", "n": 1}, 5, None]})
    pending = [(7, "f", datetime(2024, 2, 1), "pending", body, ""), (7, "f", datetime(2024, 2, 1), "pending", body, ""), (8, "f", datetime(2024, 2, 2), "pending", "{cut", "")]
    files = [(1, "f", 1, [{"a": "x"}, None, "{}", "not json", "[1]"])]
    assert _changes(spark, files, pending) == {("f", 7, "added", "n", ""), ("f", 8, "removed", "a", ""), ("f", 8, "removed", "n", "")}


def test_consistent_table_has_a_branch_for_each_type(spark):
    every, requests = _tables(spark, [(1, "f", 1, [{"a": 1, "b": {"c": 1}}]), (2, "f", 2, [{"a": "x"}])])
    rows = {r.request_id: r for r in drift.consistent_table(every, requests).collect()}
    assert rows[1].a == "1" and rows[1].a__number == 1.0 and rows[1].a__string is None and rows[1].b == '{"c": 1}'
    assert rows[2].a__string == "x" and rows[2].a__kind == "string" and rows[2].b is None


def test_empty_tables(spark):
    every, requests = _tables(spark, [(1, "f", 1, [{"a": 1}])])
    none = drift.records(spark.createDataFrame([], "request_id long, record_no int, source string"), requests.limit(0))
    assert drift.changes(none, requests.limit(0)).count() == 0
