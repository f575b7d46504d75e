import json

from rosterlake.operators import nested

DEEP = {"n": 1}
for _ in range(60):
    DEEP = {"n": DEEP}

RECORDS = [
    ("a", json.dumps({"x": {"y": [{"z": 1}, 2, {"z": {}}]}, "e": {}, "c": [[["deep"], [{"l": 3}]]], "s": '{"no": {}}'})),
    ("b", '{"k": {"v": 1}, "k": {"v": {"w": 2}}}'),
    ("c", None), ("d", "{}"), ("e", '{"cut": {"of'), ("f", "[1, {\"a\": 1}]"), (None, '{"p": {}}'),
    ("a", json.dumps({"x": {"y": [{"z": 1}, 2, {"z": {}}]}, "e": {}, "c": [[["deep"], [{"l": 3}]]], "s": '{"no": {}}'})),
    ("g", json.dumps({"m": DEEP})), ("h", json.dumps({"t": "x" * 200_000, "o": {"q": "y" * 200_000}})),
]


def _frame(spark, rows=RECORDS):
    return spark.createDataFrame([(i, s, "clash", 7) for i, s in rows], "id string, source string, node_path string, kind int")


def test_every_object_with_its_parent(spark):
    got = {tuple(r)[:3] for r in nested.nodes(_frame(spark), "id", "source").collect()}
    mine = {(p, q) for i, p, q in got if i == "a"}
    assert mine == {("x", ""), ("x.y[0]", "x"), ("x.y[2]", "x"), ("x.y[2].z", "x.y[2]"), ("e", ""), ("c[0][1][0]", "")}


def test_last_of_repeated_keys_holds(spark):
    got = {(r.node_path, r.parent_path) for r in nested.nodes(_frame(spark), "id", "source").collect() if r.id == "b"}
    assert got == {("k", ""), ("k.v", "k")}


def test_what_is_no_record_gives_nothing_and_depth_is_free(spark):
    rows = nested.nodes(_frame(spark), "id", "source").collect()
    ids = [r.id for r in rows]
    assert not {"c", "d", "e", "f"} & set(ids)
    assert None in ids
    assert ids.count("g") == 61
    assert ids.count("a") == 12


def test_ordinals_and_kinds(spark):
    rows = {r.node_path: (r.kind, r.ordinal) for r in nested.nodes(_frame(spark), "id", "source").collect() if r.id == "a"}
    assert rows["x.y[2]"] == ("x.y[]", 2)
    assert rows["x.y[2].z"] == ("x.y[].z", None)
    assert rows["c[0][1][0]"] == ("c[][][]", 0)


def test_child_tables_link_to_parents(spark):
    rows = [("a", '{"jobs": [{"firm": "X", "years": 3, "tags": ["p"]}, {"firm": "Y", "years": "4"}]}'), ("b", '{"jobs": {"firm": "Z"}}')]
    tables = nested.child_tables(_frame(spark, rows), "id", "source")
    assert set(tables) == {"jobs", "jobs[]"}
    jobs = sorted((r.node_path, r.f_firm, r.f_years__number, r.f_years__string, r.f_tags__array) for r in tables["jobs[]"].collect())
    assert jobs == [("jobs[0]", "X", 3, None, '["p"]'), ("jobs[1]", "Y", None, "4", None)]
    assert [r.f_firm for r in tables["jobs"].collect()] == ["Z"]


def test_child_tables_keep_every_scalar(spark):
    rows = [("a", '{"name": "A", "skills": ["x", "y"], "m": {"c": [[1, {"l": 3}], ["z"]], "stack": ["p"]}}'), ("b", '{"name": "B", "m": {"stack": ["q", {"w": 1}]}}')]
    tables = nested.child_tables(_frame(spark, rows), "id", "source")
    assert sorted((r.id, r.node_path, r.f_name, r.f_skills__array) for r in tables[""].collect()) == [("a", "", "A", '["x","y"]'), ("b", "", "B", None)]
    assert sorted((r.id, r.f_c__array, r.f_stack__array) for r in tables["m"].collect()) == [("a", '[[1,null],["z"]]', '["p"]'), ("b", None, '["q",null]')]


def test_keys_link_each_row_to_its_parent(spark):
    rows = nested.nodes(_frame(spark), "id", "source", keep=True).collect()
    keys = {(r.id, r.node_path): r.row_key for r in rows}
    assert len(set(keys.values())) == len(keys)
    assert all(r.parent_key == keys[r.id, r.parent_path] for r in rows if r.node_path)
    assert all(r.parent_key is None for r in rows if not r.node_path)


def test_numbers_are_kept_exactly(spark):
    big, huge = 9007199254740993, 10**30 + 1
    rows = [("a", f'{{"o": {{"i": {big}, "d": {huge}, "m": 1, "x": 0.5, "n": NaN}}}}'), ("b", f'{{"o": {{"i": 4, "d": 5, "m": 2.5, "x": {big}}}}}')]
    table = nested.child_tables(_frame(spark, rows), "id", "source")["o"]
    got = {r.id: r for r in table.collect()}
    assert (got["a"].f_i, got["b"].f_i) == (big, 4)
    assert (int(got["a"].f_d), int(got["b"].f_d)) == (huge, 5)
    assert (got["a"].f_m, got["b"].f_m) == (1.0, 2.5)
    assert (got["a"].f_x__number, got["a"].f_x__integer, got["b"].f_x__integer) == (0.5, None, big)


def test_only_places_of_the_merged_schema_are_opened(spark):
    shape = nested.infer_shape(_frame(spark, [("a", '{"x": {"y": [1, {"z": 2}]}, "t": ["u"]}')]), "source")
    assert shape.places() == ((("x", ((("y", ((), ((), None))),), None)),), None)


def test_empty_table(spark):
    empty = _frame(spark).limit(0)
    assert nested.nodes(empty, "id", "source").count() == 0
    assert nested.child_tables(empty, "id", "source") == {}
