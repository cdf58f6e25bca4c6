import json
from datetime import datetime, timedelta

from conftest import rows

import pytest

from graphloom.operators.drift import consistent_table, field_changes, file_types, path_types, received_layouts

SCHEMA = "result_name string, series string, recorded_at timestamp_ntz, received_at timestamp_ntz, body string, path string"
T = datetime(2025, 1, 1)


def files(spark, *bodies, series="s"):
    data = [(f"{series}{i:02}", series, T + timedelta(days=i), T + timedelta(days=30 - i), b if b is None or isinstance(b, str) else json.dumps(b), "x") for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(params=[1000, 1, 2])
def chunk(request):
    return request.param


@pytest.fixture
def changes(spark, chunk):
    """Changes of a series of bodies, walked in chunks of several lengths."""
    return lambda _, *bodies: rows(field_changes(received_layouts(files(spark, *bodies)), chunk), "result_name", "field", "change")


def test_added_removed_renamed_retyped(spark, changes):
    got = changes(spark, {"a": 1, "b": "x", "o": {"p": 1, "q": [1]}}, {"a": "1", "c": "y", "o": {"p": 2, "q": [{"z": 1}]}}, {"a": "1", "o": {"p": 2.5, "r": True}})
    assert got == [("s01", "a", "retyped"), ("s01", "c", "renamed"), ("s02", "c", "removed"), ("s02", "o.q", "removed"), ("s02", "o.r", "added")]


def test_null_keeps_the_field_and_its_type(spark, changes):
    assert changes(spark, {"a": 1}, {"a": None}, {"a": 2}, {"a": None}, {"a": "x"}) == [("s04", "a", "retyped")]
    assert changes(spark, {"a": None}, {"a": 1}, {"a": "x"}) == [("s02", "a", "retyped")]


def test_a_field_that_comes_back_is_added_without_its_old_type(spark, changes):
    assert changes(spark, {"a": 1, "k": 1}, {"k": 1}, {"a": "x", "k": 1}) == [("s01", "a", "removed"), ("s02", "a", "added")]


def test_inside_a_changed_object_is_no_case(spark, changes):
    got = changes(spark, {"o": {"a": {"b": 1}}}, {"o": 3}, {"o": {"a": {"b": 1}}}, {"n": {"x": {"y": 1}}}, {"n": {"x": {"y": 1, "z": 2}}})
    assert got == [("s01", "o", "retyped"), ("s02", "o", "retyped"), ("s03", "n", "renamed"), ("s04", "n.x.z", "added")]


def test_two_of_a_type_are_no_rename(spark, changes):
    assert changes(spark, {"a": 1, "b": 2}, {"c": 1, "d": 2}) == [("s01", "a", "removed"), ("s01", "b", "removed"), ("s01", "c", "added"), ("s01", "d", "added")]


def test_a_null_run_over_chunks_keeps_the_type_before_it(spark, changes):
    assert changes(spark, {"a": 1}, *[{"a": None}] * 5, {"a": "x"}) == [("s06", "a", "retyped")]
    assert changes(spark, {"a": 1, "k": 1}, {"k": 1}, *[{"a": None, "k": 1}] * 4, {"a": "x", "k": 1}) == [("s01", "a", "removed"), ("s02", "a", "added")]


def test_layout_repeats_broken_and_null_bodies(spark):
    one = files(spark, {"a": 1, "b": 2}, '{"b": 5,\n "a": 7}', None, "[1]", "{broken", '{"a": NaN}', "", "{}", {"a": 1, "b": 2, "c": 3})
    f = received_layouts(one.union(one))
    assert rows(f, "result_name", "ord") == [("s00", 0), ("s01", 1), ("s07", 2), ("s08", 3)]
    assert rows(field_changes(f), "result_name", "field", "change") == [("s07", "a", "removed"), ("s07", "b", "removed"), ("s08", "a", "added"), ("s08", "b", "added"), ("s08", "c", "added")]
    assert field_changes(received_layouts(one.limit(0))).count() == 0


def test_odd_keys_and_long_texts(spark):
    f = received_layouts(files(spark, '{"a\\u0001b": 1, "\\ud800": 2, "": 3, "`q`": "' + "x" * 300_000 + '"}', {"": 3}))
    assert rows(field_changes(f), "field", "change") == sorted([("\ufffd", "removed"), ("`q`", "removed"), ("a\ufffdb", "removed")], key=repr)
    assert "`q`" in consistent_table(files(spark, {"`q`": 1}), received_layouts(files(spark, {"`q`": 1}))).columns


def test_types_columns_and_failed_casts(spark):
    given = files(spark, {"n": 1, "t": "x", "failed": True}, {"n": 2, "t": "y", "N": [1]}, {"n": "3", "t": "z"}, {"n": "many", "t": {"u": 1}, "rare": "r"})
    f = received_layouts(given)
    assert rows(path_types(f).filter("main"), "path", "type") == [("N", "array"), ("failed", "boolean"), ("n", "number"), ("rare", "string"), ("t", "string"), ("t.u", "number")]
    assert rows(file_types(f).filter("ord = 3"), "path", "type") == [("n", "string"), ("rare", "string"), ("t", "object"), ("t.u", "number")]
    t = consistent_table(given, f, share=0.5)
    assert t.schema["n"].dataType.simpleString() == "double" and t.columns == ["result_name", "series", "recorded_at", "n", "t", "other", "failed"]
    got = {r["result_name"]: r for r in t.collect()}
    assert got["s02"]["n"] == 3.0 and got["s03"]["n"] is None and got["s03"]["failed"] == ["n", "t"] and got["s00"]["t"] == "x"
    assert got["s03"]["other"] == {"rare": '"r"', "t.u": "1"} and got["s00"]["other"] == {"failed": "true"}
    assert consistent_table(given, f).columns == ["result_name", "series", "recorded_at", "N", "_failed", "_n", "rare", "t", "t.u", "other", "failed"]
