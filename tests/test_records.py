from datetime import datetime

from conftest import rows

from graphloom.operators import records

MESSAGES = "id long, recipient string, topic string, status string, created_at timestamp_ntz, payload string, place string"


def at(hour):
    return datetime(2025, 1, 1, hour)


def messages(spark):
    data = [(1, "a", "x", "active", at(3), "p", ""), (2, "a", "x", "active", at(1), "p", ""), (2, "a", "x", "active", at(1), "p", ""), (3, "a", "y", "withdrawn", at(1), "p", ""), (4, "b", "x", "active", None, None, ""), (5, None, "x", "active", at(2), "p", ""), (6, "a", "x", "active", at(3), "p", "")]
    return spark.createDataFrame(data, MESSAGES).drop("place")


def test_newest_leaves_payloads_and_breaks_ties(spark):
    got = records.newest(messages(spark), ["topic"], top=2)
    assert "payload" not in got.columns
    assert rows(got, "topic", "id", "place") == [("x", 1, 2), ("x", 6, 1), ("y", 3, 1)]
    assert records.newest(messages(spark).limit(0), ["topic"]).count() == 0


def test_inbox_and_marking_as_read(spark):
    m = messages(spark)
    assert rows(records.inbox(m), "recipient", "id", "place") == [("a", 1, 2), ("a", 2, 1), ("a", 6, 3), ("b", 4, 1)]
    none = spark.createDataFrame([], "recipient string, id long")
    read = records.marked_read(none, m, spark.createDataFrame([("a", at(2)), ("b", at(9))], "recipient string, created_at timestamp_ntz"))
    assert rows(read) == [("a", 2), ("a", 3)]
    assert rows(records.marked_read(read, m, spark.createDataFrame([("a", at(2))], "recipient string, created_at timestamp_ntz"))) == [("a", 2), ("a", 3)]
    assert rows(records.inbox(m, read), "id") == [(1,), (4,), (6,)]


def test_unmet_dependencies(spark):
    tasks = spark.createDataFrame([("a", "ready"), ("b", "completed"), ("c", None)], "task_id string, status string")
    deps = spark.createDataFrame([("a", "b", False), ("a", "c", None), ("a", "z", False), ("b", "c", True), ("a", "z", False)], "task_id string, dependency_id string, satisfied boolean")
    assert rows(records.unmet(tasks, deps)) == [("a", "c", True), ("a", "z", False)]
    assert records.unmet(tasks.limit(0), deps.limit(0)).count() == 0


def test_views_and_parity(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "key long, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "key long, v string")
    assert rows(records.merged_view(a, b, "key", ["v"])) == [(1, "x", "declared"), (2, "y", "both"), (3, "z", "stored")]
    assert rows(records.parity(a.union(a), a.union(b))) == sorted([(1, "x", "declared"), (2, None, "declared"), (2, "y", "stored"), (3, "z", "stored")], key=repr)
    assert rows(records.with_prefix(a.withColumn("k", a["v"]), "k", "x"), "key") == [(1,)]
    assert records.scoped(a, v=None).count() == 2 and records.scoped(a, v="x").count() == 1
