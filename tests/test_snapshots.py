import random
from datetime import datetime

from conftest import rows

from graphloom.operators.snapshots import SnapshotStore, change_counts, snapshot_changes

SCHEMA = "snapshot_no long, delivered_at timestamp_ntz, path string, status string, digest string, size long, repo string"
A, B = "a" * 64, "b" * 64


def at(hour):
    return datetime(2025, 1, 1, hour)


def found(spark, data):
    return rows(snapshot_changes(spark.createDataFrame([(*r, "x") for r in data], SCHEMA)), "snapshot_no", "path", "change")


def test_added_removed_changed_and_spellings(spark):
    data = [
        (1, at(1), "r/a", None, A, 1), (1, at(1), "r/b", None, A, 1), (1, at(1), "r/c", None, None, None), (1, at(1), "r/same", None, A, None),
        (2, at(2), "./r/a", None, "SHA256:" + A.upper(), 1), (2, at(2), "r\\b", None, B, 1), (2, at(2), "r/c", None, None, 3), (2, at(2), "r/new", None, A, 1), (2, at(2), "r/same", None, A, None),
        (4, at(4), "r/a", None, A, 1),
    ]
    assert found(spark, data) == [(2, "r/b", "changed"), (2, "r/c", "changed"), (2, "r/new", "added"), (4, "r/b", "removed"), (4, "r/c", "removed"), (4, "r/new", "removed"), (4, "r/same", "removed")]


def test_gap_of_a_path_and_of_a_repository(spark):
    data = [(1, at(1), "r/a", None, A, 1), (1, at(1), "r/z", None, A, 1), (2, at(2), "r/z", None, A, 1), (3, at(3), "r/a", None, A, 1), (3, at(3), "r/z", None, A, 1), (1, at(1), "q/a", None, A, 1), (3, at(3), "q/a", None, B, 1)]
    assert found(spark, data) == [(2, "r/a", "removed"), (3, "q/a", "changed"), (3, "r/a", "added")]


def test_latest_delivery_holds_and_repeats_count_once(spark):
    data = [(1, at(1), "r/a", None, A, 1)] * 3 + [(2, at(2), "r/a", None, B, 1), (2, at(5), "r/a", None, A, 1), (2, None, "r/a", None, B, 9)]
    assert found(spark, data) == []


def test_ties_nulls_and_empty(spark):
    assert found(spark, []) == []
    data = [(None, at(1), "r/a", None, A, 1), (1, at(1), None, None, A, 1), (1, at(1), "r/a", None, A, 1), (1, at(1), "r/a", None, B, 1), (2, at(1), "r/a", None, B, 1)]
    assert found(spark, data) == []


def test_long_paths_and_counts(spark):
    long = "r/" + "x" * 20_000
    data = [(1, at(1), "r/a", None, A, 1), (2, at(2), "r/a", None, A, 1), (2, at(2), long, None, A, 1)]
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    assert rows(change_counts(snapshot_changes(df))) == [("r", 2, "added", 1)]


def brute(rows):
    held = {}
    for no, when, path, digest, size in sorted(rows, key=lambda r: (r[1], r[3] or "", r[4] or 0)):
        held[(path, no)] = (digest, size)
    out = set()
    for repo in {p.split("/")[0] for p, _ in held}:
        numbers = sorted({n for p, n in held if p.split("/")[0] == repo})
        for a, b in zip(numbers, numbers[1:]):
            for p in {p for p, n in held if p.split("/")[0] == repo and n in (a, b)}:
                x, y = held.get((p, a)), held.get((p, b))
                if x != y:
                    out.add((b, p, "added" if x is None else "removed" if y is None else "changed"))
    return sorted(out, key=repr)


def test_deliveries_merged_into_a_kept_store(spark, tmp_path):
    rng = random.Random(5)
    deliveries = []
    for k in range(4):
        # the last delivery holds late rows of early snapshots and repeats
        numbers = (1, 2) if k == 3 else (k + 1, k + 2)
        deliveries.append([(n, at(k + 1), f"{rng.choice('qr')}/{rng.randrange(12)}", rng.choice((A, B)), rng.choice((1, 2))) for n in numbers for _ in range(14)])
    store, so_far = SnapshotStore(spark, str(tmp_path / "store"), ranges=3), []
    for d in deliveries:
        before = {*brute(so_far)}
        so_far += d
        part = store.load(spark.createDataFrame([(r[0], r[1], r[2], None, r[3], r[4], "x") for r in d], SCHEMA))
        now = brute(so_far)
        assert rows(store.changes(), "snapshot_no", "path", "change") == now
        touched = rows(store.changes(part), "snapshot_no", "path", "change")
        assert {*now} - before <= {*touched} <= {*now}
    again = SnapshotStore(spark, str(tmp_path / "store"))
    assert rows(again.changes(), "snapshot_no", "path", "change") == now
    assert not [x for x in again.rows()._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert SnapshotStore(spark, str(tmp_path / "none")).changes().count() == 0
