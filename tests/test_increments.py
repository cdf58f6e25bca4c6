from datetime import datetime

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators import increments
from graphloom.operators.increments import Ledger, gaps, intervals, merged, pending_files

A, B = "a" * 64, "b" * 64
INV = "snapshot_no long, delivered_at timestamp_ntz, path string, status string, digest string, size long, stream string"
FILES = "run_id long, indexed_at timestamp_ntz, path string, status string, digest string, seq long"
RUNS = "run_id long, repo string, outcome string"


def at(hour):
    return datetime(2025, 1, 1, hour)


def numbers(df):
    return {(r["stream"], n) for r in df.collect() for n in range(r["lo"], r["hi"] + 1)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), max_size=40), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), max_size=40))
def test_intervals_against_sets(spark, monkeypatch, available, processed):
    monkeypatch.setattr(increments, "BLOCK", 8)
    a = spark.createDataFrame(available, "stream string, seq long")
    p = spark.createDataFrame(processed, "stream string, seq long")
    ia, ip = intervals(a), intervals(p)
    assert numbers(ia) == set(available)
    assert numbers(gaps(ia, ip)) == set(available) - set(processed)
    both = merged(ia.select("stream", "lo", "hi").unionByName(ip.select("stream", "lo", "hi")))
    assert numbers(both) == set(available) | set(processed)
    assert sum(r["hi"] - r["lo"] + 1 for r in both.collect()) == len(set(available) | set(processed))


def test_pending_cases(spark):
    inv = spark.createDataFrame(
        [(1, at(1), "r/gone", None, A, 1, "x"), *[(2, at(2), p, None, d, 1, "x") for p, d in (("./r/new", A), ("r/same", "sha256:" + A.upper()), ("r/changed", B), ("r/failed", A), ("r/error", A), ("r/skipped", A), ("r/null", None), ("r/twice", B), ("r/nodigest", A))]],
        INV,
    )
    files = spark.createDataFrame(
        [(1, at(3), "r/same", "indexed", A, 0), (1, at(3), "r/changed", "indexed", A, 0), (2, at(4), "r/failed", "indexed", A, 0), (1, at(3), "r/error", "error", A, 0), (1, at(3), "r/skipped", "skipped", A, 0), (1, at(3), "r/twice", "indexed", A, 0), (3, at(5), "r/twice", "indexed", B, 0), (1, at(3), "r/nodigest", "indexed", None, 0), (1, at(3), None, "indexed", A, 0), (9, at(9), "r/same", "error", B, 0)],
        FILES,
    )
    runs = spark.createDataFrame([(1, "r", "succeeded"), (1, "r", "succeeded"), (2, "r", "failed"), (3, "r", "succeeded"), (4, "r", None)], RUNS)
    assert rows(pending_files(inv, files, runs), "path") == [("r/changed",), ("r/error",), ("r/failed",), ("r/new",), ("r/nodigest",)]
    assert rows(pending_files(inv, files.limit(0), runs.limit(0)), "path")[0] == ("r/changed",)
    assert pending_files(inv.limit(0), files, runs).count() == 0


def log(spark, ns):
    return spark.createDataFrame([(n, f"v{n}", "x") for n in ns], "n long, value string, stream string").drop("stream")


def test_ledger_survives_failures_and_takes_late_records_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), ["n", "value"], streams=2, compact_every=3)
    whole = lambda df: df
    first, more = log(spark, [1, 2, 5, 5, None]), log(spark, [3, 1, 2, 5, 6, 4, None])
    ledger.register(first, ["n"])
    with pytest.raises(RuntimeError):
        ledger.run(first, whole, fail_before_commit=True)
    assert ledger.output() is None
    ledger.run(first, whole)
    before = rows(ledger.numbered(first), "n", "stream", "seq")
    ledger.run(first, whole)
    ledger.register(more, ["n"])
    ledger.run(more, whole)
    assert rows(ledger.output(), "n") == sorted([(n,) for n in (None, 1, 2, 3, 4, 5, 6)], key=repr)
    assert {*before} < {*rows(ledger.numbered(first), "n", "stream", "seq")}
    assert numbers(ledger.processed()) == {(r["stream"], r["seq"]) for r in ledger.numbered(first).collect()}
    assert any("merged" in c["parts"] for c in ledger.commits())
    assert ledger.sweep(older_than=-5) == 1 and ledger.sweep(older_than=-5) == 0
    assert rows(ledger.output(), "n", "value")[0] == (1, "v1")


def test_another_log_has_the_last_word(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), ["n", "value"])
    three = log(spark, [1, 2, 3])
    ledger.register(three, ["n"])
    ledger.run(three, lambda df: df)
    ledger.adopt(log(spark, [2, 9]))
    assert rows(ledger.taken(three, ledger.open(three)), "n") == [(1,), (3,)]
    assert ledger.open(three.limit(0)).count() == 0


def test_ledger_refuses_a_number_taken_meanwhile(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), ["n", "value"])
    one = log(spark, [1])
    ledger.register(one, ["n"])

    def meanwhile(df):
        Ledger(spark, ledger.root, ["n", "value"]).run(one, lambda x: x)
        return df

    with pytest.raises(FileExistsError):
        ledger.run(one, meanwhile)
    assert rows(ledger.output(), "n") == [(1,)]


def test_gaps_decide_what_is_pending(spark, monkeypatch):
    """The listing knows nothing of the log but through the intervals: without the subtraction all files are pending."""
    inv = spark.createDataFrame([(1, at(1), "r/done", None, A, 1, "x"), (1, at(1), "r/new", None, A, 1, "x")], INV)
    files = spark.createDataFrame([(1, at(3), "r/done", "indexed", A, 0)], FILES)
    runs = spark.createDataFrame([(1, "r", "succeeded")], RUNS)
    assert rows(pending_files(inv, files, runs), "path") == [("r/new",)]
    monkeypatch.setattr(increments, "gaps", lambda available, processed: available)
    assert len(rows(pending_files(inv, files, runs), "path")) == 2


def test_a_version_that_comes_back_is_pending_again(spark, tmp_path):
    runs = spark.createDataFrame([(1, "r", "succeeded"), (2, "r", "succeeded")], RUNS)
    inv = [(1, at(1), "r/a", None, A, 1, "x"), (2, at(2), "r/a", None, B, 1, "x"), (3, at(5), "r/a", None, A, 1, "x")]
    writes = [(1, at(1), "r/a", "indexed", A, 0), (2, at(3), "r/a", "indexed", B, 0)]
    root = str(tmp_path / "kept")
    got = [rows(pending_files(spark.createDataFrame(inv[:n], INV), spark.createDataFrame(writes[:k], FILES), runs, root), "path", "seq") for n, k in ((1, 1), (2, 1), (2, 2), (3, 2))]
    assert [len(g) for g in got] == [0, 1, 0, 1]


def test_replay_takes_every_version_once(spark):
    inv = spark.createDataFrame([(1, at(1), "r/a", None, A, 1, "x"), (2, at(4), "r/a", None, B, 1, "x"), (1, at(9), "r/late", None, A, 1, "x"), (2, None, "r/b", None, A, 1, "x"), (2, at(9), "r/b", None, None, 1, "x"), (3, at(9), "r/a", None, A, 1, "x")], INV)
    got = increments.replayed(inv, [at(3), at(6)])
    assert rows(got, "run", "path", "digest") == [(1, "r/a", A), (1, "r/b", A), (2, "r/a", B), (3, "r/late", A)]
    assert increments.replayed(inv.limit(0), [at(3)]).count() == 0
