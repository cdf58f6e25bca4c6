import random
from collections import Counter, defaultdict

from conftest import rows

from graphloom.operators.ranks import running
from graphloom.operators.skew import dominant_keys, edge_key_results, key_results

OCC = "owner_path string, ordinal long, src string, kind string, dst string, line long, evidence string, confidence string, heavy string"


def data(n=3000):
    r = random.Random(2)
    out = []
    for i in range(n):
        dst = "hub" if r.random() < 0.4 else None if r.random() < 0.1 else f"d{r.randrange(300)}"
        out.append((f"f{i % 7}", i, f"s{r.randrange(50)}", r.choice(["calls", "imports"]), dst, None, None, None, "x"))
    return out


def test_key_results_match_plain_counting_with_repeats(spark):
    d = data()
    df = spark.createDataFrame(d + d[:500] * 3, OCC)
    n, src = Counter((x[3], x[4]) for x in d), defaultdict(set)
    for x in d:
        src[x[3], x[4]].add(x[2])
    want = sorted(((k, t, c, len(src[k, t])) for (k, t), c in n.items()), key=repr)
    assert rows(edge_key_results(df), "kind", "dst", "n_rows", "n_distinct") == want
    top = rows(dominant_keys(df), "kind", "dst")
    assert top == sorted(k for k, c in n.items() if k[1] is not None and c * 100 >= len(d))


def test_exactly_one_percent_is_a_case(spark):
    d = [("f", i, "s", "calls", "edge" if i == 0 else f"d{i}" if i > 2 else "two", None, None, None, "") for i in range(100)]
    assert ("calls", "edge") in rows(dominant_keys(spark.createDataFrame(d, OCC)), "kind", "dst")


def test_all_rows_one_key_null_values_and_empty(spark):
    df = spark.createDataFrame([(1, None, 1, None), (1, "a", 2, None), (1, "a", 3, None), (1, "a", 3, None), (1, "a", None, 3), (None, "b", 9, 9)], "k long, v string, i long, j long")
    assert rows(key_results(df, ["k"], ["i", "j"], "v"), "k", "n_rows", "n_distinct") == [(1, 4, 1), (None, 1, 1)]
    assert rows(key_results(df, ["k"], ["i", "j"]), "k", "n_rows", "n_distinct") == [(1, 4, None), (None, 1, None)]
    assert key_results(df.limit(0), ["k"], ["i"], "v").count() == 0
    assert dominant_keys(spark.createDataFrame([], OCC)).count() == 0


def test_running_sums_over_a_group_that_spans_partitions(spark):
    d = [("hot", i, i % 5) for i in range(400)] + [("cold", i, 2) for i in range(5)] + [(None, 1, None), (None, 2, 4)]
    got = {(r["g"], r["i"]): r["s"] for r in running(spark.createDataFrame(d, "g string, i long, v long"), ["g"], ["i"], value=None, out="s", partitions=16).collect()}
    assert got == {(g, i): i if g else i - 1 for g, i, _ in d}
    from pyspark.sql import functions as F

    summed = {(r["g"], r["i"]): r["s"] for r in running(spark.createDataFrame(d, "g string, i long, v long"), ["g"], ["i"], F.col("v"), "s", 16).collect()}
    assert summed["hot", 399] == sum(i % 5 for i in range(399)) and summed[None, 2] == 0 and summed["cold", 4] == 8


def test_only_keys_over_the_share_are_heavy_and_the_split_changes_no_count(spark):
    df = spark.createDataFrame(data(), OCC)
    n = Counter((x[3], x[4]) for x in data())
    for one_in in (1000, 20, 2):
        got = {(r["kind"], r["dst"]): r for r in edge_key_results(df, True).collect()} if one_in == 1000 else {(r["kind"], r["dst"]): r for r in key_results(df, ["kind", "dst"], ["owner_path", "ordinal"], "src", one_in).collect()}
        assert {k: r["n_rows"] for k, r in got.items()} == n
        assert {k for k, r in got.items() if r["heavy"]} == {k for k, c in n.items() if c * one_in >= len(data())}
