import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.operators import commitments, delta, diagnostics, duplicates, graph, paging, routes, selectors, traversal
from graphloom.plans import catalogue
from graphloom.streaming import edges as stream

NODE = "id string, kind string, name string, qualname string, path string, line long, end_line long, is_test boolean, language string, generated boolean, details string, owner_path string, extra string"
OCC = "owner_path string, ordinal long, src string, kind string, dst string, line long, evidence string, confidence string, id string"


def make(spark, pairs, tests=(), kind="calls", nodes=None):
    ids = sorted({x for p in pairs for x in p if x} | set(nodes or ()))
    n = [(i, "function", i, f"m.{i}", f"r/{i}.py", 1, 9, i in tests, "python", False, '{"is_public":true}', f"r/{i}.py", "") for i in ids]
    o = [(f"r/{a}.py", k, a, kind, b, k, None, "exact", "") for k, (a, b) in enumerate(pairs)]
    return graph.graph(spark.createDataFrame(n + n[:1], NODE), spark.createDataFrame(o + o[:2], OCC))


def test_edges_count_occurrences_and_keep_the_first(spark):
    o = spark.createDataFrame([("f", 2, "a", "calls", "b", 7, "late", None, ""), ("f", 1, "a", "calls", "b", None, None, "exact", ""), ("e", 9, "a", "calls", "b", 3, "other", None, ""), ("f", 3, "a", "calls", None, 1, None, None, "")], OCC)
    assert rows(graph.edge_table(o), "src", "dst", "occurrence_count", "path", "line") == [("a", "b", 3, "e", 3)]


def test_reach_has_least_distance_and_least_predecessor(spark):
    g = make(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f")])
    seeds = spark.createDataFrame([("a",), ("a",)], "id string")
    assert rows(traversal.impact(g, seeds, depth=3, inbound=False), "id", "distance", "via") == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")]
    with pytest.raises(ValueError):
        traversal.impact(g, seeds, depth=2, inbound=False, frontier_cap=1)
    assert traversal.impact(g, seeds.limit(0)).count() == 0


def test_modes_of_traversal():
    assert traversal.kinds_of("data-flow") == (set(graph.DATA_FLOW), set())
    assert traversal.kinds_of("calls", ["CALLS", "Decorates"]) == ({"calls"}, {"decorates"})
    assert traversal.kinds_of("no such mode") == traversal.kinds_of("calls")


def test_waves_and_circles(spark):
    t = spark.createDataFrame([(x,) for x in "abcdexy"], "id string")
    n = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "zz"), ("x", "y"), ("y", "x"), ("e", "x")], "id string, needs string")
    assert rows(traversal.waves(t, n)) == sorted([("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", None), ("x", None), ("y", None)], key=repr)


def test_public_untested_and_covering_tests(spark):
    g = make(spark, [("t", "a"), ("a", "b"), ("b", "a"), ("c", "b")], tests={"t"})
    assert rows(traversal.public_untested(g), "id") == [("c",)]
    assert rows(traversal.covering_tests(g, ("calls",))) == [("a", "t", 1), ("b", "t", 2)]


def test_delta_equals_cold_build(spark):
    r = random.Random(3)
    occ = [(f"f{r.randrange(9)}", i, f"n{r.randrange(8)}", r.choice(["calls", "imports"]), r.choice([None, *[f"n{k}" for k in range(8)]]), i, None, None, "") for i in range(300)]
    new = [x for x in occ if x[0] != "f1" and not (x[0] == "f2" and x[1] % 2)] + [("f9", i, "n1", "calls", f"n{i % 8}", i, None, None, "") for i in range(20)]
    a, b = spark.createDataFrame(occ, OCC), spark.createDataFrame(new, OCC)
    owners = spark.createDataFrame([("f1",), ("f2",), ("f9",)], "owner_path string")
    assert rows(delta.refresh_edges(graph.edge_table(a), a, b, owners)) == rows(graph.edge_table(b))
    assert rows(delta.replace_owners(a, b, owners)) == rows(b)


def test_commitments_do_not_depend_on_order_and_show_changes(spark):
    g = make(spark, [("a", "b"), ("b", "c")])
    leaves = commitments.graph_leaves(g.nodes, g.occurrences)
    moved = commitments.graph_leaves(g.nodes.repartition(7, "name").sortWithinPartitions(F.desc("id")), g.occurrences.repartition(3))
    root = lambda x: commitments.root(commitments.domain_digests(x), {"schema": "1"}).first()[0]
    assert root(leaves) == root(moved)
    changed = commitments.graph_leaves(g.nodes.withColumn("line", F.when(F.col("id") == "b", 5).otherwise(F.col("line"))), g.occurrences)
    assert root(leaves) != root(changed)
    assert rows(commitments.verify(leaves, changed)) == [("nodes", "r/b.py", "different")]
    assert root(commitments.reseal(leaves, changed.filter("owner_path = 'r/b.py'" if "owner_path" in changed.columns else "owner = 'r/b.py'"))) == root(changed)


def test_pages_join_to_the_whole(spark):
    df = spark.range(65).withColumn("t", F.lit("x"))
    seen, offset = [], 0
    while offset is not None:
        p = paging.page(df, ["id"], offset, 20, "generation-1", "generati" if offset else None)
        seen += [x["id"] for x in p["items"]]
        assert p["total"] == 65
        offset = p["next_offset"]
    assert seen == list(range(65))
    with pytest.raises(paging.StaleGeneration):
        paging.page(df, ["id"], 20, 20, "generation-2", "generation-1")
    assert paging.bounded_total(df, 50) is None and paging.bounded_total(df) == 65
    assert len(paging.trimmed(paging.page(df, ["id"], 0, 20), 60)["items"]) < 20


@pytest.mark.parametrize("bad", ["drop table t", "select 1; drop table t", "insert into t values (1)", "with a as (select 1) insert into t select * from a", "select * from parquet.`/tmp/x`", "", "set x=1"])
def test_sql_guard_rejects(spark, bad):
    with pytest.raises(Exception):
        paging.read_only(spark, bad)


def test_sql_guard_allows(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert rows(paging.query(spark, "/* x */ -- y\n with q as (select a from t) select a + 1 as b from q", {"t": df})) == [(2,)]


def test_selectors(spark):
    g = make(spark, [("a", "b")])
    assert selectors.select(g.nodes, "a") == "a"
    assert selectors.select(g.nodes, "r/b.py:4") == "b"
    assert selectors.select(g.nodes, "r/b.py:b") == "b"
    assert selectors.select(g.nodes, "function:a") == "a"
    assert selectors.select(g.nodes, "m.b") == "b"
    with pytest.raises(selectors.NotFound):
        selectors.select(g.nodes, "nothing")
    two = g.nodes.unionByName(g.nodes.withColumn("id", F.concat(F.lit("z"), "id")))
    with pytest.raises(selectors.Ambiguous):
        selectors.select(two, "m.b")


def test_near_clones(spark):
    body = [f"line {i}" for i in range(10)]
    data = [("f", "1", body), ("f", "2", body), ("f", "3", body[:8] + ["x", "y"]), ("f", "4", body[:7] + ["x", "y", "z"]), ("g", "5", body), (None, "6", body), (None, "7", body)]
    df = spark.createDataFrame(data, "name string, id string, body array<string>")
    assert rows(duplicates.near_clones(df), "name", "cluster", "id") == sorted([("f", "1", "1"), ("f", "1", "2"), ("f", "1", "3"), (None, "6", "6"), (None, "6", "7")], key=repr)


def test_near_clones_against_all_heads(spark):
    r = random.Random(8)
    data = []
    for i in range(120):
        body = [f"l{k}" for k in range(r.choice([1, 2, 3, 4, 5, 7, 10, 20]))]
        for _ in range(r.randrange(3)):
            body[r.randrange(len(body))] = r.choice("xyz")
        data.append(("f", f"{i:03}", body + ["e"] * r.randrange(2)))
    want, heads = {}, []
    for _, i, body in data:
        for head_id, head in heads:
            n = max(len(head), len(body))
            if min(len(head), len(body)) >= 0.8 * n and sum(a == b for a, b in zip(head, body)) >= 0.8 * n:
                break
        else:
            head_id = i
            heads.append((i, body))
        want.setdefault(head_id, []).append(i)
    got = duplicates.near_clones(spark.createDataFrame(data, "name string, id string, body array<string>"))
    assert rows(got, "cluster", "id") == sorted((c, i) for c, own in want.items() if len(own) > 1 for i in own)


def test_routes_and_scopes(spark):
    urls = spark.createDataFrame([("/api/users/42?x=1",), ("/api/users/me",), ("/api/none/1/2",), (None,)], "url string")
    known = spark.createDataFrame([("/api/users/{id}",), ("/api/users/me",), ("/api/:kind/42",)], "route string")
    assert rows(routes.match_routes(urls, known), "client", "route") == [("/api/users/42?x=1", "/api/users/{param}"), ("/api/users/me", "/api/users/me")]
    s = spark.createDataFrame([("t1", "src/a/**"), ("t2", "src/a/b"), ("t3", "src/ab"), ("t4", None)], "owner string, scope string")
    assert rows(routes.scope_overlaps(s)) == [("t1", "t2")]


def test_coverage_health_is_null_without_references_inside(spark):
    g = make(spark, [("a", "external:x")], nodes=["a"])
    assert rows(diagnostics.by_language(diagnostics.coverage(g)), "health") == [(None,)]


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(4)
    part = lambda names, seed: [(f"f{n}", i, f"n{random.Random(seed + i).randrange(5)}", "calls", f"n{r.randrange(5)}", i, None, None) for n in names for i in range(20)]
    schema = stream.OCCURRENCES
    one, two = part([1, 2, 3], 1), part([3, 4], 9)
    two += [("f5", 0, "n1", "calls", None, 1, None, None), ("f5", 1, None, "calls", "n1", 1, None, None)] + two[:3]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    for data in (one, two):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream.maintain(spark, source, root, str(tmp_path / "check")).awaitTermination()
    from graphloom.sources.workspace import current

    final = spark.createDataFrame([x for x in one if x[0] != "f3"] + two, schema)
    assert rows(stream.maintained(spark, root, "edges")) == rows(graph.edge_table(final.dropDuplicates(["owner_path", "ordinal"])))
    assert stream.maintained(spark, root, "occurrences").count() == 20 * 4 + 2
    at = current(spark, root)
    stream.apply_batch(spark, root, final.limit(0), 0)
    assert current(spark, root) == at
    # an owner with fewer rows takes its old ones out, and shards that are not touched stay where they are
    stream.apply_batch(spark, root, spark.createDataFrame([("f4", 0, "n0", "calls", "n9", 1, None, None)], schema), at["batch"] + 1)
    left = [x for x in one if x[0] in ("f1", "f2")] + [x for x in two if x[0] in ("f3", "f5")] + [("f4", 0, "n0", "calls", "n9", 1, None, None)]
    assert rows(stream.maintained(spark, root, "edges")) == rows(graph.edge_table(spark.createDataFrame(left, schema).dropDuplicates(["owner_path", "ordinal"])))
    moved = {s for s, p in current(spark, root)["occurrences"].items() if at["occurrences"].get(s) != p}
    assert len(moved) <= 1


def test_streaming_windows(spark, tmp_path, small):
    events = spark.read.parquet(small + "/events.parquet")
    name = "windows_of_a_test"
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = stream.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table(name).count() == stream.event_counts(events).count()


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = catalogue.queries()["p3_found"]
    assert plan is not None
    from graphloom.operators.hierarchy import containment_links

    df = containment_links(spark.read.parquet(small + "/edge_occurrences.parquet"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,contains)" in text and "ReadSchema: struct<src:string,kind:string,dst:string>" in text


def test_details_may_be_null_or_broken(spark):
    df = spark.createDataFrame([("a", None), ("b", "{broken"), ("c", json.dumps({"is_public": 1})), ("d", "{}")], "id string, details string")
    assert rows(df.filter(graph.is_public()), "id") == [("c",)]
