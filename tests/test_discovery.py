import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import rows

from graphloom.operators import graph, traversal, walks
from graphloom.plans import catalogue
from graphloom.session import shared_dir

NODE = "id string, kind string, name string, qualname string, path string, line long, end_line long, is_test boolean, details string"
OCC = "owner_path string, ordinal long, src string, kind string, dst string, line long, evidence string, confidence string"


def small_graph(spark):
    case, chain = '{"test_role": "test_case"}', [f"f{i}" for i in range(8)]
    nodes = [(x, "function", x, x, "src/a.py", i, i, False, "{}") for i, x in enumerate(chain)]
    nodes += [("t", "function", "test_all", "test_all", "tests/a.py", 1, 2, True, case), ("h", "function", "helper", "helper", "tests/a.py", 5, 6, True, "{}")]
    nodes += [("p", "function", "parseFile", "parseFile", "src/p.py", 1, 2, False, None), ("tp", "function", "test_parse_file", "x", "tests/p.py", 1, 2, True, case), ("q", "function", "reparse_file", "y", "tests/q.py", 1, 2, True, case)]
    calls = [*zip(chain, chain[1:]), ("f7", "f0"), ("t", "f0"), ("h", "f6"), ("t", "gone"), ("t", "h")]
    occ = [("o", i, a, "calls", b, 1, "", "exact") for i, (a, b) in enumerate(calls)]
    return graph.graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(occ, OCC))


def test_tests_at_any_depth_and_by_name(spark):
    g = small_graph(spark)
    got = traversal.discovered(g, g.nodes.filter("NOT is_test"))
    want = [(f"f{i}", "t", "direct" if i == 0 else "transitive", i + 1, " > ".join(["t", *(f"f{j}" for j in range(i + 1))])) for i in range(6)]
    want += [("f6", "t", "transitive", 2, "t > h > f6"), ("f7", "t", "transitive", 3, "t > h > f6 > f7"), ("p", "tp", "lexical_fallback", None, None)]
    assert rows(got, "id", "other", "relation", "distance", "path") == sorted(want, key=repr)


def test_code_that_a_test_calls(spark):
    g = small_graph(spark)
    got = {r["other"]: r["distance"] for r in traversal.discovered(g, g.nodes.filter("id = 't'"), inbound=False).collect()}
    assert got == {"f0": 1, "f1": 2, "f2": 3, "f3": 4, "f4": 5, "f5": 6, "f6": 2, "f7": 3}


def test_pairs_of_all_callables_against_a_plain_search(spark, small):
    g = graph.load(spark, small)
    back = {}
    for a, b in g.keys.filter("kind = 'calls'").select("src", "dst").collect():
        back.setdefault(b, set()).add(a)
    nodes = {r["id"]: r for r in g.nodes.select("id", "kind", "is_test").collect()}
    want = set()
    for s in [x for x, r in nodes.items() if r["kind"] in graph.CALLABLE]:
        seen, todo, d = {s}, [s], 0
        while todo:
            d, todo = d + 1, sorted({y for x in todo for y in back.get(x, ()) if y in nodes} - seen)
            seen.update(todo)
            want |= {(s, y, d) for y in todo if nodes[y]["is_test"]}
    got = catalogue.queries()["discovered_tests"](spark, small).filter("relation <> 'lexical_fallback'")
    assert set(rows(got, "id", "other", "distance")) == want and max(d for *_, d in want) > 3


def tied_graph(spark, n=60):
    """Callables in a circle with shortcuts, so that many shortest paths tie; their order is neither that of ids nor of lines."""
    rng = random.Random(5)
    nodes = [(f"n{i:02}", "function", f"n{i}", "", rng.choice([None, "src/a.py", "src/b.py"]), rng.choice([None, 1, 2, 30]), 9, i % 2 == 0, "{}") for i in range(n)]
    nodes += [("alone", "function", "alone", "", "src/a.py", 1, 9, True, "{}"), ("self", "function", "self", "", "src/a.py", 1, 9, True, "{}")]
    calls = [(f"n{i:02}", f"n{(i + k) % n:02}") for i in range(n) for k in (1, *rng.sample(range(2, 6), 2))] + [("self", "self"), ("n00", "gone"), ("gone", "n07")]
    return graph.graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([("o", i, a, "calls", b, 1, "", "exact") for i, (a, b) in enumerate(calls)], OCC))


def plain_paths(g, inbound):
    """(id, other, distance, path) of all pairs of nodes, the least path by (path, line, id) of its nodes."""
    key = {r["id"]: tuple((x is not None, x or 0 if i else x or "") for i, x in enumerate((r["path"], r["line"]))) + (r["id"],) for r in g.nodes.collect()}
    out = {}
    for a, b in g.keys.select("src", "dst").collect():
        if a in key and b in key:
            out.setdefault(b if inbound else a, set()).add(a if inbound else b)
    found = set()
    for s in key:
        front, seen, d = {s: [s]}, {s}, 0
        while front:
            d, ways = d + 1, {}
            for a, p in front.items():
                for b in out.get(a, set()) - seen:
                    ways.setdefault(b, []).append([b, *p] if inbound else [*p, b])
            front = {b: min(w, key=lambda p: [key[x] for x in p]) for b, w in ways.items()}
            seen.update(front)
            found |= {(s, b, d, " > ".join(p)) for b, p in front.items()}
    return found


def rows_written(spark):
    at = Path(shared_dir(spark).removeprefix("file://"))
    return sum(pq.read_metadata(p).num_rows for p in at.rglob("*.parquet"))


@pytest.mark.parametrize("batch", [1, 3000, walks.BATCH])
@pytest.mark.parametrize("inbound", [True, False])
def test_least_paths_in_batches_of_any_size(spark, inbound, batch, monkeypatch):
    g = tied_graph(spark)
    want = plain_paths(g, inbound)
    nodes = [r["id"] for r in g.nodes.orderBy("path", "line", "id").collect()]
    at = {x: i for i, x in enumerate(nodes)}
    step = sorted((at[a], at[b]) for a, b in (r[::-1] if inbound else r for r in g.keys.select("src", "dst").collect()) if a in at and b in at)
    first = [sum(a < i for a, _ in step) for i in range(len(nodes) + 1)]
    held = walks.Steps(walks.pa.array(nodes), walks.np.array([True] * len(nodes)), walks.np.array(first), walks.np.array([b for _, b in step]))
    monkeypatch.setattr(walks, "BATCH", batch)
    parts = list(walks.pairs(held, iter(range(len(nodes))), inbound))
    assert {tuple(r.values()) for p in parts for r in p.to_pylist()} == want and sum(p.num_rows for p in parts) == len(want)
    assert batch > 1 or all(p.num_rows == 1 for p in parts)


@pytest.mark.parametrize("inbound", [True, False])
def test_searches_and_rounds_agree(spark, inbound):
    g = tied_graph(spark, 20)
    ids, wanted = g.nodes.select("id"), g.nodes.filter("id <> 'n03'")
    want = {r for r in plain_paths(g, inbound) if r[1] != "n03"}
    for held in (0, walks.HELD):
        found, met = traversal.call_paths(g, ids, wanted, inbound, held)
        assert set(rows(found, "id", "other", "distance", "path")) == want and rows(met) == sorted({(r[0],) for r in want})


def test_code_is_found_without_writing_pairs(spark):
    g = tied_graph(spark)
    before = rows_written(spark)
    got = traversal.discovered(g, g.nodes, inbound=False)
    assert got.count() == sum(int(o[1:]) % 2 for _, o, *_ in plain_paths(g, False)) > 1500
    assert rows_written(spark) - before < 500


def test_tests_are_found_without_writing_pairs(spark):
    g = tied_graph(spark)
    before = rows_written(spark)
    got = traversal.discovered(g, g.nodes, case=graph.F.col("is_test"))
    assert got.filter("distance > 0").count() == sum(1 - int(o[1:]) % 2 for _, o, *_ in plain_paths(g, True)) > 1500
    assert got.filter("distance IS NULL AND other = 'self'").count() == 0
    assert rows_written(spark) - before < 500
