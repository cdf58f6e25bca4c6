import random

from conftest import rows

from graphloom.operators.components import strong_components
from graphloom.operators import hierarchy as module
from graphloom.operators.hierarchy import ancestors, circles, containment_links, hierarchy, range_pairs

OCC = "owner_path string, ordinal long, src string, kind string, dst string, root string"


def links(spark, pairs):
    data = [("o", i, a, "contains", b, "x") for i, (a, b) in enumerate(pairs)]
    return containment_links(spark.createDataFrame(data, OCC))


def brute_components(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[n] = seen
    return sorted((min(m for m in reach[n] if n in reach[m]), n) for n in reach if n in reach[n])


def random_forest(seed, n=60, loops=3):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(max(0, i - 9), i)}", f"n{i}") for i in range(1, n) if r.random() < 0.9]
    for k in range(loops):
        ring = [f"c{k}_{i}" for i in range(r.randrange(1, 6))]
        pairs += list(zip(ring, ring[1:] + ring[:1])) + [(ring[0], f"h{k}"), (f"h{k}", f"hh{k}")]
    return pairs


def test_circles_of_random_forests(spark):
    for seed in range(3):
        pairs = random_forest(seed)
        assert rows(circles(links(spark, pairs + pairs[:5])), "loop_id", "node_id") == brute_components(pairs)


def test_long_chain_and_long_circle(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)]
    ring = [(f"c{i:03}", f"c{(i + 1) % 70:03}") for i in range(70)] + [("c000", "h0")] + [(f"h{i}", f"h{i + 1}") for i in range(40)]
    assert rows(circles(links(spark, chain + ring))) == sorted(("c000", f"c{i:03}") for i in range(70))
    deep = {r["id"]: r for r in hierarchy(links(spark, chain + ring)).collect()}
    assert deep["n100"]["depth"] == 100 and deep["n000"]["descendants"] == 100 and deep["h3"]["state"] == "unprocessed"


def test_several_parents_fall_back_to_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c"), ("0", "b"), ("d", "e"), ("s", "s")]
    assert rows(circles(links(spark, pairs))) == brute_components(pairs)


def test_components_of_a_random_graph(spark):
    r = random.Random(5)
    pairs = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(38)] + [("x", "x"), (None, "n1"), ("n1", None)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    want = brute_components([p for p in pairs if None not in p])
    for last in (0, 3, 10**6):
        assert rows(strong_components(df, last), "component", "id") == want


def test_hierarchy_against_brute_force(spark, monkeypatch):
    pairs = random_forest(1) + [("hub", f"k{i:03}") for i in range(200)]
    up = {b: a for a, b in pairs}
    got = {r["id"]: r for r in hierarchy(links(spark, pairs)).collect()}
    on_circle = {n for _, n in brute_components(pairs)}
    paths = {}
    for n in {x for p in pairs for x in p}:
        p = [n]
        while p[-1] in up and len(p) < 500:
            p.append(up[p[-1]])
        paths[n] = None if len(p) >= 500 else p[::-1]
    assert set(got) == set(paths)
    for n, p in paths.items():
        if p is None:
            assert got[n]["state"] == "unprocessed" and got[n]["path"] is None
            continue
        assert n not in on_circle
        below = sorted(m for m, q in paths.items() if q and n in q and m != n)
        assert (got[n]["path"], got[n]["root"], got[n]["depth"], got[n]["descendants"]) == (p, p[0], len(p) - 1, len(below))
        inside = sorted(m for m, x in got.items() if x["root"] == p[0] and got[n]["lo"] < (x["lo"] or 0) <= got[n]["hi"])
        assert inside == below
    tree = hierarchy(links(spark, pairs))
    want = spark.createDataFrame([("hub",), ("n0",)], "id string")
    assert len(rows(range_pairs(tree, want))) == 200 + sum(1 for q in paths.values() if q and "n0" in q[:-1])
    pairs = sorted((q[i], n, len(q) - 1 - i) for n, q in paths.items() if q for i in range(len(q) - 1))
    assert rows(ancestors(tree), "ancestor", "id", "distance") == pairs
    for top in (12, 4, 2, 0):
        monkeypatch.setattr(module, "TOP_POWER", top)
        assert rows(range_pairs(tree), "id", "descendant", "distance") == pairs


def test_empty_and_null_links(spark):
    occ = spark.createDataFrame([("o", 0, "a", "contains", None, ""), ("o", 1, None, "contains", "b", ""), ("o", 2, "a", "calls", "a", "")], OCC)
    assert circles(containment_links(occ)).count() == 0
    assert hierarchy(containment_links(occ)).count() == 0
