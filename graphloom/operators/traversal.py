"""Bounded reachability over the graph, level by level.

Each level joins the frontier with the edges and keeps what was not seen
before. Levels are written tables, so the plan of a level never contains the
plans of those before it, and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import name_parts, words
from graphloom.operators import components, walks
from graphloom.operators.graph import CALLABLE, DATA_FLOW, FORWARD, REVERSE, STRUCTURAL, SUBTYPING, TEST_REACH, TYPE_KINDS, Graph, detail, is_public
from graphloom.operators.routes import scope_overlaps
from graphloom.session import cut, drop, small


def kinds_of(mode: str = "calls", edge_types: list[str] | None = None) -> tuple[set[str], set[str]]:
    """Edge kinds followed along and against their direction.

    ``data-flow`` follows value kinds only, ``all`` means every kind (an empty
    set of forward kinds stands for that), anything else dependencies and
    structure. Explicit types win over the mode; case does not matter.
    """
    if edge_types:
        wanted = {t.lower() for t in edge_types}
        return wanted - set(REVERSE), wanted & set(REVERSE)
    if mode == "data-flow":
        return set(DATA_FLOW), set()
    if mode == "all":
        return set(), set(REVERSE)
    return {*FORWARD, *STRUCTURAL}, set(REVERSE)


def steps(edges: DataFrame, inbound: bool, mode: str = "calls", edge_types: list[str] | None = None) -> DataFrame:
    """Directed steps (a, b, kind) that a traversal may take; repeats stay."""
    along, against = kinds_of(mode, edge_types)
    ahead = edges.filter(~F.col("kind").isin(*REVERSE)) if mode == "all" and not edge_types else edges.filter(F.col("kind").isin(*along)) if along else edges.limit(0)
    back = edges.filter(F.col("kind").isin(*against)) if against else None
    out = ahead.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind")
    if back is not None:
        out = out.unionByName(back.select(F.col("dst").alias("a"), F.col("src").alias("b"), "kind"))
    if inbound:
        out = out.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind")
    return out


def reach(step: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Ids within ``depth`` steps of the seeds with their least distance: id, distance, via, via_kind.

    ``via`` and ``via_kind`` are the least (predecessor, kind) on a shortest
    way; null for seeds. Circles end as nothing seen is taken again.
    """
    no = F.lit(None).cast("string")
    seen = cut(seeds.select("id").dropna().distinct().select("id", F.lit(0).alias("distance"), no.alias("via"), no.alias("via_kind")))
    front = seen
    for d in range(1, depth + 1):
        sent = step.join(small(front).select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "kind")).alias("m"))
        front = cut(sent.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance"), F.col("m.a").alias("via"), F.col("m.kind").alias("via_kind")))
        if not front.n_rows:
            break
        seen = seen.unionByName(front)
    return seen


SCANS = 4  # levels up to which a traversal scans the occurrences for each


def impact(g: Graph, seeds: DataFrame, depth: int = 3, inbound: bool = True, mode: str = "calls", edge_types: list[str] | None = None, frontier_cap: int | None = None) -> DataFrame:
    """Reachable nodes of a set of seeds: id, distance, via, via_kind, is_seed.

    ``frontier_cap`` refuses a traversal deeper than one level whose first
    level is larger, the way an interactive caller wants it.
    """
    # few levels read the rows that meet the frontier; for many, the steps are brought together once
    step = steps(g.triples, inbound, mode, edge_types) if depth <= SCANS else cut(steps(g.triples, inbound, mode, edge_types).distinct())
    if frontier_cap is not None and depth > 1:
        first = step.join(seeds.select(F.col("id").alias("a")).distinct(), "a").select("b").distinct().count()
        if first > frontier_cap:
            raise ValueError(f"{first} immediate links; the limit is {frontier_cap}")
    return reach(step, seeds, depth).withColumn("is_seed", F.col("distance") == 0)


def edge_descriptors(g: Graph, seeds: DataFrame, inbound: bool = True, mode: str = "calls") -> DataFrame:
    """For every node one step from the seeds its least edge by (kind, path, line, evidence): seed, id, kind, path, line, evidence."""
    along, against = kinds_of(mode)
    e = g.edges.select("src", "dst", "kind", "path", "line", "evidence")
    fwd = e.filter(F.col("kind").isin(*along))
    rev = e.filter(F.col("kind").isin(*against)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "path", "line", "evidence")
    both = fwd.unionByName(rev)
    here, there = ("dst", "src") if inbound else ("src", "dst")
    s = seeds.select(F.col("id").alias(here)).distinct()
    return both.join(s, here).groupBy(F.col(here).alias("seed"), F.col(there).alias("id")).agg(F.min(F.struct("kind", "path", "line", "evidence")).alias("e")).select("seed", "id", "e.*")


def closure(step: DataFrame, seeds: DataFrame) -> DataFrame:
    """All ids that the steps (a, b) reach from the seeds: id; seeds are there only if reached."""
    first = cut(step.join(seeds.select(F.col("id").alias("a")).dropna().distinct(), "a").select(F.col("b").alias("id")).distinct())
    return components.closure(step, first)


def implementations(g: Graph) -> DataFrame:
    """Every type with all types below it by inheritance, at any depth: base, id.

    Pairs are grown from each base at once; a circle does not make a type its
    own implementation.
    """
    types = g.nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select("id")
    up = g.keys.filter(F.col("kind").isin(*SUBTYPING)).select(F.col("dst").alias("base"), F.col("src").alias("id")).distinct()
    up = up.join(types, "id", "left_semi").join(types.select(F.col("id").alias("base")), "base", "left_semi")
    up = cut(up.filter("base <> id"))
    seen, front = up, up
    while True:
        nxt = front.alias("f").join(up.alias("u"), F.col("f.id") == F.col("u.base")).select(F.col("f.base").alias("base"), F.col("u.id").alias("id")).filter("base <> id").distinct()
        front = cut(nxt.join(seen, ["base", "id"], "left_anti"))
        if not front.n_rows:
            return seen
        seen = seen.unionByName(front)


def public_untested(g: Graph) -> DataFrame:
    """Public non-test nodes that no test reaches over calls: id, kind, path."""
    step = cut(g.keys.filter("kind = 'calls'").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    tested = closure(step, g.nodes.filter("is_test").select("id"))
    return g.nodes.filter(is_public() & ~F.coalesce("is_test", F.lit(False))).join(tested, "id", "left_anti").select("id", "kind", "path")


def shortest_paths(g: Graph, seeds: DataFrame, depth: int = 3, kinds: tuple[str, ...] = ("calls",), inbound: bool = True) -> DataFrame:
    """The least shortest path to every reachable node: id, distance, path (ids from the seed on, joined by ' > ').

    Of paths of equal length the least sequence of ids holds.
    """
    e = g.keys.filter(F.col("kind").isin(*kinds))
    step = e.select(F.col("dst").alias("a"), F.col("src").alias("b")) if inbound else e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    step = cut(step.distinct())
    seen = cut(seeds.select("id").dropna().distinct().select("id", F.lit(0).alias("distance"), F.array("id").alias("path")))
    front = seen
    for d in range(1, depth + 1):
        sent = step.join(front.select(F.col("id").alias("a"), "path"), "a").groupBy(F.col("b").alias("id")).agg(F.min("path").alias("head"))
        front = cut(sent.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance"), F.concat("head", F.array("id")).alias("path")))
        if not front.n_rows:
            break
        seen = seen.unionByName(front)
    return seen.select("id", "distance", F.array_join("path", " > ").alias("path"))


def call_steps(g: Graph, inbound: bool) -> DataFrame:
    """Calls between nodes as steps (a, b), inbound from the called to the caller; a written table."""
    a, b = ("dst", "src") if inbound else ("src", "dst")
    calls = g.keys.filter("kind = 'calls'").select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    ids = g.nodes.select("id")
    return cut(calls.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))


def call_paths(g: Graph, selected: DataFrame, wanted: DataFrame, inbound: bool, held: int = walks.HELD) -> tuple[DataFrame, DataFrame]:
    """The least shortest path over calls between each selected node and every wanted one it meets (id, other, distance, path), and the selected ones that meet any (id).

    Inbound, paths lead from the caller to the selected node, else from it on.
    Of equal lengths the least sequence of (path, line, id) holds. No depth is
    set: a search ends when it meets nothing new, so circles end too. A graph
    of more than ``held`` bytes is searched in rounds, which write every pair.
    """
    step = call_steps(g, inbound)
    found = walks.searched(g.nodes, step, selected, wanted, inbound, held)
    if found is None:
        pairs = call_rounds(g, step, selected, inbound).join(wanted.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other", "distance", "path")
        pairs = cut(pairs) if inbound else pairs
        found = pairs, pairs.select("id").distinct()
    drop(step)
    return found


def call_rounds(g: Graph, step: DataFrame, selected: DataFrame, inbound: bool) -> DataFrame:
    """The least shortest path over calls between each selected node and every node it meets, all starts at once: id, other, distance, path.

    Rounds end when none brings a new pair.
    """
    key = g.nodes.select(F.col("id").alias("b"), F.struct("path", "line", "id").alias("key"))
    step = cut(step.join(key, "b"))
    seen = cut(selected.select(F.col("id").alias("b")).distinct().join(key, "b").select(F.col("b").alias("id"), F.col("b").alias("other"), F.lit(0).alias("distance"), F.array("key").alias("path")))
    front, parts, d = seen, [seen], 0
    while front.n_rows:
        d += 1
        longer = F.concat(F.array("key"), "path") if inbound else F.concat("path", F.array("key"))
        sent = front.join(step, F.col("other") == F.col("a")).groupBy("id", F.col("b").alias("other")).agg(F.min(longer).alias("path"))
        front = cut(sent.join(seen.select("id", "other"), ["id", "other"], "left_anti").select("id", "other", F.lit(d).alias("distance"), "path"))
        parts.append(front)
        seen = seen.unionByName(front)
        if len(parts) > 8:  # one table again, as plans over many rounds fill the driver
            seen = cut(seen)
            for x in parts:
                if x is not front:
                    drop(x)
            parts = [seen]
    return seen.filter("distance > 0").withColumn("path", F.array_join(F.col("path.id"), " > "))


def is_test_case() -> Column:
    """Whether a node is a test whose details give it the role of a test case."""
    return F.coalesce(F.col("is_test") & (detail("test_role") == "test_case"), F.lit(False))


def lexical_tests(symbols: DataFrame, cases: DataFrame) -> DataFrame:
    """Test cases that the names suggest for symbols (id, name): id, other.

    A test case must have the symbol's name, or all its parts, among its words,
    and be named like the symbol (plainly or behind ``test_``) or hold its name
    in snake case in its own name or path. Both meet on a word, not pair by pair.
    """
    whole, parts = words(F.coalesce("name", F.lit(""))), name_parts(F.coalesce("name", F.lit("")))
    s = symbols.select("id", F.lower("name").alias("low"), whole.alias("whole"), parts.alias("parts"))
    s = s.select("*", F.explode(F.array_distinct(F.concat(F.slice("whole", 1, 1), F.slice("parts", 1, 1)))).alias("word"))
    named = cases.filter(F.col("kind").isin("function", "method", "class", "struct"))
    text = F.array_distinct(F.concat(name_parts(F.coalesce("name", F.lit(""))), words(F.concat_ws(" ", "name", "qualname", "path"))))
    t = named.select(F.col("id").alias("other"), F.lower("name").alias("t_name"), F.lower("path").alias("t_path"), text.alias("text")).select("*", F.explode("text").alias("word"))
    holds = lambda c: (F.size(c) > 0) & (F.size(F.array_except(c, "text")) == 0)
    snake = F.array_join("parts", "_")
    like = (F.col("t_name") == F.col("low")) | (F.col("t_name") == F.concat(F.lit("test_"), "low")) | F.contains("t_name", snake) | F.contains("t_path", snake)
    return s.join(t, "word").filter((F.col("id") != F.col("other")) & (holds("whole") | holds("parts")) & like).select("id", "other").distinct()


def discovered(g: Graph, selected: DataFrame, inbound: bool = True, case: Column | None = None) -> DataFrame:
    """Test cases that call the selected nodes, or code that these call: id, other, relation, distance, path.

    Inbound keeps test cases (by ``case``, as a rule :func:`is_test_case`),
    outbound nodes that are no tests. ``relation`` is ``direct``,
    ``transitive``, or inbound ``lexical_fallback`` for selected nodes that no
    test case reaches; those have neither distance nor path.
    """
    keep = (is_test_case() if case is None else F.coalesce(case, F.lit(False))) if inbound else ~F.coalesce("is_test", F.lit(False))
    wanted = g.nodes.filter(keep)
    relation = F.when(F.col("distance") == 1, "direct").otherwise("transitive")
    found, met = call_paths(g, selected, wanted, inbound)
    found = found.select("id", "other", relation.alias("relation"), "distance", "path")
    if not inbound:
        return found
    bare = g.nodes.join(selected.select("id").distinct(), "id", "left_semi").join(met, "id", "left_anti").select("id", "name")
    none = lambda t: F.lit(None).cast(t)
    return found.unionByName(lexical_tests(bare, wanted).select("id", "other", F.lit("lexical_fallback").alias("relation"), none("int").alias("distance"), none("string").alias("path")))


def covering_tests(g: Graph, kinds: tuple[str, ...]) -> DataFrame:
    """Test nodes that reach a node in one or two steps: id, test, hops (the least)."""
    e = cut(g.keys.filter(F.col("kind").isin(*kinds)).select("src", "dst").distinct())
    tests = g.nodes.filter("is_test").select(F.col("id").alias("test"))
    one = e.join(tests, e["src"] == tests["test"]).select(F.col("dst").alias("id"), "test", F.lit(1).alias("hops"))
    one = cut(one)
    two = one.select(F.col("id").alias("src"), "test").join(e, "src").select(F.col("dst").alias("id"), "test", F.lit(2).alias("hops"))
    return one.unionByName(two).groupBy("id", "test").agg(F.min("hops").alias("hops"))


def seams(g: Graph, targets: DataFrame, hops: int = 8) -> DataFrame:
    """Targets (column ``id``) that a test reaches within some hops over the kinds of test reach: id, distance, via, via_kind."""
    step = steps(g.triples.filter(F.col("kind").isin(*TEST_REACH)), False, mode="all").distinct()
    found = reach(cut(step), g.nodes.filter("is_test").select("id"), hops)
    return found.join(targets.select("id").distinct(), "id", "left_semi")


def change_impact(g: Graph, changed: DataFrame, depth: int = 3) -> DataFrame:
    """What depends on changed symbols (column ``id``), tests marked: id, distance, via, via_kind, is_seed, is_test."""
    found = impact(g, changed, depth, inbound=True)
    return found.join(g.nodes.select("id", F.coalesce("is_test", F.lit(False)).alias("is_test")), "id")


def wave_clashes(placed: DataFrame, scopes: DataFrame) -> DataFrame:
    """Tasks of one wave whose scopes overlap: wave, a, b. ``placed`` is what :func:`waves` gives, ``scopes`` has owner and scope."""
    w = placed.filter("wave IS NOT NULL")
    pairs = scope_overlaps(scopes)
    j = pairs.join(w.select(F.col("id").alias("a"), "wave"), "a").join(w.select(F.col("id").alias("b"), F.col("wave").alias("other")), "b")
    return j.filter("wave = other").select("wave", "a", "b")


def waves(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """Level of each task in its dependency graph: id, wave (0 without dependencies, else one more than its latest).

    ``needs`` has id and needs; dependencies on unknown tasks are ignored.
    Tasks on a circle, or behind one, get no wave: null.
    """
    ids = cut(tasks.select("id").dropna().distinct())
    n = cut(needs.select("id", "needs").dropna().distinct().join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("needs")), "needs", "left_semi"))
    done = cut(ids.join(n, "id", "left_anti").select("id", F.lit(0).alias("wave")))
    front, open_, wave = done, n, 0
    while front.n_rows:
        wave += 1
        open_ = cut(open_.join(front.select(F.col("id").alias("needs")), "needs", "left_anti").select("id", "needs"))
        freed = n.join(front.select(F.col("id").alias("needs")), "needs").select("id").distinct()
        front = cut(freed.join(open_.select("id"), "id", "left_anti").select("id", F.lit(wave).alias("wave")))
        done = done.unionByName(front)
    return ids.join(done, "id", "left").select("id", "wave")


def entrypoints(g: Graph) -> DataFrame:
    """Nodes with an entrypoint detail: id, entrypoint."""
    return g.nodes.filter(detail("entrypoint").isNotNull()).select("id", detail("entrypoint").alias("entrypoint"))


def callable_nodes(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*CALLABLE))
