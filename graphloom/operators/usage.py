"""What is used, tested, governed and safe to remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import within
from graphloom.operators.graph import CALLABLE, ENTRY_WIRING, REVERSE, SUBTYPING, TEST_REACH, TYPE_KINDS, Graph, detail, is_public
from graphloom.operators.traversal import callable_nodes, covering_tests


def untested(g: Graph, scope: str = "") -> DataFrame:
    """Functions and methods outside tests that no test calls directly: id, name, path."""
    tests = g.nodes.filter("is_test").select(F.col("id").alias("src"))
    called = g.keys.filter("kind = 'calls'").join(tests, "src", "left_semi").select(F.col("dst").alias("id"))
    own = callable_nodes(g).filter(~F.coalesce("is_test", F.lit(False)) & within(F.col("path"), scope))
    return own.join(called, "id", "left_anti").select("id", "name", "path")


def unwired(g: Graph) -> DataFrame:
    """Functions and methods that nothing calls and that are no entrypoint: id, name, path."""
    called = g.keys.filter("kind = 'calls'").select(F.col("dst").alias("id"))
    return callable_nodes(g).filter(detail("entrypoint").isNull()).join(called, "id", "left_anti").select("id", "name", "path")


# Categories of entrypoints by rank, and the registrations that give them.
CATEGORIES = ("test", "main", "http_route", "mcp_tool", "cli_command", "event_handler")
REGISTRATIONS = {"main_registration": 1, "route": 2, "tool_registration": 3, "cli_command_registration": 4, "event_handler_registration": 5}


def entry_ranks(g: Graph) -> DataFrame:
    """Rank of each entrypoint, the least of its own category and those of exact wiring edges: id, rank, category.

    Routes give http_route, dispatching and listening event_handler, handling
    what the kind of the registration says.
    """
    own = detail("entrypoint")
    rank = F.create_map(*[x for i, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(i))])
    mine = g.nodes.select("id", F.try_element_at(rank, own).alias("rank"))
    kinds = F.create_map(*[x for k, i in REGISTRATIONS.items() for x in (F.lit(k), F.lit(i))])
    e = g.edges.filter(F.col("kind").isin(*ENTRY_WIRING) & (F.col("confidence") == "exact")).select("src", "kind", "dst")
    by_src = e.join(g.nodes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src", "left")
    wired = F.when(F.col("kind") == "routes_to", 2).when(F.col("kind").isin("dispatches", "listens_to"), 5).otherwise(F.try_element_at(kinds, F.col("src_kind")))
    both = mine.unionByName(by_src.select(F.col("dst").alias("id"), wired.alias("rank")).join(g.nodes.select("id"), "id", "left_semi")).filter("rank IS NOT NULL")
    best = both.groupBy("id").agg(F.min("rank").alias("rank"))
    return best.withColumn("category", F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("rank") + 1))


def removal(g: Graph, scopes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Whether what lies in each scope could be removed: scope, n_nodes, n_dependents, n_unresolved, n_errors, safe.

    ``scopes`` has scope and id, the nodes of each. Dependents are edges from
    outside a scope into it; containment and document references do not count,
    and kinds stored against their meaning are read backwards. References of
    its nodes without a target, and syntax errors (path, line, message) of its
    files, leave the answer open, so that it is not safe either.
    """
    s = scopes.select("scope", "id").distinct()
    real = g.keys.filter(~F.col("kind").isin("contains", "references_doc"))
    ahead = real.filter(~F.col("kind").isin(*REVERSE)).select(F.col("src").alias("user"), F.col("dst").alias("id"))
    back = real.filter(F.col("kind").isin(*REVERSE)).select(F.col("dst").alias("user"), F.col("src").alias("id"))
    uses = ahead.unionByName(back).distinct().join(s, "id")
    outside = uses.join(s.select("scope", F.col("id").alias("user")), ["scope", "user"], "left_anti").groupBy("scope").agg(F.count(F.lit(1)).alias("n_dependents"))
    open_ = g.occurrences.filter(F.col("dst").isNull()).select(F.col("src").alias("id")).join(s, "id").groupBy("scope").agg(F.count(F.lit(1)).alias("n_unresolved"))
    out = s.groupBy("scope").agg(F.count(F.lit(1)).alias("n_nodes")).join(outside, "scope", "left").join(open_, "scope", "left")
    if errors is None:
        out = out.withColumn("n_errors", F.lit(0).cast("long"))
    else:
        files = s.join(g.nodes.select("id", "path"), "id").select("scope", "path").distinct()
        out = out.join(files.join(errors, "path").groupBy("scope").agg(F.count(F.lit(1)).alias("n_errors")), "scope", "left")
    counts = ["n_dependents", "n_unresolved", "n_errors"]
    out = out.na.fill(0, counts).select("scope", "n_nodes", *counts)
    return out.withColumn("safe", (F.col("n_dependents") == 0) & (F.col("n_unresolved") == 0) & (F.col("n_errors") == 0))


def governing(g: Graph) -> DataFrame:
    """Invariants and documents that govern a node directly, or a node it calls: id, governor, relation.

    A governor that is direct is not listed as transitive too.
    """
    direct = g.keys.filter("kind = 'governs'").select(F.col("dst").alias("id"), F.col("src").alias("governor")).distinct()
    calls = g.keys.filter("kind = 'calls'").select(F.col("src").alias("id"), F.col("dst").alias("callee")).distinct()
    far = calls.join(direct.select(F.col("id").alias("callee"), "governor"), "callee").select("id", "governor").distinct().join(direct, ["id", "governor"], "left_anti")
    return direct.withColumn("relation", F.lit("direct")).unionByName(far.withColumn("relation", F.lit("transitive")))


def governing_page(g: Graph, top: int = 5) -> DataFrame:
    """Per node and relation the first ``top`` governors in byte order and how many were left out."""
    w = Window.partitionBy("id", "relation")
    r = governing(g).withColumn("rank", F.row_number().over(w.orderBy("governor"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.filter(F.col("rank") <= top).select("id", "relation", "rank", "governor", F.greatest(F.col("n") - top, F.lit(0)).alias("omitted"))


def related_documents(g: Graph) -> DataFrame:
    """Documents by node, from either direction of the documentation kinds: id, document."""
    d = g.keys.filter(F.col("kind").isin("documents", "governs")).select(F.col("dst").alias("id"), F.col("src").alias("document"))
    b = g.keys.filter(F.col("kind") == "governed_by").select(F.col("src").alias("id"), F.col("dst").alias("document"))
    return d.unionByName(b).distinct()


def symbol_documents(g: Graph, top: int = 30) -> DataFrame:
    """Documents of each node, invariants first, then by path and id: id, document, is_invariant, place (from 1, up to ``top``)."""
    docs = g.nodes.select(F.col("id").alias("document"), (F.col("kind") == "invariant").alias("is_invariant"), "path")
    j = related_documents(g).join(docs, "document")
    w = Window.partitionBy("id").orderBy(F.desc("is_invariant"), "path", "document")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("id", "document", "is_invariant", "place")


def document_symbols(g: Graph) -> DataFrame:
    """Symbols that documents are about: document, id, name, kind, path, line, citation_line."""
    e = g.edges.filter("kind = 'documents'").select(F.col("src").alias("document"), F.col("dst").alias("id"), F.col("line").alias("citation_line"))
    return e.join(g.nodes.select("id", "name", "kind", "path", "line"), "id").select("document", "id", "name", "kind", "path", "line", "citation_line")


def citations(g: Graph, cites: str = "cites_doc") -> DataFrame:
    """Documents that documents cite, both ways: document, direction (cites or cited_by), other, path, line."""
    e = g.edges.filter(F.col("kind") == cites)
    out = e.select(F.col("src").alias("document"), F.lit("cites").alias("direction"), F.col("dst").alias("other"), "line")
    back = e.select(F.col("dst").alias("document"), F.lit("cited_by").alias("direction"), F.col("src").alias("other"), "line")
    return out.unionByName(back).join(g.nodes.select(F.col("id").alias("other"), "path"), "other").select("document", "direction", "other", "path", "line")


def scope_documents(g: Graph, scope: str, kinds: tuple[str, ...] = ("document", "invariant")) -> DataFrame:
    """All sections in the files of documents that govern or describe a scope: id, path, line, is_direct (itself such a document)."""
    inside = g.nodes.filter(within(F.col("path"), scope)).select("id")
    direct = related_documents(g).join(inside, "id", "left_semi").select(F.col("document").alias("id")).distinct()
    paths = g.nodes.join(direct, "id", "left_semi").select("path").distinct()
    s = g.nodes.filter(F.col("kind").isin(*kinds)).join(paths, "path", "left_semi").select("id", "path", "line")
    return s.join(direct.withColumn("is_direct", F.lit(True)), "id", "left").select("id", "path", "line", F.coalesce("is_direct", F.lit(False)).alias("is_direct"))


def public_symbols(g: Graph, scope: str, top: int = 15) -> DataFrame:
    """The first public types and functions of a scope, tests aside, by path and line: id, kind, path, line."""
    kept = g.nodes.filter(is_public() & ~F.coalesce("is_test", F.lit(False)) & F.col("kind").isin(*CALLABLE, *TYPE_KINDS) & within(F.col("path"), scope))
    return kept.select("id", "kind", "path", "line").orderBy("path", "line", "id").limit(top)


def unwired_summary(g: Graph) -> DataFrame:
    """How many functions and methods nothing calls, and how many of these are entrypoints: n_unwired, n_entrypoints."""
    called = g.triples.filter("kind = 'calls'").select(F.col("dst").alias("id")).distinct()
    own = callable_nodes(g).join(called, "id", "left_anti")
    return own.agg(F.count_if(detail("entrypoint").isNull()).alias("n_unwired"), F.count_if(detail("entrypoint").isNotNull()).alias("n_entrypoints"))


def pulse(g: Graph, ids: DataFrame) -> DataFrame:
    """What surrounds the given nodes: id, n_callers, n_implementations, n_tests (reaching it in one or two steps)."""
    wanted = ids.select("id").distinct()
    into = g.keys.select(F.col("dst").alias("id"), "kind").join(wanted, "id", "left_semi").groupBy("id").agg(F.count_if(F.col("kind") == "calls").alias("n_callers"), F.count_if(F.col("kind").isin("inherits", "implements", "extends")).alias("n_implementations"))
    tests = covering_tests(g, TEST_REACH).join(wanted, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_tests"))
    return wanted.join(into, "id", "left").join(tests, "id", "left").na.fill(0, ["n_callers", "n_implementations", "n_tests"])


def explain(g: Graph, ids: DataFrame) -> DataFrame:
    """All edges at the given nodes: id, direction, kind, other, occurrence_count, confidence."""
    wanted = ids.select("id").distinct()
    out = g.edges.select(F.col("src").alias("id"), F.lit("outgoing").alias("direction"), "kind", F.col("dst").alias("other"), "occurrence_count", "confidence")
    back = g.edges.select(F.col("dst").alias("id"), F.lit("incoming").alias("direction"), "kind", F.col("src").alias("other"), "occurrence_count", "confidence")
    return out.unionByName(back).join(wanted, "id", "left_semi")


def containers(g: Graph) -> DataFrame:
    """The innermost container of each node: id, container (the least source of its contains edges)."""
    return g.keys.filter("kind = 'contains'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("container"))


def call_previews(g: Graph, top: int = 5, callees: bool = False) -> DataFrame:
    """The first callers of each node in byte order, as one list, with their number: id, n_callers, callers; or its callees."""
    here, there = ("src", "dst") if callees else ("dst", "src")
    name = "callees" if callees else "callers"
    calls = g.keys.filter("kind = 'calls'").select(F.col(here).alias("id"), F.col(there).alias("other")).distinct()
    w = Window.partitionBy("id").orderBy("other")
    ranked = calls.withColumn("rank", F.row_number().over(w))
    lists = ranked.filter(F.col("rank") <= top).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), ", ").alias(name))
    return calls.groupBy("id").agg(F.count(F.lit(1)).alias(f"n_{name}")).join(lists, "id")


def type_relations(g: Graph, top: int = 50) -> DataFrame:
    """The first types that implement each type, and that it implements, in byte order: id, relation (implementors or implements), other, place."""
    e = g.keys.filter(F.col("kind").isin(*SUBTYPING))
    both = e.select(F.col("dst").alias("id"), F.lit("implementors").alias("relation"), F.col("src").alias("other")).unionByName(e.select(F.col("src").alias("id"), F.lit("implements").alias("relation"), F.col("dst").alias("other"))).distinct()
    w = Window.partitionBy("id", "relation").orderBy("other")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def outside_callers(g: Graph) -> DataFrame:
    """Files with non-test callers of each callable: id, n_files; 0 where it is indexed but not called."""
    callers = g.nodes.filter(~F.coalesce("is_test", F.lit(False))).select(F.col("id").alias("src"), F.col("path").alias("caller_path"))
    called = g.keys.filter("kind = 'calls'").join(callers, "src").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("caller_path").alias("n_files"))
    return callable_nodes(g).select("id").join(called, "id", "left").select("id", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def signals(g: Graph) -> DataFrame:
    """Counts per file that a reader is shown: path, n_nodes, n_edges, n_callers, n_implementations, n_invariants."""
    own = g.nodes.select(F.col("id").alias("dst"), F.col("path").alias("at"))
    e = g.keys.join(own, "dst").groupBy(F.col("at").alias("path")).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_if(F.col("kind") == "calls").alias("n_callers"),
        F.count_if(F.col("kind").isin("inherits", "implements", "extends")).alias("n_implementations"),
        F.count_if(F.col("kind") == "governs").alias("n_invariants"),
    )
    n = g.nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(e, "path", "left").na.fill(0, ["n_edges", "n_callers", "n_implementations", "n_invariants"]).select("path", "n_nodes", "n_edges", "n_callers", "n_implementations", "n_invariants")
