"""Queries over the property graph, with their SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from graphloom.functions.paths import is_test_path
from graphloom.functions.text import _ACCENTED, _PLAIN, fnv1a
from graphloom.operators import boundary, commitments, delta, diagnostics, duplicates, graph, selectors, traversal, usage
from graphloom.plans.training_data import _PATH
from graphloom.session import table

Q: dict = {}
SQL: dict[str, str] = {}

NODES = "n AS (SELECT DISTINCT * FROM nodes WHERE id IS NOT NULL)"
OCC = "o AS (SELECT DISTINCT * FROM edge_occurrences)"
EDGES = f"""{NODES}, {OCC}, e AS (
  SELECT src, kind, dst, count(*) AS occurrence_count, arg_min({{'path': owner_path, 'line': line, 'evidence': evidence, 'confidence': confidence}}, (owner_path, ordinal)) AS f
  FROM o WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, kind, dst)"""


def kinds(*names: str) -> str:
    return ", ".join(f"'{k}'" for k in names)


FORWARD, REVERSE = kinds(*graph.FORWARD, *graph.STRUCTURAL), kinds(*graph.REVERSE)
TYPES, SUB, CALLABLE = kinds(*graph.TYPE_KINDS), kinds(*graph.SUBTYPING), kinds(*graph.CALLABLE)
PUBLIC = "coalesce(json_extract_string(details, '$.is_public') IN ('true', '1'), false)"
ENTRY = "json_extract_string(details, '$.entrypoint')"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def seeds(g):
    """All components, from which the bounded traversals start."""
    return g.nodes.filter("kind = 'component'").select("id")


SEEDS = "seeds AS (SELECT id FROM n WHERE kind = 'component')"
ALL = "seeds AS (SELECT id FROM n)"


@query(f"WITH {EDGES} SELECT src, kind, dst, occurrence_count, f.path AS path, f.line AS line, f.evidence AS evidence, f.confidence AS confidence FROM e")
def edge_aggregate(spark, d):
    return graph.load(spark, d).edges


@query(f"WITH {NODES} SELECT id, kind, name, qualname, path, line, end_line, is_test FROM n")
def node_projection(spark, d):
    return graph.compact(graph.load(spark, d).nodes)


@query(
    f"""WITH {EDGES} SELECT e.src, s.kind AS src_kind, s.path AS src_path, e.kind, e.dst, t.kind AS dst_kind, t.path AS dst_path, occurrence_count, f.line AS line, f.evidence AS evidence, f.confidence AS confidence
FROM e LEFT JOIN n s ON s.id = e.src LEFT JOIN n t ON t.id = e.dst"""
)
def edge_projection(spark, d):
    return graph.described_edges(graph.load(spark, d))


@query(f"WITH {EDGES}, v AS (SELECT id FROM n WHERE kind NOT IN ('variable', 'enum')) SELECT DISTINCT src, kind, dst FROM e WHERE src NOT IN (SELECT id FROM v) OR (NOT starts_with(dst, 'external:') AND dst NOT IN (SELECT id FROM v))")
def dangling_edges(spark, d):
    """Whole data dangles nowhere: variables and enums are taken out first."""
    g = graph.load(spark, d)
    return graph.dangling(dataclasses.replace(g, nodes=g.nodes.filter("kind NOT IN ('variable', 'enum')")))


@query(f"WITH {EDGES} SELECT id, direction, kind, count(*) AS n FROM (SELECT src AS id, 'out' AS direction, kind FROM e UNION ALL SELECT dst, 'in', kind FROM e) GROUP BY ALL")
def neighbour_counts(spark, d):
    return graph.neighbours(graph.load(spark, d)).groupBy("id", "direction", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {EDGES}, a AS (SELECT src AS id, count(*) AS callees, sum(occurrence_count) AS calls_out FROM e WHERE kind = 'calls' GROUP BY src),
b AS (SELECT dst AS id, count(*) AS callers, sum(occurrence_count) AS calls_in FROM e WHERE kind = 'calls' GROUP BY dst)
SELECT n.id, coalesce(callers, 0) AS callers, CAST(coalesce(calls_in, 0) AS BIGINT) AS calls_in, coalesce(callees, 0) AS callees, CAST(coalesce(calls_out, 0) AS BIGINT) AS calls_out FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id)"""
)
def call_counts(spark, d):
    return graph.degree_summary(graph.load(spark, d))


@query(f"WITH {NODES} SELECT id, path FROM n WHERE (path = 'tidewater-index' OR (path >= 'tidewater-index/' AND path < 'tidewater-index0')) AND NOT path ILIKE 'archive/%' AND NOT path ILIKE '%/archive/%'")
def path_scope(spark, d):
    return graph.without_archives(graph.in_scope(graph.load(spark, d).nodes, "tidewater-index")).select("id", "path")


@query(
    r"WITH n AS (SELECT DISTINCT * FROM nodes), p AS (SELECT id, path, is_test, regexp_matches(path, '(^|/)tests?(/|$)') OR starts_with(split_part(path, '/', -1), 'test_') OR ends_with(split_part(path, '/', -1), '_test.go') OR contains(split_part(path, '/', -1), '.test.') OR contains(split_part(path, '/', -1), '.spec.') AS by_path FROM n WHERE path IS NOT NULL) SELECT * FROM p WHERE is_test IS DISTINCT FROM by_path"
)
def test_flag_conflicts(spark, d):
    return graph.test_flags(graph.load(spark, d).nodes)


@query(f"WITH {NODES} SELECT id, {ENTRY} AS entrypoint FROM n WHERE {ENTRY} IS NOT NULL")
def entrypoint_nodes(spark, d):
    return traversal.entrypoints(graph.load(spark, d))


def _walk_sql(inbound: bool, depth: int, fwd: str, rev: str) -> str:
    a, b = ("dst", "src") if inbound else ("src", "dst")
    return f"""WITH RECURSIVE {EDGES}, {SEEDS},
st AS (SELECT DISTINCT {a} AS a, {b} AS b, kind FROM e WHERE kind IN ({fwd}) UNION SELECT DISTINCT {b}, {a}, kind FROM e WHERE kind IN ({rev})),
w AS (SELECT id, 0 AS distance FROM seeds UNION SELECT st.b, w.distance + 1 FROM w JOIN st ON st.a = w.id WHERE w.distance < {depth}),
r AS (SELECT id, min(distance) AS distance FROM w GROUP BY id),
v AS (SELECT st.b AS id, min((st.a, st.kind)) AS m FROM st JOIN r p ON p.id = st.a JOIN r c ON c.id = st.b AND c.distance = p.distance + 1 GROUP BY st.b)
SELECT r.id, r.distance, v.m[1] AS via, v.m[2] AS via_kind, r.distance = 0 AS is_seed FROM r LEFT JOIN v ON v.id = r.id AND r.distance > 0"""


@query(_walk_sql(False, 3, FORWARD, REVERSE))
def bfs_outbound(spark, d):
    g = graph.load(spark, d)
    return traversal.impact(g, seeds(g), depth=3, inbound=False)


@query(_walk_sql(True, 3, FORWARD, REVERSE))
def bfs_inbound(spark, d):
    g = graph.load(spark, d)
    return traversal.impact(g, seeds(g), depth=3, inbound=True)


@query(_walk_sql(False, 4, kinds(*graph.DATA_FLOW), "''"))
def bfs_data_flow(spark, d):
    g = graph.load(spark, d)
    return traversal.impact(g, seeds(g), depth=4, inbound=False, mode="data-flow")


@query(_walk_sql(False, 2, "'calls'", "'decorates'"))
def bfs_edge_types(spark, d):
    g = graph.load(spark, d)
    return traversal.impact(g, seeds(g), depth=2, inbound=False, edge_types=["Calls", "decorates"])


@query(
    f"""WITH {EDGES}, {ALL}, b AS (
  SELECT dst AS seed, src AS id, kind, f FROM e WHERE kind IN ({FORWARD}) UNION ALL SELECT src, dst, kind, f FROM e WHERE kind IN ({REVERSE}))
SELECT seed, id, m.kind AS kind, m.path AS path, m.line AS line, m.evidence AS evidence FROM (
  SELECT seed, b.id, first({{'kind': kind, 'path': f.path, 'line': f.line, 'evidence': f.evidence}} ORDER BY kind, f.path, f.line NULLS FIRST, f.evidence NULLS FIRST) AS m FROM b JOIN seeds ON seeds.id = b.seed GROUP BY seed, b.id)"""
)
def edge_descriptor_depth1(spark, d):
    g = graph.load(spark, d)
    return traversal.edge_descriptors(g, g.nodes.select("id"))


@query(
    f"""WITH RECURSIVE {EDGES}, up AS (SELECT DISTINCT dst AS base, src AS id FROM e WHERE kind IN ({SUB}) AND src <> dst AND src IN (SELECT id FROM n WHERE kind IN ({TYPES})) AND dst IN (SELECT id FROM n WHERE kind IN ({TYPES}))),
c AS (SELECT base, id FROM up UNION SELECT c.base, up.id FROM c JOIN up ON up.base = c.id WHERE up.id <> c.base)
SELECT base, id FROM c"""
)
def closure_types(spark, d):
    return traversal.implementations(graph.load(spark, d))


@query(
    f"""WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT e.dst AS id FROM e JOIN n ON n.id = e.src WHERE e.kind = 'calls' AND n.is_test UNION SELECT e.dst FROM w JOIN e ON e.src = w.id AND e.kind = 'calls')
SELECT id, kind, path FROM n WHERE {PUBLIC} AND NOT coalesce(is_test, false) AND id NOT IN (SELECT id FROM w)"""
)
def public_uncovered(spark, d):
    return traversal.public_untested(graph.load(spark, d))


@query(
    f"""WITH RECURSIVE {EDGES}, {SEEDS}, st AS (SELECT DISTINCT dst AS a, src AS b FROM e WHERE kind IN ('contains', 'calls', 'imports')),
w AS (SELECT id, 0 AS distance, [id] AS path FROM seeds UNION ALL SELECT st.b, w.distance + 1, list_append(w.path, st.b) FROM w JOIN st ON st.a = w.id WHERE w.distance < 3 AND NOT list_contains(w.path, st.b))
SELECT id, distance, array_to_string(path, ' > ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, path) AS rn FROM w) WHERE rn = 1"""
)
def shortest_evidence_paths(spark, d):
    g = graph.load(spark, d)
    return traversal.shortest_paths(g, seeds(g), depth=3, kinds=("contains", "calls", "imports"))


@query()
def discovered_tests(spark, d):
    """For every callable its tests over calls at any depth; the tables store no test roles, so every test node is a test case."""
    g = graph.load(spark, d)
    return traversal.discovered(g, traversal.callable_nodes(g).select("id"), case=F.col("is_test"))


@query()
def discovered_code(spark, d):
    """For every callable the code other than tests that it calls at any depth."""
    g = graph.load(spark, d)
    return traversal.discovered(g, traversal.callable_nodes(g).select("id"), inbound=False)


@query(
    f"""WITH {EDGES}, k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ({kinds(*graph.TEST_REACH)})), one AS (SELECT k.dst AS id, k.src AS test FROM k JOIN n ON n.id = k.src WHERE n.is_test),
both_hops AS (SELECT id, test, 1 AS hops FROM one UNION ALL SELECT k.dst, one.test, 2 FROM one JOIN k ON k.src = one.id)
SELECT id, count(*) AS n_tests, min(hops) AS nearest FROM (SELECT id, test, min(hops) AS hops FROM both_hops GROUP BY id, test) GROUP BY id"""
)
def covering_tests(spark, d):
    t = traversal.covering_tests(graph.load(spark, d), graph.TEST_REACH)
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n_tests"), F.min("hops").alias("nearest"))


def _module_tasks(g):
    m = g.nodes.filter("kind = 'component'").select("id")
    home = g.nodes.select("id", F.concat(F.lit("component:"), F.substring_index("path", "/", 2)).alias("c"))
    a, b = home.select(F.col("id").alias("src"), F.col("c").alias("x")), home.select(F.col("id").alias("dst"), F.col("c").alias("y"))
    # later components need earlier ones that they refer to, which leaves no circle
    return m, g.keys.join(a, "src").join(b, "dst").filter("x > y").select(F.col("x").alias("id"), F.col("y").alias("needs")).distinct()


@query(
    f"""WITH RECURSIVE {EDGES}, t AS (SELECT id FROM n WHERE kind = 'component'), h AS (SELECT id, 'component:' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS c FROM n),
d AS (SELECT DISTINCT a.c AS id, b.c AS needs FROM e JOIN h a ON a.id = e.src JOIN h b ON b.id = e.dst WHERE a.c > b.c AND a.c IN (SELECT id FROM t) AND b.c IN (SELECT id FROM t)),
w AS (SELECT id, 0 AS wave FROM t WHERE id NOT IN (SELECT id FROM d) UNION SELECT d.id, w.wave + 1 FROM w JOIN d ON d.needs = w.id)
SELECT t.id, max(w.wave) AS wave FROM t LEFT JOIN w USING (id) GROUP BY t.id"""
)
def dependency_waves(spark, d):
    g = graph.load(spark, d)
    tasks, needs = _module_tasks(g)
    return traversal.waves(tasks, needs)


@query(f"WITH {EDGES} SELECT id, name, path FROM n WHERE kind IN ({CALLABLE}) AND NOT coalesce(is_test, false) AND id NOT IN (SELECT dst FROM e JOIN n t ON t.id = e.src WHERE e.kind = 'calls' AND t.is_test)")
def untested(spark, d):
    return usage.untested(graph.load(spark, d))


@query(f"WITH {EDGES} SELECT id, name, path FROM n WHERE kind IN ({CALLABLE}) AND {ENTRY} IS NULL AND id NOT IN (SELECT dst FROM e WHERE kind = 'calls')")
def unwired(spark, d):
    return usage.unwired(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, k AS (SELECT id, CASE kind WHEN 'module' THEN 2 WHEN 'class' THEN 1 WHEN 'struct' THEN 3 WHEN 'function' THEN 4 WHEN 'field' THEN 5 END AS registered, CASE kind WHEN 'variable' THEN 0 WHEN 'enum' THEN 1 END AS own FROM n),
r AS (SELECT id, own AS rank FROM k UNION ALL SELECT e.dst, k.registered FROM e JOIN k ON k.id = e.src WHERE e.kind = 'handles' AND f.confidence = 'exact' UNION ALL SELECT dst, 2 FROM e WHERE kind = 'references' AND f.confidence = 'exact' UNION ALL SELECT dst, 5 FROM e WHERE kind = 'mutates' AND f.confidence = 'exact')
SELECT id, min(rank) AS rank, ['test', 'main', 'http_route', 'mcp_tool', 'cli_command', 'event_handler'][min(rank) + 1] AS category FROM r WHERE rank IS NOT NULL AND id IN (SELECT id FROM n) GROUP BY id"""
)
def entry_ranks(spark, d):
    """The tables have no registrations, so kinds of nodes and edges stand for these."""
    g = graph.load(spark, d)
    as_kind = F.create_map(*[F.lit(x) for p in (("module", "route"), ("class", "main_registration"), ("struct", "tool_registration"), ("function", "cli_command_registration"), ("field", "event_handler_registration")) for x in p])
    details = F.when(F.col("kind") == "variable", '{"entrypoint":"test"}').when(F.col("kind") == "enum", '{"entrypoint":"main"}')
    nodes = g.nodes.withColumn("details", details).withColumn("kind", F.try_element_at(as_kind, F.col("kind")))
    kind = F.when(F.col("kind") == "references", "routes_to").when(F.col("kind") == "mutates", "listens_to").when(F.col("kind") == "handles", "handles").otherwise("other")
    return usage.entry_ranks(dataclasses.replace(g, nodes=nodes, edges=g.edges.withColumn("kind", kind)))


@query(
    f"""WITH {EDGES}, s AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS scope, id FROM n WHERE path IS NOT NULL),
u AS (SELECT src AS "user", dst AS id FROM e WHERE kind NOT IN ('contains', 'references_doc', {REVERSE}) UNION SELECT dst, src FROM e WHERE kind IN ({REVERSE})),
x AS (SELECT s.scope, count(*) AS n FROM u JOIN s ON s.id = u.id WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.id = u."user" AND z.scope = s.scope) GROUP BY s.scope),
y AS (SELECT s.scope, count(*) AS n FROM o JOIN s ON s.id = o.src WHERE o.dst IS NULL GROUP BY s.scope),
er AS (SELECT DISTINCT path, run_id, digest FROM files WHERE status = 'error' AND path IS NOT NULL), z AS (SELECT p.scope, count(*) AS n FROM (SELECT DISTINCT s.scope, n.path FROM s JOIN n USING (id)) p JOIN er USING (path) GROUP BY p.scope)
SELECT s.scope, count(*) AS n_nodes, coalesce(max(x.n), 0) AS n_dependents, coalesce(max(y.n), 0) AS n_unresolved, coalesce(max(z.n), 0) AS n_errors, max(x.n) IS NULL AND max(y.n) IS NULL AND max(z.n) IS NULL AS safe FROM s LEFT JOIN x USING (scope) LEFT JOIN y USING (scope) LEFT JOIN z USING (scope) GROUP BY s.scope"""
)
def removal_blockers(spark, d):
    g = graph.load(spark, d)
    scopes = g.nodes.filter(F.col("path").isNotNull()).select(F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))).alias("scope"), "id")
    return usage.removal(g, scopes, _errors(spark, d)[0])


_GOVERN = f"""{EDGES}, dr AS (SELECT DISTINCT dst AS id, src AS governor FROM e WHERE kind = 'governs'),
tr AS (SELECT DISTINCT e.src AS id, dr.governor FROM e JOIN dr ON dr.id = e.dst WHERE e.kind = 'calls' EXCEPT SELECT id, governor FROM dr),
gv AS (SELECT id, governor, 'direct' AS relation FROM dr UNION ALL SELECT id, governor, 'transitive' FROM tr)"""


@query(f"WITH {_GOVERN} SELECT id, governor, relation FROM gv")
def governing_invariants(spark, d):
    return usage.governing(graph.load(spark, d))


@query(
    f"""WITH {_GOVERN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id, relation ORDER BY governor) AS INTEGER) AS rank, count(*) OVER (PARTITION BY id, relation) AS c FROM gv)
SELECT id, relation, rank, governor, greatest(c - 5, 0) AS omitted FROM r WHERE rank <= 5"""
)
def governing_page(spark, d):
    return usage.governing_page(graph.load(spark, d))


@query(f"WITH {EDGES} SELECT dst AS id, src AS document FROM e WHERE kind IN ('documents', 'governs') UNION SELECT src, dst FROM e WHERE kind = 'governed_by'")
def affected_docs(spark, d):
    return usage.related_documents(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, {ALL} SELECT src AS id, 'outgoing' AS direction, kind, dst AS other, occurrence_count, f.confidence AS confidence FROM e WHERE src IN (SELECT id FROM seeds)
UNION ALL SELECT dst, 'incoming', kind, src, occurrence_count, f.confidence FROM e WHERE dst IN (SELECT id FROM seeds)"""
)
def explain_edges(spark, d):
    g = graph.load(spark, d)
    return usage.explain(g, g.nodes.select("id"))


@query(f"WITH {EDGES} SELECT dst AS id, min(src) AS container FROM e WHERE kind = 'contains' GROUP BY dst")
def containers(spark, d):
    return usage.containers(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, c AS (SELECT DISTINCT dst AS id, src AS caller FROM e WHERE kind = 'calls'), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY caller) AS rank, count(*) OVER (PARTITION BY id) AS n_callers FROM c)
SELECT id, n_callers, string_agg(caller, ', ' ORDER BY rank) FILTER (WHERE rank <= 5) AS callers FROM r GROUP BY id, n_callers"""
)
def call_previews(spark, d):
    return usage.call_previews(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, c AS (SELECT DISTINCT src AS id, dst AS callee FROM e WHERE kind = 'calls'), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY callee) AS rank, count(*) OVER (PARTITION BY id) AS n_callees FROM c)
SELECT id, n_callees, string_agg(callee, ', ' ORDER BY rank) FILTER (WHERE rank <= 5) AS callees FROM r GROUP BY id, n_callees"""
)
def callee_previews(spark, d):
    return usage.call_previews(graph.load(spark, d), callees=True)


@query(
    f"""WITH {EDGES}, b AS (SELECT dst AS id, 'implementors' AS relation, src AS other FROM e WHERE kind IN ({SUB}) UNION SELECT src, 'implements', dst FROM e WHERE kind IN ({SUB}))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id, relation ORDER BY other) AS INTEGER) AS place FROM b) WHERE place <= 50"""
)
def type_relations(spark, d):
    return usage.type_relations(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, c AS (SELECT e.dst AS id, count(DISTINCT n.path) AS k FROM e JOIN n ON n.id = e.src WHERE e.kind = 'calls' AND NOT coalesce(n.is_test, false) GROUP BY e.dst)
SELECT n.id, coalesce(k, 0) AS n_files FROM n LEFT JOIN c USING (id) WHERE n.kind IN ({CALLABLE})"""
)
def caller_files(spark, d):
    return usage.outside_callers(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, a AS (SELECT n.path, count(*) AS n_edges, count(*) FILTER (WHERE e.kind = 'calls') AS n_callers, count(*) FILTER (WHERE e.kind IN ({SUB})) AS n_implementations, count(*) FILTER (WHERE e.kind = 'governs') AS n_invariants FROM e JOIN n ON n.id = e.dst GROUP BY n.path)
SELECT b.path, b.n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_callers, 0) AS n_callers, coalesce(n_implementations, 0) AS n_implementations, coalesce(n_invariants, 0) AS n_invariants
FROM (SELECT path, count(*) AS n_nodes FROM n GROUP BY path) b LEFT JOIN a USING (path)"""
)
def read_signals(spark, d):
    return usage.signals(graph.load(spark, d))


_DOCS_OF = "rd AS (SELECT dst AS id, src AS document FROM e WHERE kind IN ('documents', 'governs') UNION SELECT src, dst FROM e WHERE kind = 'governed_by')"


@query(f"WITH {EDGES}, {_DOCS_OF} SELECT * FROM (SELECT rd.id, document, n.kind = 'invariant' AS is_invariant, CAST(row_number() OVER (PARTITION BY rd.id ORDER BY n.kind = 'invariant' DESC, n.path, document) AS INTEGER) AS place FROM rd JOIN n ON n.id = rd.document) WHERE place <= 30")
def symbol_documents(spark, d):
    return usage.symbol_documents(graph.load(spark, d))


@query(f"WITH {EDGES} SELECT e.src AS document, n.id, n.name, n.kind, n.path, n.line, f.line AS citation_line FROM e JOIN n ON n.id = e.dst WHERE e.kind = 'documents'")
def document_symbols(spark, d):
    return usage.document_symbols(graph.load(spark, d))


@query(f"WITH {EDGES}, x AS (SELECT src, dst, f.line AS line FROM e WHERE kind = 'governed_by') SELECT x.src AS document, 'cites' AS direction, x.dst AS other, n.path, x.line FROM x JOIN n ON n.id = x.dst UNION ALL SELECT x.dst, 'cited_by', x.src, n.path, x.line FROM x JOIN n ON n.id = x.src")
def document_citations(spark, d):
    """The tables have no citations; governed_by stands for these."""
    return usage.citations(graph.load(spark, d), "governed_by")


@query(
    f"""WITH {EDGES}, {_DOCS_OF}, dr AS (SELECT DISTINCT document AS id FROM rd WHERE id IN (SELECT id FROM n WHERE starts_with(path, 'tidewater-index/'))), pa AS (SELECT DISTINCT path FROM n WHERE id IN (SELECT id FROM dr))
SELECT id, path, line, id IN (SELECT id FROM dr) AS is_direct FROM n WHERE kind IN ('document', 'invariant') AND path IN (SELECT path FROM pa)"""
)
def scope_documents(spark, d):
    return usage.scope_documents(graph.load(spark, d), "tidewater-index")


@query(f"WITH {NODES} SELECT id, kind, path, line FROM n WHERE {PUBLIC} AND NOT coalesce(is_test, false) AND kind IN ({CALLABLE}, {TYPES}) ORDER BY path, line, id LIMIT 15")
def public_symbols(spark, d):
    return usage.public_symbols(graph.load(spark, d), "")


@query(f"WITH {EDGES} SELECT count(*) FILTER (WHERE {ENTRY} IS NULL) AS n_unwired, count(*) FILTER (WHERE {ENTRY} IS NOT NULL) AS n_entrypoints FROM n WHERE kind IN ({CALLABLE}) AND id NOT IN (SELECT dst FROM e WHERE kind = 'calls')")
def unwired_summary(spark, d):
    return usage.unwired_summary(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ({kinds(*graph.TEST_REACH)})), one AS (SELECT k.dst AS id, k.src AS test FROM k JOIN n ON n.id = k.src WHERE n.is_test),
tt AS (SELECT id, test FROM one UNION SELECT k.dst, one.test FROM one JOIN k ON k.src = one.id), tc AS (SELECT id, count(*) AS c FROM tt GROUP BY id),
i AS (SELECT dst AS id, count(*) FILTER (WHERE kind = 'calls') AS a, count(*) FILTER (WHERE kind IN ({SUB})) AS b FROM e GROUP BY dst)
SELECT n.id, coalesce(a, 0) AS n_callers, coalesce(b, 0) AS n_implementations, coalesce(c, 0) AS n_tests FROM n LEFT JOIN i USING (id) LEFT JOIN tc USING (id)"""
)
def graph_pulse(spark, d):
    g = graph.load(spark, d)
    return usage.pulse(g, g.nodes)


@query(
    f"""WITH RECURSIVE {EDGES}, st AS (SELECT DISTINCT src AS a, dst AS b, kind FROM e WHERE kind IN ({kinds(*graph.TEST_REACH)})), w AS (SELECT id, 0 AS distance FROM n WHERE is_test UNION SELECT st.b, w.distance + 1 FROM w JOIN st ON st.a = w.id WHERE w.distance < 8),
r AS (SELECT id, min(distance) AS distance FROM w GROUP BY id), v AS (SELECT st.b AS id, min((st.a, st.kind)) AS m FROM st JOIN r p ON p.id = st.a JOIN r c ON c.id = st.b AND c.distance = p.distance + 1 GROUP BY st.b)
SELECT r.id, r.distance, v.m[1] AS via, v.m[2] AS via_kind FROM r LEFT JOIN v ON v.id = r.id AND r.distance > 0 WHERE r.id IN (SELECT id FROM n WHERE {PUBLIC})"""
)
def seam_reachability(spark, d):
    g = graph.load(spark, d)
    return traversal.seams(g, g.nodes.filter(graph.is_public()))


# -- modules

_DIR = "regexp_replace(path, '/?[^/]*$', '')"
_MODULE = f"array_to_string(string_split({_DIR}, '/')[1:2], '/')"
_LINKS = f"{EDGES}, m AS (SELECT id, {_MODULE} AS m FROM n), l AS (SELECT a.m AS source, b.m AS target, e.kind, e.src, e.dst FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst)"


@query(
    f"""WITH {_LINKS}, b AS (SELECT m AS module, count(*) AS n_nodes FROM m GROUP BY m), i AS (SELECT source AS module, count(*) AS internal FROM l WHERE source = target GROUP BY 1),
x AS (SELECT source AS module, count(*) AS outgoing FROM l WHERE source <> target GROUP BY 1), y AS (SELECT target AS module, count(*) AS incoming FROM l WHERE source <> target GROUP BY 1),
t AS (SELECT module, n_nodes, coalesce(internal, 0) AS internal, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM b LEFT JOIN i USING (module) LEFT JOIN x USING (module) LEFT JOIN y USING (module))
SELECT *, CASE WHEN internal + outgoing + incoming > 0 THEN internal::DOUBLE / (internal + outgoing + incoming) END AS cohesion,
CASE WHEN outgoing = 0 AND incoming = 0 THEN 'isolated' WHEN incoming = 0 THEN 'source' WHEN outgoing = 0 THEN 'sink' ELSE 'hub' END AS role FROM t"""
)
def module_topology(spark, d):
    return boundary.topology(graph.load(spark, d))


@query(
    f"""WITH {_LINKS}, k AS (SELECT source, target, kind, count(*) AS c FROM l WHERE source <> target GROUP BY ALL)
SELECT source, target, CAST(sum(c) AS BIGINT) AS n_edges, first(kind ORDER BY c DESC, kind) AS dominant_kind FROM k GROUP BY source, target"""
)
def module_edges_dominant(spark, d):
    return boundary.module_links(graph.load(spark, d))


@query(f"WITH {_LINKS} SELECT target AS module, dst AS id, count(DISTINCT src) AS n_callers FROM l WHERE source <> target AND dst IN (SELECT id FROM n WHERE {PUBLIC}) GROUP BY target, dst")
def boundary_exports(spark, d):
    return boundary.exports(graph.load(spark, d))


@query(
    f"""WITH {_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY dst, src, kind) AS rank FROM l WHERE source <> target)
SELECT source, target, count(*) AS n_edges, string_agg(src || ' ' || kind || ' ' || dst, '; ' ORDER BY rank) FILTER (WHERE rank <= 5) AS examples FROM r GROUP BY source, target"""
)
def boundary_modules_topk(spark, d):
    return boundary.examples(graph.load(spark, d))


@query(
    f"""WITH {EDGES}, x AS (SELECT id, path = 'tidewater-index' OR starts_with(path, 'tidewater-index/') AS inside, {_DIR} AS folder FROM n),
a AS (SELECT CASE WHEN s.inside THEN 'outbound' ELSE 'inbound' END AS direction, CASE WHEN s.inside THEN t.folder ELSE s.folder END AS module, e.src, e.kind, e.dst FROM e JOIN x s ON s.id = e.src JOIN x t ON t.id = e.dst WHERE s.inside <> t.inside),
r AS (SELECT *, row_number() OVER (PARTITION BY direction, module ORDER BY CASE WHEN direction = 'outbound' THEN dst ELSE src END, CASE WHEN direction = 'outbound' THEN src ELSE dst END, kind) AS rank FROM a)
SELECT direction, module, count(*) AS n_edges, string_agg(src || ' ' || kind || ' ' || dst, '; ' ORDER BY rank) FILTER (WHERE rank <= 5) AS examples FROM r GROUP BY direction, module"""
)
def boundary_contract(spark, d):
    return boundary.contract(graph.load(spark, d), "tidewater-index")


@query(f"WITH {NODES} SELECT CASE WHEN kind IN ('module', 'file') THEN 0 ELSE 1 END AS first, id, kind, path, line FROM n WHERE path = 'tidewater-index' OR starts_with(path, 'tidewater-index/')")
def directory_members(spark, d):
    return boundary.members(graph.load(spark, d), "tidewater-index")


@query(f"WITH {NODES}, p AS (SELECT string_split({_DIR}, '/') AS parts FROM n WHERE contains(path, '/')), x AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p) SELECT array_to_string(parts[1:i], '/') AS directory, count(*) AS n_nodes FROM x GROUP BY 1")
def directory_counts(spark, d):
    return boundary.directories(graph.load(spark, d))


_SCC = f"""WITH RECURSIVE {EDGES}, k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('calls', 'imports') AND starts_with(dst, 'external:') = false), reach AS (SELECT src, dst FROM k UNION SELECT r.src, k.dst FROM reach r JOIN k ON k.src = r.dst),
c AS (SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src), z AS (SELECT component, count(*) AS size FROM c GROUP BY component)"""


@query(f"{_SCC} SELECT component, id, size FROM c JOIN z USING (component)")
def scc_cycles(spark, d):
    return boundary.cycles(graph.load(spark, d))


@query(f"{_SCC} SELECT component, size FROM z ORDER BY size DESC, component LIMIT 5")
def largest_cycles(spark, d):
    return boundary.largest_cycles(graph.load(spark, d))


# -- duplicates


@query(
    f"""WITH f AS (SELECT right(lower(digest), 64) AS digest, {_PATH} AS path, max(coalesce(size, 0)) AS size FROM files WHERE digest IS NOT NULL AND path IS NOT NULL GROUP BY ALL)
SELECT digest, count(*) AS n_files, max(size) AS size, max(size) * (count(*) - 1) AS duplicated_bytes FROM f GROUP BY digest HAVING count(*) > 1"""
)
def dup_files(spark, d):
    return duplicates.duplicate_files(table(spark, d, "files"))


@query("WITH t AS (SELECT DISTINCT doc_id, sha256(text) AS text_digest FROM documents WHERE text IS NOT NULL) SELECT text_digest, count(*) AS n_rows, min(doc_id) AS \"first\" FROM t GROUP BY 1 HAVING count(*) > 1")
def dup_documents(spark, d):
    return duplicates.duplicate_texts(table(spark, d, "documents"), "doc_id", "text")


_BODIES = f"""{NODES}, t AS (SELECT path, max(content) AS content FROM file_texts WHERE content IS NOT NULL GROUP BY path),
b AS (SELECT id, name, list_filter(list_transform(string_split(regexp_replace(content, '\r\n?', '\n', 'g'), '\n')[line:end_line], lambda x: trim(x, ' ')), lambda x: x <> '') AS body FROM n JOIN t USING (path) WHERE end_line IS NOT NULL AND line >= 1 AND end_line >= line)"""


@query(f"WITH {_BODIES}, h AS (SELECT id, len(body) AS n_lines, sha256(array_to_string(body, '\n')) AS body_digest FROM b WHERE len(body) >= 3) SELECT body_digest, count(*) AS n_symbols, max(n_lines) AS n_lines, min(id) AS \"first\" FROM h GROUP BY 1 HAVING count(*) > 1")
def dup_symbols_exact(spark, d):
    return duplicates.duplicate_symbols(duplicates.symbol_bodies(table(spark, d, "nodes"), table(spark, d, "file_texts"), min_lines=3))


@query()
def dup_symbols_near(spark, d):
    return duplicates.near_clones(duplicates.symbol_bodies(table(spark, d, "nodes"), table(spark, d, "file_texts"), min_lines=3))


# -- coverage and diagnostics

_COV = f"""{NODES}, {OCC}, ln AS (SELECT owner_path, lower(language) AS language, count(*) AS c FROM n WHERE language IS NOT NULL GROUP BY ALL), lg AS (SELECT owner_path, first(language ORDER BY c DESC, language) AS language FROM ln GROUP BY owner_path),
cov AS (SELECT o.owner_path, o.ordinal, o.line, o.kind, coalesce(lg.language, 'unknown') AS language,
  CASE WHEN dst IS NULL THEN 'unresolved' WHEN starts_with(dst, 'external:') THEN 'external' WHEN confidence = 'possible' THEN 'ambiguous' ELSE 'resolved' END AS status,
  o.dst AS expression, o.evidence FROM o LEFT JOIN lg USING (owner_path))"""
_PIVOT = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in diagnostics.STATUSES)


@query(f"WITH {_COV} SELECT owner_path, language, status, count(*) AS n FROM cov GROUP BY ALL")
def coverage_counts(spark, d):
    return diagnostics.coverage_counts(diagnostics.coverage(graph.load(spark, d)))


@query(f"WITH {_COV}, p AS (SELECT language, {_PIVOT} FROM cov GROUP BY language) SELECT *, CASE WHEN resolved + unresolved + ambiguous > 0 THEN resolved * 100.0::DOUBLE / (resolved + unresolved + ambiguous) END AS health FROM p")
def coverage_by_language(spark, d):
    return diagnostics.by_language(diagnostics.coverage(graph.load(spark, d)))


# what the resolver would have said for each short word of the tables
_SAID = {
    "receiver": "computed receiver or dynamic callee; callable identity is unknown", "type hint": "callee is shadowed by a parameter or local binding of unknown callable identity", "import table": "call through external import {}",
    "string literal": "import {}: 1 modules, 0 alias targets", "doc link": "no indexed provider for absolute import {}", "ast:name": "0 lexically justified candidates; {}", "ast:attribute": "diagnostic_reason=framework_magic {}",
}
_TOLD = f"""{_COV}, told AS (SELECT * EXCLUDE (evidence), CASE evidence {' '.join(f"WHEN '{k}' THEN replace('{v}', '{{}}', kind)" for k, v in _SAID.items())} ELSE 'analysis gap: nothing noted' END AS evidence FROM cov),
cz AS (SELECT *, CASE WHEN status = 'ambiguous' THEN 'ambiguous_candidates' WHEN starts_with(evidence, 'computed receiver') THEN 'dynamic_callee' WHEN starts_with(evidence, 'callee is shadowed by') THEN 'shadowed_binding' WHEN starts_with(evidence, 'call through external import ') THEN 'external_import_call'
  WHEN regexp_full_match(evidence, 'import .*: 1 modules, 0 alias targets') THEN 'alias_target_missing' WHEN starts_with(evidence, 'no indexed provider') THEN 'missing_indexed_import' WHEN starts_with(evidence, '0 lexically') THEN 'no_lexical_candidate' ELSE 'other' END AS cause FROM told),
rz AS (SELECT *, CASE WHEN status = 'ambiguous' THEN 'ambiguous_candidates' WHEN contains(evidence, 'framework_magic') THEN 'framework_magic' WHEN starts_with(evidence, 'callee is shadowed') AND contains(coalesce(expression, ''), '.') THEN 'unresolved_receiver_type' WHEN starts_with(evidence, 'callee is shadowed') THEN 'dynamic_callback'
  WHEN starts_with(evidence, 'call through') THEN 'external_unindexed' WHEN status <> 'resolved' THEN 'unknown' END AS reason FROM cz)"""


def _told(spark, d):
    cov = diagnostics.coverage(graph.load(spark, d))
    said = None
    for word, text in _SAID.items():
        here, t = F.col("evidence") == word, F.replace(F.lit(text), F.lit("{}"), F.col("kind"))
        said = F.when(here, t) if said is None else said.when(here, t)
    return cov.withColumn("evidence", said.otherwise("analysis gap: nothing noted"))


@query(f"WITH {_TOLD} SELECT status, cause, count(*) AS n, count(DISTINCT owner_path) AS n_files FROM cz WHERE status IN ('unresolved', 'ambiguous') GROUP BY ALL")
def resolution_causes(spark, d):
    return diagnostics.causes(_told(spark, d))


@query(f"WITH {_TOLD} SELECT owner_path, ordinal, cause, reason FROM rz")
def diagnostic_reasons(spark, d):
    return diagnostics.explained(_told(spark, d)).select("owner_path", "ordinal", "cause", "reason")


@query(
    f"""WITH {_TOLD}, c AS (SELECT unnest(['dynamic_callback', 'unresolved_receiver_type', 'framework_magic', 'external_unindexed', 'ambiguous_candidates', 'shadowed_binding', 'unknown']) AS reason), s AS (SELECT unnest(['resolved', 'external', 'ambiguous', 'unresolved']) AS status)
SELECT c.reason, s.status, count(rz.owner_path) AS n, count(DISTINCT rz.owner_path) AS n_files FROM c CROSS JOIN s LEFT JOIN rz ON rz.reason = c.reason AND rz.status = s.status GROUP BY ALL"""
)
def reason_matrix_zero_fill(spark, d):
    return diagnostics.reason_matrix(_told(spark, d))


@query(f"WITH {_TOLD}, x AS (SELECT n.id, n.path, t.line, t.expression, t.evidence FROM told t JOIN n ON n.path = t.owner_path AND t.line BETWEEN n.line AND n.end_line WHERE starts_with(t.evidence, 'analysis gap:')) SELECT * FROM x")
def analysis_gaps(spark, d):
    return diagnostics.analysis_gaps(graph.load(spark, d).nodes, _told(spark, d))


@query(
    f"""WITH {_COV}, i AS (SELECT DISTINCT path, line, end_line FROM n WHERE kind = 'impl' AND end_line >= line)
SELECT CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.path = cov.owner_path AND cov.line BETWEEN i.line AND i.end_line) THEN 'javascript' ELSE language END AS language, status, count(*) AS n FROM cov GROUP BY ALL"""
)
def island_languages(spark, d):
    """Blocks of the kind impl stand for islands of another language."""
    g = graph.load(spark, d)
    islands = g.nodes.filter("kind = 'impl'").select("path", F.col("line").alias("first"), F.col("end_line").alias("last"))
    return diagnostics.with_islands(diagnostics.coverage(g), islands).groupBy("language", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_COV}, u AS (SELECT path, name, qualname, id, kind, line, end_line, count(*) OVER (PARTITION BY path, name) AS nn, count(*) OVER (PARTITION BY path, qualname) AS nq FROM n),
x AS (SELECT DISTINCT owner_path AS path, line FROM o WHERE line IS NOT NULL)
SELECT x.path, x.line, first(u.kind ORDER BY u.end_line - u.line, u.id) AS kind, first(CASE WHEN nn = 1 THEN name WHEN nq = 1 THEN qualname ELSE u.id END ORDER BY u.end_line - u.line, u.id) AS name
FROM x JOIN u ON u.path = x.path AND x.line BETWEEN u.line AND u.end_line WHERE u.kind IN ('function', 'method', 'struct', 'class', 'trait', 'interface', 'enum') GROUP BY ALL"""
)
def enclosing_names(spark, d):
    g = graph.load(spark, d)
    return diagnostics.enclosing_names(g.nodes, g.occurrences.select(F.col("owner_path").alias("path"), "line"))


_CHANGED = "rg AS (SELECT DISTINCT owner_path AS path, line AS a, line + 3 AS b FROM o WHERE kind = 'mutates' AND line IS NOT NULL), cs AS (SELECT DISTINCT n.id, n.path FROM rg JOIN n ON n.path = rg.path AND n.kind NOT IN ('module', 'file') AND n.line <= rg.b AND n.end_line >= rg.a)"


def _ranges(g):
    """The lines around every mutation stand for changed ranges."""
    return g.occurrences.filter("kind = 'mutates' AND line IS NOT NULL").select(F.col("owner_path").alias("path"), F.col("line").alias("start"), (F.col("line") + 3).alias("end"))


@query(f"WITH {EDGES}, {_CHANGED} SELECT * FROM cs")
def changed_symbols(spark, d):
    g = graph.load(spark, d)
    return diagnostics.changed_symbols(g.nodes, _ranges(g))


@query(f"WITH {EDGES}, {_CHANGED} SELECT path, a AS start, b AS \"end\" FROM rg WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = rg.path AND n.kind NOT IN ('module', 'file') AND n.line <= rg.b AND n.end_line >= rg.a)")
def unmapped_changes(spark, d):
    g = graph.load(spark, d)
    return diagnostics.unmapped_changes(g.nodes, _ranges(g))


@query(
    "SELECT x.*, coalesce(n.is_test, false) AS is_test FROM ("
    + _walk_sql(True, 2, FORWARD, REVERSE).replace(SEEDS, _CHANGED + ", seeds AS (SELECT id FROM cs)")
    + ") x JOIN (SELECT DISTINCT * FROM nodes) n ON n.id = x.id"
)
def change_impact(spark, d):
    g = graph.load(spark, d)
    return traversal.change_impact(g, diagnostics.changed_symbols(g.nodes, _ranges(g)), depth=2)


@query(f"WITH {_COV} SELECT owner_path, count(*) AS n FROM cov WHERE status IN ('unresolved', 'ambiguous') GROUP BY 1 ORDER BY n DESC, owner_path LIMIT 5")
def top_files(spark, d):
    return diagnostics.worst_files(diagnostics.coverage(graph.load(spark, d)))


_ERRORS = "er AS (SELECT DISTINCT path, run_id AS line, 'digest ' || coalesce(digest, 'none') AS message FROM files WHERE status = 'error' AND path IS NOT NULL), fl AS (SELECT path, min(CASE lower(coalesce(language, 'unknown')) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' ELSE lower(coalesce(language, 'unknown')) END) AS language FROM files WHERE path IS NOT NULL GROUP BY path)"
_CHECKED = ("python", "rust", "typescript", "go")


def _errors(spark, d):
    """Failed writes of the log stand for syntax errors."""
    f = table(spark, d, "files")
    bad = f.filter((F.col("status") == "error") & F.col("path").isNotNull())
    return bad.select("path", F.col("run_id").alias("line"), F.concat(F.lit("digest "), F.coalesce("digest", F.lit("none"))).alias("message")).distinct(), diagnostics.file_languages(f)


@query(f"WITH {_ERRORS} SELECT language, count(*) AS n_errors, count(DISTINCT path) AS n_files FROM er JOIN fl USING (path) GROUP BY language")
def parse_error_languages(spark, d):
    return diagnostics.parse_errors(*_errors(spark, d))


@query(f"WITH {_ERRORS} SELECT 'syntax.parse' AS rule_id, 'error' AS severity, language, path, line, substr(message, 1, 512) AS message, length(message) > 512 AS message_truncated FROM er JOIN fl USING (path) WHERE language IN ({kinds(*_CHECKED)})")
def lint_errors(spark, d):
    return diagnostics.lint(*_errors(spark, d), _CHECKED)


@query(f"WITH {_ERRORS}, m AS (SELECT path, count(*) AS c FROM er GROUP BY path) SELECT language, count(*) AS n_files, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_errors, CASE WHEN coalesce(sum(c), 0) > 0 THEN 'diagnostics_found' ELSE 'no_stored_syntax_diagnostics' END AS status FROM fl LEFT JOIN m USING (path) WHERE language IN ({kinds(*_CHECKED)}) AND (path = 'tidewater-index' OR starts_with(path, 'tidewater-index/')) GROUP BY language")
def lint_summary(spark, d):
    return diagnostics.lint_summary(*_errors(spark, d), _CHECKED, scope="tidewater-index")


@query(f"WITH {_COV}, {_ERRORS}, m AS (SELECT owner_path, 1 AS c FROM cov WHERE status IN ('unresolved', 'ambiguous') UNION ALL SELECT path, 1 FROM er) SELECT owner_path, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, owner_path LIMIT 5")
def top_files_with_errors(spark, d):
    errors = _errors(spark, d)[0].groupBy(F.col("path").alias("owner_path")).agg(F.count(F.lit(1)).alias("n"))
    return diagnostics.worst_files(diagnostics.coverage(graph.load(spark, d)), errors)


@query(
    f"""WITH {_COV}, w AS (SELECT *, CASE WHEN split_part(owner_path, '/', 1) < 'm' THEN split_part(owner_path, '/', 1) ELSE 'primary' END AS workspace FROM cov), a AS (SELECT DISTINCT workspace FROM w UNION SELECT 'primary' UNION SELECT 'nowhere')
SELECT workspace, count(status) AS n, {', '.join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in diagnostics.STATUSES)},
CASE WHEN count(*) FILTER (WHERE status IN ('resolved', 'unresolved', 'ambiguous')) > 0 THEN count(*) FILTER (WHERE status = 'resolved') * 100.0::DOUBLE / count(*) FILTER (WHERE status IN ('resolved', 'unresolved', 'ambiguous')) END AS health FROM a LEFT JOIN w USING (workspace) GROUP BY workspace"""
)
def coverage_by_workspace(spark, d):
    """Repositories up to the letter l stand for linked workspaces; one of these has no paths."""
    cov = diagnostics.coverage(graph.load(spark, d))
    repo = F.substring_index("owner_path", "/", 1)
    placed = cov.withColumn("owner_path", F.when(repo < "m", F.concat(F.lit("["), repo, F.lit("]/"), "owner_path")).otherwise(F.col("owner_path")))
    linked = cov.filter(repo < "m").select(repo.alias("name")).distinct().union(spark.createDataFrame([("nowhere",)], "name string"))
    return diagnostics.by_workspace(placed, linked)


@query(f"WITH {_COV} SELECT split_part(owner_path, '/', 1) AS repo, count(*) AS n, count(DISTINCT owner_path) AS n_files, {_PIVOT} FROM cov GROUP BY 1")
def coverage_by_repo(spark, d):
    return diagnostics.by_directory(diagnostics.coverage(graph.load(spark, d)))


@query(
    f"""WITH {EDGES} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(DISTINCT owner_path) FROM n) AS n_files, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM o) AS n_occurrences,
(SELECT count(*) FROM o WHERE starts_with(dst, 'external:')) AS n_external, (SELECT count(*) FROM o WHERE dst IS NULL) AS n_unresolved"""
)
def index_counts(spark, d):
    return diagnostics.index_counts(graph.load(spark, d))


@query(
    """WITH f AS (SELECT DISTINCT * FROM files), s AS (SELECT *, lower(coalesce(language, 'unknown')) AS l FROM f)
SELECT CASE l WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' ELSE l END AS language, status, count(*) AS n, count(DISTINCT path) AS n_paths FROM s GROUP BY ALL"""
)
def status_counts(spark, d):
    return diagnostics.status_counts(table(spark, d, "files"))


_SPAN = "JOIN n ON n.path = cov.owner_path AND n.end_line IS NOT NULL AND n.end_line >= n.line AND cov.line BETWEEN n.line AND n.end_line"


@query(f"WITH {_COV} SELECT n.id, status, count(*) AS n FROM cov {_SPAN} GROUP BY ALL")
def coverage_in_span(spark, d):
    return diagnostics.in_span(graph.load(spark, d))


@query(f"WITH {_COV} SELECT cov.owner_path, cov.ordinal, first(n.id ORDER BY n.end_line - n.line, n.id) AS id FROM cov {_SPAN} GROUP BY ALL")
def innermost_symbol(spark, d):
    return diagnostics.innermost(graph.load(spark, d))


@query(f"WITH {NODES} SELECT owner_path, id, line FROM (SELECT *, row_number() OVER (PARTITION BY owner_path ORDER BY line, id) AS rn FROM n) WHERE rn = 1")
def doc_hubs(spark, d):
    return diagnostics.first_of_file(graph.load(spark, d))


@query(
    f"""WITH {NODES}, w AS (SELECT DISTINCT name FROM n WHERE name IS NOT NULL), k AS (SELECT id, qualname AS name, 0 AS priority FROM n UNION ALL SELECT id, name, 1 FROM n UNION ALL SELECT id, split_part(qualname, '.', -1), 2 FROM n WHERE contains(qualname, '.')),
p AS (SELECT name, priority, count(DISTINCT id) AS n_candidates, min(id) AS id FROM k JOIN w USING (name) GROUP BY ALL)
SELECT name, priority, n_candidates, CASE WHEN n_candidates = 1 THEN id END AS id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority) AS rn FROM p) WHERE rn = 1"""
)
def doc_reference_candidates(spark, d):
    n = graph.load(spark, d).nodes
    return selectors.suffix_references(n, n.select("name"))


# -- commitments and maintenance


_N_ROW = "to_json({'id': id, 'kind': kind, 'name': name, 'qualname': qualname, 'path': path, 'line': line, 'end_line': end_line, 'is_test': is_test, 'language': language, 'generated': generated, 'details': details})"
_O_ROW = "to_json({'ordinal': ordinal, 'src': src, 'kind': kind, 'dst': dst, 'line': line, 'evidence': evidence, 'confidence': confidence})"
_LEAVES = f"""{NODES}, {OCC}, h AS (SELECT DISTINCT 'nodes' AS domain, owner_path AS owner, sha256({_N_ROW}::VARCHAR) AS h FROM n UNION SELECT DISTINCT 'occurrences', owner_path, sha256({_O_ROW}::VARCHAR) FROM o),
pg AS (SELECT domain, owner, substr(h, 1, 3) AS page, sha256(string_agg(h, '' ORDER BY h)) AS p, count(*) AS c FROM h GROUP BY ALL),
lf AS (SELECT domain, coalesce(owner, '') AS owner, CAST(sum(c) AS BIGINT) AS n_rows, sha256(string_agg(p, '' ORDER BY page)) AS digest FROM pg GROUP BY domain, owner)"""


@query(f"WITH {_LEAVES} SELECT * FROM lf")
def commitment_leaves(spark, d):
    g = graph.load(spark, d)
    return commitments.graph_leaves(g.nodes, g.occurrences)


@query(
    f"""WITH {_LEAVES}, dh AS (SELECT domain, sha256(owner || chr(0) || digest) AS h FROM lf), dp AS (SELECT domain, substr(h, 1, 3) AS page, sha256(string_agg(h, '' ORDER BY h)) AS p FROM dh GROUP BY ALL), dd AS (SELECT domain, sha256(string_agg(p, '' ORDER BY page)) AS digest FROM dp GROUP BY domain)
SELECT sha256(string_agg(domain || chr(0) || digest, chr(0) ORDER BY domain || chr(0) || digest) || chr(0)) AS root FROM dd"""
)
def commitment_root(spark, d):
    g = graph.load(spark, d)
    return commitments.root(commitments.domain_digests(commitments.graph_leaves(g.nodes, g.occurrences)))


@query(
    f"""WITH {NODES}, w AS (SELECT id, regexp_extract_all(translate(lower(coalesce(name, '')), '{_ACCENTED}', '{_PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(translate(lower(coalesce(path, '')), '{_ACCENTED}', '{_PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS b FROM n),
t AS (SELECT id, 'name' AS c, unnest(a) AS term, unnest(range(len(a))) AS place FROM w UNION ALL SELECT id, 'path', unnest(b), unnest(range(len(b))) FROM w),
h AS (SELECT DISTINCT id AS owner, sha256(to_json({{'column': c, 'term': term, 'place': place}})::VARCHAR) AS h FROM t), pg AS (SELECT owner, substr(h, 1, 3) AS page, sha256(string_agg(h, '' ORDER BY h)) AS p, count(*) AS c FROM h GROUP BY ALL)
SELECT 'postings' AS domain, owner, CAST(sum(c) AS BIGINT) AS n_rows, sha256(string_agg(p, '' ORDER BY page)) AS digest FROM pg GROUP BY owner"""
)
def posting_leaves(spark, d):
    return commitments.posting_leaves(graph.load(spark, d).nodes, "id", ["name", "path"])


@query(f"WITH {NODES}, h AS (SELECT id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(id) + 1), lambda i: ord(substr(id, i::INTEGER, 1))::HUGEINT)), lambda x, b: (xor(x, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM n) SELECT id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS hash FROM h")
def node_hashes(spark, d):
    return graph.load(spark, d).nodes.select("id", fnv1a(F.col("id")).alias("hash"))


def _change(spark, d):
    """The index before test files were added, and the files added: a change every data set has."""
    occ = graph.load(spark, d).occurrences
    added = occ.filter(is_test_path(F.col("owner_path"))).select("owner_path").distinct()
    return occ, occ.join(added, "owner_path", "left_anti"), added


@query(f"WITH {EDGES} SELECT src, kind, dst, occurrence_count, f.path AS path, f.line AS line, f.evidence AS evidence, f.confidence AS confidence FROM e")
def changed_edge_reaggregate(spark, d):
    new, old, owners = _change(spark, d)
    return delta.refresh_edges(graph.edge_table(old), old, new, owners)


@query(
    f"""WITH RECURSIVE {NODES}, {OCC}, u AS (SELECT DISTINCT o.owner_path, n.owner_path AS target FROM o JOIN n ON n.id = o.dst WHERE o.kind IN ('imports', 'includes', 'renders', 'possible_calls') AND o.owner_path <> n.owner_path),
w AS (SELECT DISTINCT owner_path FROM o WHERE {" OR ".join(["regexp_matches(owner_path, '(^|/)tests?(/|$)')", "starts_with(split_part(owner_path, '/', -1), 'test_')", "ends_with(split_part(owner_path, '/', -1), '_test.go')", "contains(split_part(owner_path, '/', -1), '.test.')", "contains(split_part(owner_path, '/', -1), '.spec.')"])}
UNION SELECT u.owner_path FROM w JOIN u ON u.target = w.owner_path) SELECT owner_path FROM w"""
)
def affected_owner_closure(spark, d):
    g = graph.load(spark, d)
    _, _, added = _change(spark, d)
    return delta.affected_owners(g.occurrences, g.nodes, added)


QUERIES = Q
