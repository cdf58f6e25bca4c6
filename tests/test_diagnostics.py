from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions.text import fnv1a
from graphloom.operators import diagnostics, graph, traversal, usage

COV = "owner_path string, ordinal long, line long, kind string, language string, status string, evidence string, expression string, path string"
NODES = "id string, kind string, name string, qualname string, path string, line long, end_line long, is_test boolean, language string, generated boolean, details string, owner_path string"


def cov(spark, *data):
    return spark.createDataFrame([("f", i, i, "calls", "html", *x, "") for i, x in enumerate(data)], COV).drop("path")


def test_causes_and_reasons(spark):
    shadow = "callee is shadowed by a parameter or local binding of unknown callable identity"
    c = cov(
        spark, ("ambiguous", "anything", None), ("unresolved", "computed receiver or dynamic callee; callable identity is unknown", "f"), ("unresolved", shadow, "a.b"), ("unresolved", shadow, None), ("unresolved", "Call through external import x", "x"),
        ("external", "call through external import x", "x"), ("unresolved", "import a.b: 1 modules, 0 alias targets", "x"), ("unresolved", "import a.b: 0 modules, 3 alias targets", "x"), ("unresolved", "no indexed provider for absolute import q", "x"),
        ("unresolved", "0 lexically justified candidates; none", "x"), ("resolved", None, None), ("resolved", "note diagnostic_reason=framework_magic", "x"), (None, None, None),
    )
    got = [tuple(r) for r in diagnostics.explained(c).orderBy("ordinal").select("cause", "reason").collect()]
    assert got == [
        ("ambiguous_candidates", "ambiguous_candidates"), ("dynamic_callee", "unknown"), ("shadowed_binding", "unresolved_receiver_type"), ("shadowed_binding", "dynamic_callback"), ("external_import_call", "external_unindexed"),
        ("external_import_call", "external_unindexed"), ("alias_target_missing", "unknown"), ("missing_indexed_import", "unknown"), ("missing_indexed_import", "unknown"), ("no_lexical_candidate", "unknown"), ("other", None), ("other", "framework_magic"), ("other", None),
    ]
    m = {(r["reason"], r["status"]): r["n"] for r in diagnostics.reason_matrix(c).collect()}
    assert len(m) == 28 and m["unknown", "unresolved"] == 5 and m["shadowed_binding", "resolved"] == 0


def test_islands(spark):
    c = cov(spark, *[("resolved", None, None)] * 4)
    islands = spark.createDataFrame([("f", 1, 2), ("f", 2, 2), ("f", 9, 3), ("g", 0, 9)], "path string, first long, last long")
    assert rows(diagnostics.with_islands(c, islands), "ordinal", "language") == [(0, "html"), (1, "javascript"), (2, "javascript"), (3, "html")]


def node(i, kind, name, a, b, **more):
    d = dict(id=i, kind=kind, name=name, qualname=f"m.{name}", path="f", line=a, end_line=b, is_test=False, language="python", generated=False, details=None, owner_path="f") | more
    return tuple(d[c.split()[0]] for c in NODES.split(", "))


def test_gaps_and_enclosing_names(spark):
    nodes = spark.createDataFrame([node("1", "class", "A", 1, 200), node("2", "method", "run", 2, 5, qualname="A.run"), node("3", "method", "run", 7, 9, qualname="B.run"), node("4", "method", "x", 11, 12, qualname="same"), node("5", "method", "x", 13, 14, qualname="same"), node("6", "variable", "v", 3, 3), node("7", "function", "open", 20, None)], NODES)
    places = spark.createDataFrame([("f", 3), ("f", 6), ("f", 11), ("f", 130), ("f", 999), ("f", None), ("g", 3), ("f", 3)], "path string, line long")
    assert rows(diagnostics.enclosing_names(nodes, places)) == [("f", 11, "method", "4"), ("f", 130, "class", "A"), ("f", 3, "method", "A.run"), ("f", 6, "class", "A")]
    c = spark.createDataFrame([("f", 0, 3, "calls", "python", "unresolved", "Analysis gap: why", "e", ""), ("f", 1, 3, "calls", "python", "unresolved", "other", "e", "")], COV)
    assert rows(diagnostics.analysis_gaps(nodes, c), "id", "expression") == [("1", "e"), ("2", "e"), ("6", "e")]


def test_changed_ranges(spark):
    nodes = spark.createDataFrame([node("m", "module", "f", 1, 300), node("a", "function", "a", 10, 80), node("b", "function", "b", 90, 90)], NODES)
    ranges = spark.createDataFrame([("f", 1, 10), ("f", 81, 89), ("f", 85, 200), ("f", 5, 4), ("g", 1, 2), ("f", 1, 10)], "path string, start long, end long")
    assert rows(diagnostics.changed_symbols(nodes, ranges)) == [("a", "f"), ("b", "f")]
    assert rows(diagnostics.unmapped_changes(nodes, ranges)) == [("f", 5, 4), ("f", 81, 89), ("g", 1, 2)]


def test_lint_and_parse_errors(spark):
    errors = spark.createDataFrame([("a.py", 1, "x" * 600), ("a.py", 1, None), ("b.rs", 2, "y"), ("gone", 1, "z")], "path string, line long, message string")
    files = spark.createDataFrame([("a.py", "PY"), ("a.py", None), ("b.rs", "rust"), ("c.md", "md"), (None, "go")], "path string, language string")
    lang = diagnostics.file_languages(files)
    assert rows(lang) == [("a.py", "python"), ("b.rs", "rust"), ("c.md", "markdown")]
    assert rows(diagnostics.parse_errors(errors, lang)) == [("python", 2, 1), ("rust", 1, 1)]
    got = diagnostics.lint(errors, lang, ("python",))
    assert {(len(r["message"] or ""), r["message_truncated"]) for r in got.collect()} == {(512, True), (0, False)}
    assert {len(r["message"] or "") for r in diagnostics.lint(errors, lang, ("python",), full=True).collect()} == {600, 0}
    assert rows(diagnostics.lint_summary(errors, lang, ("python", "markdown"))) == [("markdown", 1, 0, "no_stored_syntax_diagnostics"), ("python", 1, 2, "diagnostics_found")]


def test_workspaces(spark):
    c = spark.createDataFrame([(p, i, 1, "calls", "go", s, None, None, "") for i, (p, s) in enumerate([("[lib]/a", "resolved"), ("[lib]/b", "unresolved"), ("[other]/c", "external"), ("d", "resolved")])], COV)
    linked = spark.createDataFrame([("lib",), ("empty",), (None,)], "name string")
    assert rows(diagnostics.by_workspace(c, linked), "workspace", "n", "health") == [("empty", 0, None), ("lib", 2, 50.0), ("primary", 2, 100.0)]


def test_entry_categories(spark):
    nodes = spark.createDataFrame([node("t", "function", "t", 1, 2, details='{"entrypoint":"cli_command"}'), node("u", "function", "u", 1, 2, details='{"entrypoint":"unheard of"}'), node("r", "route", "r", 1, 1), node("v", "function", "v", 1, 2)], NODES)
    occ = spark.createDataFrame([("f", 0, "r", "handles", "t", 1, "", "exact"), ("f", 1, "r", "handles", "u", 1, "", "possible"), ("f", 2, "u", "listens_to", "v", 1, "", "exact"), ("f", 3, "u", "routes_to", "external:x", 1, "", "exact")], "owner_path string, ordinal long, src string, kind string, dst string, line long, evidence string, confidence string")
    assert rows(usage.entry_ranks(graph.graph(nodes, occ))) == [("t", 2, "http_route"), ("v", 5, "event_handler")]


def test_wave_clashes(spark):
    placed = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", None)], "id string, wave int")
    scopes = spark.createDataFrame([("a", "src/**"), ("b", "src/x"), ("c", "src/x/y"), ("d", "src")], "owner string, scope string")
    assert rows(traversal.wave_clashes(placed, scopes)) == [(0, "a", "b")]


def test_fnv1a(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,), ("é",)], "t string")
    got = [r["h"] for r in df.select(fnv1a(F.col("t")).alias("h")).collect()]
    assert got[:4] == [0xCBF29CE484222325 - (1 << 64), 0xAF63DC4C8601EC8C - (1 << 64), 0x85944171F73967E8 - (1 << 64), None]
