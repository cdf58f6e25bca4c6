import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions.text import name_parts, route, slug
from graphloom.operators import search
from graphloom.sources import code, markdown, workspace


@pytest.fixture()
def tree(tmp_path):
    for name, text in {"src/a.py": "import os\n", "src/b.rs": "fn main() {}\n", "docs/x.md": "# T\n", "skip/c.py": "x = 1\n", "big.txt": "y" * 100}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_scan_globs_limits_and_reuse(spark, tree):
    df = workspace.scan(spark, tree, include=["**/*.py", "**/*.rs", "*.txt"], exclude=["skip/**"], max_file=50)
    assert rows(df, "path", "language", "status") == [("big.txt", None, "skipped"), ("src/a.py", "python", "indexed"), ("src/b.rs", "rust", "indexed")]
    again, kept = workspace.unchanged(df, df.filter("path <> 'src/a.py'"))
    assert rows(again, "path") == [("src/a.py",)] and kept.count() == 2


def test_lines_and_search(spark):
    t = spark.createDataFrame([("a", "one\r\ntwo\nthree\n"), ("a", "one\r\ntwo\nthree\n"), ("b", None), ("c", ""), (None, "two")], "path string, content string")
    assert rows(workspace.lines(t)) == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three"), ("a", 4, ""), ("c", 1, "")]
    assert rows(workspace.search_lines(t, "t", context=1), "line", "is_match") == [(1, False), (2, True), (3, True), (4, False)]
    assert workspace.search_lines(t, "t.", literal=True).count() == 0


def test_publish_swaps_the_pointer(spark, tmp_path):
    df = spark.range(3)
    workspace.publish({"t": df}, str(tmp_path), "1")
    workspace.publish({"t": df.union(df)}, str(tmp_path), "2", expected="1")
    assert spark.read.parquet(workspace.current(spark, str(tmp_path))["path"] + "/t").count() == 6
    with pytest.raises(RuntimeError):
        workspace.publish({"t": df}, str(tmp_path), "3", expected="1")


def test_sections_links_and_symbols(spark):
    text = "---\ntitle: X\n---\nintro\n# One\nsee [a](b.md#two) and [[Wiki|w]] `graph.load()`\n```\n# no heading\n```\n## Two ##\n- INVARIANT: ids are unique\n# One\n"
    df = markdown.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert rows(df, "ordinal", "title", "level", "line") == [(0, None, 0, 4), (1, "One", 1, 5), (2, "Two", 2, 10), (3, "One", 1, 12)]
    assert rows(df.filter("ordinal = 1"), "links", "wikilinks", "symbols") == [(["b.md#two"], ["Wiki"], ["graph.load"])]
    assert rows(df.filter("ordinal = 2"), "invariants") == [(["ids are unique"],)]
    assert rows(markdown.anchors(df), "anchor") == [("one",), ("one-1",), ("two",)]


def test_broken_links(spark):
    docs = spark.createDataFrame([("d/a.md", "# A\n[x](b.md#here) [y](../top.md) [z](gone.md) [w](#a) [v](b.md#lost) [u](https://x.example)"), ("d/b.md", "# Here"), ("top.md", "")], "path string, text string")
    got = markdown.broken_links(markdown.sections(docs, "path"), docs.select("path"))
    assert rows(got) == [("d/a.md", "b.md#lost", "no such anchor"), ("d/a.md", "gone.md", "no such file")]


def test_python_facts_and_structure():
    source = "import os.path\nfrom a import b\nclass C(D):\n    @p\n    def f(self):\n        '''Doc.'''\n        return g(h(1))\n"
    got = {(r["sort"], r["name"]) for r in code.python_facts("x.py", source)}
    assert {("imports", "os.path"), ("imports", "a.b"), ("class", "C"), ("inherits", "D"), ("function", "C.f"), ("decorates", "p"), ("calls", "g"), ("calls", "h")} <= got
    assert code.python_facts("x.py", "def")[0]["sort"] == "error"
    assert [m[0] for m in code.matches("$A + $A", "x + x\nx + y\n")] == [1]
    assert [m[2] for m in code.matches("f(1, $$$REST)", "f(1)\nf(1, 2, b)\nf(2)")] == ['{"REST": ""}', '{"REST": "2, b"}']


def test_sql_uses():
    got = code.sql_uses("WITH q AS (SELECT * FROM base) SELECT * FROM q JOIN s.other o ON 1=1 -- FROM no\n; INSERT INTO t SELECT 'from x' FROM a, b; CREATE TABLE IF NOT EXISTS n (x INT REFERENCES r(x)); DELETE FROM z")
    assert [(u, t) for u, t, _ in got] == [("queries_table", "base"), ("queries_table", "s.other"), ("mutates_table", "t"), ("queries_table", "a"), ("queries_table", "b"), ("defines_table", "n"), ("references_table", "r"), ("mutates_table", "z")]


def test_manifests():
    assert code.manifest("x/Cargo.toml", '[package]\nname="a"\nversion="1"\n[dependencies]\nserde="1"')["dependencies"] == ["serde"]
    assert code.manifest("package.json", '{"name":"p","workspaces":["a/*"],"dependencies":{"q":"1"}}')["members"] == ["a/*"]
    assert code.manifest("pyproject.toml", '[project]\nname="p"\ndependencies=["numpy>=1"]')["dependencies"] == ["numpy"]
    assert code.manifest("go.mod", "module m.example/x\nrequire a.example/b v1.0.0\n")["name"] == "m.example/x"
    assert code.manifest("Cargo.toml", "broken [") is None and code.manifest("other.txt", "") is None


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTPServer_loadBucket2", "/Api/Users/42/:id/", "Hello, World! A-b")], "n string, r string, t string")
    assert rows(df, name_parts(df.n), route(df.r), slug(df.t)) == [(["http", "server", "load", "bucket2"], "/api/users/{param}/{param}", "hello-world-a-b")]


def test_bm25_order_and_empty_query(spark):
    docs = spark.createDataFrame([(1, "Graph guide", "x"), (2, "", "graph graph text"), (3, "", "other text"), (4, None, None), (5, "", "more words here"), (6, "", "and again more")], "doc_id long, title string, body string")
    got = search.search_documents(docs, "the graph guide", top=5).collect()
    assert [r["key"] for r in got] == [1, 2]
    assert search.search_documents(docs, "?!").count() == 0


def test_declared_types(spark):
    data = [("a", '{"signature": "fn a(x: u8) -> Vec<T> where T: C", "return_type": "Vec<T>", "param_types": {"x": "u8"}}'), ("b", "{broken"), ("c", None), ("d", '{"param_types": {"y": "Big_Type"}}')]
    data += [("e", '{"signature": "def e(cb: Callable[[int], (str)] = (lambda x: x)) -> dict[str, int]:"}'), ("f", '{"signature": "f(cb: (x) => y): Promise<Z>"}'), ("g", '{"signature": "no parameters -> x"}')]
    df = spark.createDataFrame(data, "id string, details string").withColumn("language", F.lit("typescript"))
    assert rows(search.declared_types(df)) == [("a", "Vec<T>"), ("e", "dict[str, int]"), ("f", "Promise<Z>")]
    assert rows(search.declared_types(df.withColumn("language", F.lit("rust")))) == [("a", "Vec<T>"), ("e", "dict[str, int]")]
    assert rows(search.taking_or_returning(df, returns="vec*")) == [("a",)]
    assert rows(search.taking_or_returning(df, takes="big_type")) == [("d",)]
    assert rows(search.taking_or_returning(df, returns="*", takes="u8")) == [("a",)]


SYMBOLS = "id string, kind string, name string, qualname string, path string, line long, language string, details string"


def symbols(spark):
    d = '{"param_types": {"x": "Order"}, "return_type": "Bill Order", "doc": "charges a customer", "decorators": ["cached"]}'
    data = [("1", "function", "process", "m.process", "m/a.py", 1, "python", d), ("2", "class", "Order", "m.Order", "m/a.py", 9, "python", None), ("3", "method", "process_work", "m.W.process_work", "m/b.py", 2, "python", "{broken"), ("4", "document", "process", "process", "m/doc.md", 1, "markdown", None), ("5", "module", "b.py", "m/b.py", "m/b.py", 1, "python", '{"references": ["charge.customer"]}'), ("6", None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SYMBOLS)


def found(spark, asked, **scope):
    keys = spark.createDataFrame([("3", "calls", "1"), ("5", "contains", "3")], "src string, kind string, dst string")
    got = search.search_symbols(symbols(spark), keys, asked, **scope).join(symbols(spark).select("id", "path", "line"), "id")
    return [(r["id"], r["reason"], r["boost"]) for r in got.orderBy(*[F.expr(x.removesuffix(" DESC")).desc() if x.endswith("DESC") else F.expr(x) for x in search.SYMBOL_ORDER]).collect()]


def test_symbol_search_takes_exact_names_first(spark):
    assert found(spark, "PROCESS") == [("1", "exact_name", 50)]
    assert [x[0] for x in found(spark, "process", include_docs=True)] == ["1", "4"]
    assert found(spark, "m.W.process_work") == [("3", "exact_qualified_name", 0)]


def test_a_type_that_symbols_take_is_no_exact_name_only(spark):
    assert {x[0] for x in found(spark, "order")} == {"1", "2"}


def test_symbol_search_by_all_terms_any_term_and_indexed_text(spark):
    assert [x[0] for x in found(spark, "proc")] == ["1", "3"]
    assert found(spark, "charges_customer") == [("1", "indexed_text", 50)]
    assert [x[0] for x in found(spark, "charges_zebra")] == ["1"]
    assert {x[0] for x in found(spark, "customer work")} == {"1", "3", "5"}
    assert found(spark, "zebra") == []
    with pytest.raises(ValueError):
        found(spark, "??")


def test_symbol_search_within_kind_and_path(spark):
    assert [x[0] for x in found(spark, "work process", kind="function")] == ["3", "1"]
    assert [x[0] for x in found(spark, "work process", path="m/b.py")] == ["3"]
    assert [x[0] for x in found(spark, "cached")] == ["1"]


def test_component_paths(spark):
    paths = spark.createDataFrame([("r/app/docs/x.md",), ("z/app/y.md",)], "path string")
    assert search.component_path(paths, "r/app/") == "r/app"
    assert search.component_path(paths, "app") == "r/app"
    assert search.component_path(paths, "short", {"short": "Team"}, {"r/team/": "team"}) == "r/team"
    assert search.component_path(paths, "unknown") == "unknown"


def test_document_search_filters(spark):
    data = [(1, "graph", "x", "guide", "r/a.md"), (2, "", "graph", "contract", "r/b.md"), (3, "", "graph", "guide", "r/Archive/c.md"), (4, "", "graph the", None, None)] + [(k, "", "other", "guide", "r/x.md") for k in range(5, 12)]
    docs = spark.createDataFrame(data, "doc_id long, title string, body string, doc_type string, path string")
    assert {r["key"] for r in search.search_documents(docs, "graph").collect()} == {1, 2}
    assert {r["key"] for r in search.search_documents(docs, "graph", doc_type="guide", component="r").collect()} == {1}
    assert {r["key"] for r in search.search_documents(docs, "graph", component="r/archive").collect()} == set()
    assert search.search_documents(docs, "the of and").count() == 0


def test_two_writers_of_one_generation(spark, tmp_path):
    df = spark.range(3)
    workspace.publish({"t": df}, str(tmp_path), "1")
    state = workspace.current(spark, str(tmp_path))
    workspace.point(spark, str(tmp_path), state, {"generation": "2", "path": "x"})
    with pytest.raises(RuntimeError):
        workspace.point(spark, str(tmp_path), state, {"generation": "3", "path": "y"})
    assert workspace.current(spark, str(tmp_path))["generation"] == "2"


def test_sql_in_code(spark):
    texts = [("a.py", 'x = 1\nq = "SELECT a FROM t JOIN s.u ON 1 = 1"\nz = """\n  DELETE FROM v"""\ny = "from here select"\n'), ("b.rs", "let q = \"INSERT INTO w (a) VALUES (1)\"; // 'SELECT 1 FROM no'"), ("c.sql", "SELECT 1 FROM no"), ("d.go", None)]
    got = code.extract_embedded_sql(spark.createDataFrame(texts, "path string, content string"))
    assert rows(got) == [("a.py", "mutates_table", "v", 4), ("a.py", "queries_table", "s.u", 2), ("a.py", "queries_table", "t", 2), ("b.rs", "mutates_table", "w", 1)]


def test_front_matter_names_the_type(spark):
    texts = [("a.md", "---\ndoc_type: decision\ntitle: 'T'\n---\n# x"), ("docs/contracts/b.md", "# x"), ("c.md", None)]
    got = markdown.typed_documents(spark.createDataFrame(texts, "path string, content string"))
    assert rows(got) == [("a.md", "decision", "T", None), ("c.md", "guide", None, None), ("docs/contracts/b.md", "contract", None, None)]


def test_links_with_escapes_and_line_anchors(spark):
    texts = [("d/a.md", "# A b\n[x](b%20c.md) [y](../e.py#L2-L3) [z](../e.py#L9) [w](b%20c.md#gone) [v](#a-b) [u](../e.py#L3-L2) [t](bad%zz.md)"), ("d/b c.md", "# B"), ("e.py", "1\n2\n3")]
    df = spark.createDataFrame(texts, "path string, content string")
    n = df.select("path", F.size(F.split("content", "\n")).cast("long").alias("n_lines"))
    got = markdown.broken_links(markdown.sections(df.filter("path LIKE '%.md'"), "path", "content"), df.select("path"), n_lines=n)
    assert rows(got, "link", "problem") == [("../e.py#L3-L2", "no such lines"), ("../e.py#L9", "no such lines"), ("b%20c.md#gone", "no such anchor"), ("bad%zz.md", "no such file")]


def test_freshness_of_an_index(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, digest string")
    was = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("c", None)], "path string, digest string")
    changes = workspace.stale(now, was)
    assert rows(changes) == [("b", "changed"), ("d", "removed")]
    assert [workspace.plan_refresh(changes, share, 4) for share in (0.5, 0.2)] == ["delta", "rebuild"] and workspace.plan_refresh(changes.limit(0), 0.2, 4) == "fresh"


def test_read_modes(spark, tmp_path):
    texts = spark.createDataFrame([("a", "1\n2\n3\n4\n5\n6")], "path string, content string")
    nodes = spark.createDataFrame([("x", "a", 1, 2, "function", "f"), ("y", "a", 4, 5, "function", "g"), ("z", "a", 6, None, "class", "h")], "id string, path string, line long, end_line long, kind string, name string")
    assert rows(workspace.previews(texts, nodes), "id", "first", "text") == [("x", 1, "1\n2"), ("y", 3, "3\n4\n5")]
    assert [e["name"] for e in workspace.outline(nodes).first()["entries"]] == ["f", "g", "h"]
    assert rows(workspace.changed_lines(texts, spark.createDataFrame([("a", "1\n2\n3\n4\n5\n7\n7")], "path string, content string"))) == [("a", "6", "old", 1), ("a", "7", "new", 2)]
    at = workspace.export(texts, "path", str(tmp_path), "out/x")
    assert rows(spark.read.text(at)) == [("a",)]
    for name in ("/x", "../x", ""):
        with pytest.raises(ValueError):
            workspace.export(texts, "path", str(tmp_path), name)


def test_words_lose_their_marks(spark):
    df = spark.createDataFrame([("Ångström NAÏVE ø Ắ άλφα Ёлка x\u0301y",)], "t string")
    from graphloom.functions.text import words

    assert df.select(words(F.col("t")).alias("w")).first()["w"] == ["angstrom", "naive", "o", "a", "αλφα", "елка", "x", "y"]


def test_bounds_of_a_scan(spark):
    files = spark.createDataFrame([("a", 10, "indexed"), ("b", 99, "skipped")], "path string, size long, status string")
    workspace.check_bounds(files, 2, 10)
    for bound in ((1, 10), (2, 9)):
        with pytest.raises(ValueError):
            workspace.check_bounds(files, *bound)
    workspace.check_bounds(files.limit(0))
