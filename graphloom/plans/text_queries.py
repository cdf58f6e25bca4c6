"""Queries over symbols, documents and source texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.paths import normal_digest, normal_path
from graphloom.functions.text import _ACCENTED, _PLAIN, extension, first_sentence, name_parts, route, slug, words
from graphloom.operators import graph, paging, routes, search
from graphloom.plans.graph_queries import EDGES, NODES
from graphloom.plans.training_data import _PATH
from graphloom.sources import code, markdown, workspace
from graphloom.streaming import edges as stream
from graphloom.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark, d):
    return graph.load(spark, d).nodes


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{_ACCENTED}', '{_PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


_PARTS = r"array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ')"


def _bm25(index: str, terms: list[str]) -> str:
    """Common table expressions from ``index`` (key, term, weight of each occurrence) to sc (key, score, matched)."""
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""tok AS ({index}), ln AS (SELECT key, count(*) AS length FROM tok GROUP BY key), st AS (SELECT count(*) AS n_all, avg(length) AS mean FROM ln),
tf AS (SELECT key, term, sum(w) AS tf FROM tok WHERE term IN ({wanted}) GROUP BY key, term), df AS (SELECT term, count(*) AS c FROM tf GROUP BY term),
sc AS (SELECT key, sum(greatest(ln((n_all - c + 0.5) / (c + 0.5)), {search.LEAST_IDF}) * (tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / mean)))) AS score, count(*) AS matched
  FROM tf JOIN df USING (term) JOIN ln USING (key) CROSS JOIN st GROUP BY key)"""


_TITLED = "ti AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '(?m)^#+[ \\t]+(.*)$', 1) AS title, coalesce(text, '') AS body FROM documents)"
_DOC_INDEX = f"SELECT doc_id AS key, unnest({_words('title')}) AS term, 3.0::DOUBLE AS w FROM ti UNION ALL SELECT doc_id, unnest({_words('body')}), 1.0 FROM ti"
_ASKED = "How does the unresolved workspace inventory change before the next step?"
_ASKED_TERMS = search.query_terms(_ASKED, search.STOP_WORDS)


@query(f"WITH {_TITLED}, {_bm25(_DOC_INDEX, _ASKED_TERMS)} SELECT key, round(score, 6) AS score, matched, matched = {len(set(_ASKED_TERMS))} AS all_terms FROM sc")
def doc_bm25_weighted(spark, d):
    found = search.search_documents(search.titled(table(spark, d, "documents")), _ASKED)
    return found.select("key", F.round("score", 6).alias("score"), "matched", "all_terms")


@query(f"WITH {_TITLED}, {_bm25(_DOC_INDEX, _ASKED_TERMS)} SELECT key, round(score, 6) AS score, matched, matched = {len(set(_ASKED_TERMS))} AS all_terms FROM sc ORDER BY all_terms DESC, sc.score DESC, key LIMIT 20")
def doc_search_stopwords(spark, d):
    found = search.search_documents(search.titled(table(spark, d, "documents")), _ASKED, top=20)
    return found.select("key", F.round("score", 6).alias("score"), "matched", "all_terms")


_DOCS = _TITLED.replace("SELECT doc_id,", "SELECT doc_id, repo AS path, source AS doc_type,")


@query(
    f"""WITH {_DOCS}, {_bm25(_DOC_INDEX, _ASKED_TERMS)} SELECT key, round(score, 6) AS score, matched, matched = {len(set(_ASKED_TERMS))} AS all_terms,
substr(regexp_replace(substr(body, greatest(CASE WHEN strpos(lower(body), '{_ASKED_TERMS[0]}') > 0 THEN strpos(lower(body), '{_ASKED_TERMS[0]}') ELSE 0 END - 60, 1), 240), '\\s+', ' ', 'g'), 1, 240) AS excerpt
FROM sc JOIN ti ON ti.doc_id = sc.key WHERE doc_type = 'runbook' AND (path = 'tidewater-index' OR starts_with(path, 'tidewater-index/'))"""
)
def doc_search_filtered(spark, d):
    t = search.titled(table(spark, d, "documents"), "repo", "source")
    docs = t.withColumnRenamed("repo", "path").withColumnRenamed("source", "doc_type")
    found = search.search_documents(docs, _ASKED, doc_type="runbook", component=search.component_path(docs.select("path"), "tidewater-index/"))
    shown = docs.select(F.col("doc_id").alias("key"), search.snippet(F.col("body"), _ASKED_TERMS[0]).alias("excerpt"))
    return found.join(shown, "key").select("key", F.round("score", 6).alias("score"), "matched", "all_terms", "excerpt")


_SYMBOL = f"{NODES}, nm AS (SELECT id, kind, language, name, qualname, path, line, concat_ws(' ', name, qualname, path) AS text FROM n)"


def _symbol_sql(asked: str, where: str = "true") -> str:
    terms, low = search.query_terms(asked), asked.lower()
    n, natural = len(set(terms)), " " in asked
    base = f"CASE WHEN lower(name) = '{low}' OR lower(qualname) = '{low}' THEN 1000.0 WHEN starts_with(lower(name), '{low}') THEN 500.0 ELSE 0.0 END::DOUBLE"
    named = f"starts_with(lower(name), '{low}') OR lower(qualname) = '{low}'"
    hybrid = (
        f"SELECT id, path, line, name, qualname, {base} + CASE WHEN matched = {n} AND {n} > 1 THEN 250.0 ELSE 0.0 END::DOUBLE + coalesce(rel, 0) AS score FROM bo"
        if natural
        else f"SELECT id, path, line, name, qualname, {base} + CASE WHEN matched = {n} THEN rel ELSE 0 END AS score FROM sx UNION ALL SELECT id, path, line, name, qualname, {base} + coalesce(rel, 0) FROM bo WHERE NOT EXISTS (SELECT 1 FROM sx)"
    )
    return f"""WITH {EDGES.replace(NODES, _SYMBOL)}, {_bm25(f"SELECT id AS key, unnest({_words('text')}) AS term, 1.0::DOUBLE AS w FROM nm", terms)},
ow AS (SELECT * FROM nm WHERE language <> 'markdown' AND {where}),
ex AS (SELECT id, path, line, name, qualname, CASE WHEN lower(name) = '{low}' THEN 0.0 ELSE -2.0 END::DOUBLE AS score FROM ow WHERE lower(name) = '{low}' OR lower(qualname) = '{low}'),
bo AS (SELECT ow.*, sc.score AS rel, sc.matched FROM ow LEFT JOIN sc ON sc.key = ow.id WHERE sc.matched IS NOT NULL OR {named}),
sx AS (SELECT * FROM bo WHERE coalesce(matched = {n}, false) OR {named}),
hy AS ({hybrid}),
fo AS (SELECT id, path, line, name, qualname, round(score, 6) AS score FROM (SELECT * FROM ex UNION ALL SELECT * FROM hy WHERE NOT EXISTS (SELECT 1 FROM ex))),
wi AS (SELECT id FROM fo ORDER BY score DESC, path, line, id LIMIT 50)
SELECT id, score, CASE WHEN id IN (SELECT id FROM wi) AND id IN (SELECT dst FROM e WHERE kind NOT IN ('contains', 'documents', 'references_doc')) THEN 50 ELSE 0 END AS boost, id IN (SELECT id FROM wi) AS in_window,
  CASE WHEN lower(name) = '{low}' THEN 'exact_name' WHEN lower(qualname) = '{low}' THEN 'exact_qualified_name' WHEN starts_with(lower(name), '{low}') THEN 'name_prefix' WHEN contains(lower(name), '{low}') THEN 'name_fragment' ELSE 'indexed_text' END AS reason FROM fo"""


def _search(spark, d, asked, **scope):
    g = graph.load(spark, d)
    return search.search_symbols(g.nodes, g.triples, asked, **scope)


@query(_symbol_sql("load_bucket"))
def symbol_exact_first(spark, d):
    """The name exists, so that only symbols named so are the answer."""
    return _search(spark, d, "LOAD_bucket")


@query(_symbol_sql("load bucket page"))
def symbol_hybrid(spark, d):
    return _search(spark, d, "load bucket page")


@query(_symbol_sql("load_zebra_crossing"))
def symbol_fallback(spark, d):
    """No symbol has all the terms, so that those with any are given."""
    return _search(spark, d, "load_zebra_crossing")


@query(_symbol_sql("tidewater bucket", "kind IN ('function', 'method') AND (path = 'tidewater-index' OR starts_with(path, 'tidewater-index/'))"))
def symbol_scoped(spark, d):
    return _search(spark, d, "tidewater bucket", kind="method", path="tidewater-index")


@query(f"WITH {_SYMBOL} SELECT id, CASE WHEN starts_with(lower(name), 'load') THEN 500.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN starts_with(lower(name), 'load') THEN 'name_pattern' ELSE 'qualified_pattern' END AS reason FROM nm WHERE (starts_with(lower(name), 'load') OR starts_with(lower(qualname), 'load') OR contains(lower(qualname), '::load') OR contains(lower(qualname), '.load')) AND len(list_filter({_words('text')}, lambda x: starts_with(x, 'load'))) > 0")
def symbol_name_prefix(spark, d):
    return search.prefix_symbols(_nodes(spark, d), "load")


@query(f"WITH {NODES} SELECT id, CASE WHEN lower(name) = 'load_bucket' THEN 0 ELSE 2 END AS rank FROM n WHERE lower(name) = 'load_bucket' OR lower(qualname) = 'load_bucket'")
def symbol_exact(spark, d):
    return search.exact_symbols(_nodes(spark, d), "LOAD_bucket")


@query(f"WITH {NODES} SELECT id, CASE WHEN name ILIKE 'load\\_%' ESCAPE '\\' THEN 0 ELSE 1 END AS rank FROM n WHERE name ILIKE 'load\\_%' ESCAPE '\\' OR qualname ILIKE 'load\\_%' ESCAPE '\\'")
def symbol_prefix(spark, d):
    return search.wildcard_symbols(_nodes(spark, d), "load_*")


@query(f"WITH {NODES} SELECT id, CASE WHEN name ILIKE '%bucket%' THEN 0 ELSE 1 END AS rank FROM n WHERE name ILIKE '%bucket%' OR qualname ILIKE '%bucket%'")
def symbol_wildcard(spark, d):
    return search.wildcard_symbols(_nodes(spark, d), "*Bucket*")


@query(f"WITH {NODES} SELECT name, CAST(levenshtein(lower(name), 'laod_buckte') AS INTEGER) AS distance FROM (SELECT DISTINCT name FROM n WHERE name IS NOT NULL) ORDER BY distance, name LIMIT 5")
def name_suggestions(spark, d):
    return search.suggestions(_nodes(spark, d), "laod_buckte")


@query(f"WITH {NODES} SELECT part, count(DISTINCT id) AS n_nodes FROM (SELECT id, unnest(string_split({_PARTS}, ' ')) AS part FROM n WHERE name IS NOT NULL) WHERE part <> '' GROUP BY part")
def name_part_counts(spark, d):
    n = _nodes(spark, d)
    return n.select("id", F.explode(name_parts(F.col("name"))).alias("part")).groupBy("part").agg(F.count_distinct("id").alias("n_nodes"))


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY term")
def term_frequencies(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {NODES} SELECT id, 'Vec<' || kind || '>' AS return_type FROM n WHERE name IS NOT NULL")
def declared_return_types(spark, d):
    """The tables have no signatures; names and kinds make them."""
    sig = F.concat(F.lit("fn "), "name", F.lit("(cb: (x, [y]) -> z) -> Vec<"), "kind", F.lit("> where T: C"))
    return search.declared_types(_nodes(spark, d).withColumn("details", F.to_json(F.struct(sig.alias("signature")))).filter("name IS NOT NULL"))


@query(r"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE trim(regexp_extract(ltrim(text), '^([^\n]*)', 1)) END AS first_line FROM documents""")
def first_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_extract(F.ltrim("text"), "^([^\\n]*)", 1)).alias("first_line"))


@query(r"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE trim(CASE WHEN regexp_matches(split_part(ltrim(text, ' '), chr(10), 1), '[.!?](\s|$)') THEN regexp_extract(split_part(ltrim(text, ' '), chr(10), 1), '^.*?[.!?](\s|$)') ELSE split_part(ltrim(text, ' '), chr(10), 1) END, ' ') END AS sentence FROM documents")
def first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", first_sentence(F.col("text")).alias("sentence"))


# -- sections and links


def _sections(spark, d):
    return markdown.sections(table(spark, d, "documents"))


@query()
def doc_sections(spark, d):
    return _sections(spark, d).select("doc_id", "ordinal", "title", "level", "line", "body")


@query()
def doc_anchors(spark, d):
    return markdown.anchors(_sections(spark, d))


@query()
def dead_symbols(spark, d):
    return markdown.dead_symbols(_sections(spark, d), _nodes(spark, d))


def _md(spark, d):
    texts = table(spark, d, "file_texts").filter(F.col("path").endswith(".md"))
    return markdown.sections(texts, "path", "content")


_PARENT = "regexp_replace(regexp_replace(path, '/?[^/]*$', ''), '/?[^/]*$', '')"


@query(
    f"""WITH p AS (SELECT DISTINCT path FROM file_texts WHERE path IS NOT NULL), l AS (SELECT path, split_part(path, '/', -1) AS base, CASE WHEN {_PARENT} = '' THEN split_part(path, '/', -1) ELSE {_PARENT} || '/' || split_part(path, '/', -1) END AS above FROM p)
SELECT path || '.md' AS path, '../' || base AS link, 'no such file' AS problem FROM l WHERE above NOT IN (SELECT path FROM p) UNION ALL SELECT path || '.md', './' || base || '.md#gone', 'no such anchor' FROM l"""
)
def broken_links(spark, d):
    """The Markdown of the tables has no links: a page beside every file links to the file, to one above it, and to a lost anchor of its own."""
    p = table(spark, d, "file_texts").filter("path IS NOT NULL").select("path").distinct()
    base = F.substring_index("path", "/", -1)
    pages = p.select(F.concat("path", F.lit(".md")).alias("path"), F.concat(F.lit("# Page\n[a](../"), base, F.lit(") [b](./"), base, F.lit(") [c](./"), base, F.lit(".md#gone) [d](#page)")).alias("content"))
    return markdown.broken_links(markdown.sections(pages, "path", "content"), p.union(pages.select("path")))


@query("SELECT DISTINCT path, CASE WHEN regexp_matches(path, '(^|/)docs/(milestones|contracts)/') THEN 'contract' ELSE 'guide' END AS doc_type FROM files WHERE ends_with(path, '.md')")
def default_doc_types(spark, d):
    f = table(spark, d, "files").filter(F.col("path").endswith(".md"))
    return f.select("path", markdown.default_type(F.col("path")).alias("doc_type")).distinct()


@query(r"SELECT DISTINCT name, regexp_replace(regexp_replace(lower(trim(name)), '[^\p{L}\p{N}\s_-]', '', 'g'), '\s', '-', 'g') AS slug FROM nodes WHERE kind = 'document'")
def document_slugs(spark, d):
    return table(spark, d, "nodes").filter("kind = 'document'").select("name", slug(F.col("name")).alias("slug")).distinct()


# -- sources

_LINES = "t AS (SELECT DISTINCT * FROM file_texts WHERE path IS NOT NULL AND content IS NOT NULL), l AS (SELECT path, string_split(regexp_replace(content, '\r\n?', '\n', 'g'), '\n') AS ls FROM t)"


@query(f"WITH {_LINES} SELECT path, len(ls) AS n_lines, len(list_filter(ls, lambda x: trim(x) = '')) AS n_blank FROM l")
def line_counts(spark, d):
    l = workspace.lines(table(spark, d, "file_texts"))  # noqa: E741
    return l.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("text") == "").alias("n_blank"))


@query(
    f"""WITH {_LINES}, x AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM l), m AS (SELECT path, line FROM x WHERE regexp_matches(text, 'fn \\w+\\('))
SELECT DISTINCT x.path, CAST(x.line AS INTEGER) AS line, x.text, x.line IN (SELECT m.line FROM m WHERE m.path = x.path) AS is_match FROM x JOIN m ON m.path = x.path AND x.line BETWEEN m.line - 1 AND m.line + 1"""
)
def search_in_files(spark, d):
    return workspace.search_lines(table(spark, d, "file_texts"), "fn \\w+\\(", context=1)


@query("SELECT DISTINCT path, lower(regexp_extract(split_part(path, '/', -1), '\\.([^.]+)$', 1)) AS ending FROM files")
def file_endings(spark, d):
    return table(spark, d, "files").select("path", extension(F.col("path")).alias("ending")).distinct()


_LANG = "CASE lower(regexp_extract(split_part(path, '/', -1), '\\.([^.]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in workspace.ENDINGS.items()) + " END"


@query(f"WITH f AS (SELECT DISTINCT path FROM file_texts) SELECT {_LANG} AS language, count(*) AS n_files FROM f GROUP BY 1")
def languages_by_ending(spark, d):
    return table(spark, d, "file_texts").select("path").distinct().groupBy(workspace.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


_RECORDED = f"SELECT DISTINCT {_PATH} AS path, right(lower(digest), 64) AS digest FROM source_inventory WHERE digest IS NOT NULL"


@query(f"WITH t AS (SELECT DISTINCT path, sha256(content) AS digest FROM file_texts WHERE content IS NOT NULL), r AS ({_RECORDED}) SELECT t.path, t.digest, EXISTS (SELECT 1 FROM r WHERE r.path = t.path AND r.digest = t.digest) AS known FROM t")
def verified_sources(spark, d):
    t = table(spark, d, "file_texts").filter(F.col("content").isNotNull()).select("path", F.sha2("content", 256).alias("digest")).distinct()
    r = table(spark, d, "source_inventory").select(normal_path(F.col("path")).alias("path"), normal_digest(F.col("digest")).alias("digest")).dropna().distinct().withColumn("hit", F.lit(True))
    return t.join(r, ["path", "digest"], "left").select("path", "digest", F.coalesce("hit", F.lit(False)).alias("known"))


@query()
def python_facts(spark, d):
    return code.extract_python(table(spark, d, "file_texts"))


@query()
def sql_table_uses(spark, d):
    return code.extract_sql(table(spark, d, "file_texts"))


@query(f"WITH {NODES} SELECT DISTINCT path || '/Cargo.toml' AS path, name, '1.' || line AS version, 'a, b/*' AS members, 'dep-' || kind || ', tester' AS dependencies FROM n WHERE kind = 'component' AND path IS NOT NULL")
def manifest_components(spark, d):
    """The tables have no manifests; one is made for each component."""
    c = _nodes(spark, d).filter("kind = 'component' AND path IS NOT NULL")
    text = F.format_string('[package]\nname = "%s"\nversion = "1.%d"\n[workspace]\nmembers = ["a", "b/*"]\n[dependencies]\n"dep-%s" = "1"\n[dev-dependencies]\ntester = { path = "x" }\n', "name", "line", "kind")
    found = code.extract_manifests(c.select(F.concat("path", F.lit("/Cargo.toml")).alias("path"), text.alias("content")))
    return found.select("path", "name", "version", F.array_join("members", ", ").alias("members"), F.array_join("dependencies", ", ").alias("dependencies"))


@query(f"WITH {NODES} SELECT id || '.py' AS path, CASE WHEN is_test THEN 'mutates_table' ELSE 'queries_table' END AS use, 't_' || kind AS name, 2 AS line FROM n")
def embedded_sql_uses(spark, d):
    """The code of the tables has no SQL in it; a statement is made for each node."""
    n = _nodes(spark, d)
    text = F.concat(F.lit("# FROM nowhere\nq = '"), F.when(F.col("is_test"), F.concat(F.lit("UPDATE t_"), "kind", F.lit(" SET a = 1"))).otherwise(F.concat(F.lit("SELECT a FROM t_"), "kind", F.lit(" x"))), F.lit("'\n"))
    return code.extract_embedded_sql(n.select(F.concat("id", F.lit(".py")).alias("path"), text.alias("content")))


@query("SELECT doc_id::VARCHAR AS path, coalesce(source, 'guide') AS doc_type, 'About ' || coalesce(repo, 'nothing') AS title, NULL::VARCHAR AS status FROM documents")
def front_matter(spark, d):
    """Documents get their source as type in a front matter."""
    docs = table(spark, d, "documents")
    head = F.concat(F.lit("---\n"), F.when(F.col("source").isNotNull(), F.concat(F.lit("doc_type: "), "source", F.lit("\n"))).otherwise(""), F.lit("title: 'About "), F.coalesce("repo", F.lit("nothing")), F.lit("'\n---\n"), F.coalesce("text", F.lit("")))
    return markdown.typed_documents(docs.select(F.col("doc_id").cast("string").alias("path"), head.alias("content")))


@query(
    f"""WITH {NODES}, t AS (SELECT path, max(content) AS content FROM file_texts WHERE content IS NOT NULL GROUP BY path), s AS (SELECT * FROM n WHERE line >= 1 AND end_line >= line),
p AS (SELECT s.id, s.path, s.line, s.end_line, max(q.end_line) AS e FROM s LEFT JOIN s q ON q.path = s.path AND q.end_line < s.line AND q.end_line >= s.line - 3 GROUP BY ALL)
SELECT id, path, greatest(line - 3, coalesce(e + 1, 1), 1) AS first, end_line, array_to_string(string_split(regexp_replace(content, '\r\n?', '\n', 'g'), '\n')[greatest(line - 3, coalesce(e + 1, 1), 1):end_line], '\n') AS text FROM p JOIN t USING (path)"""
)
def source_previews(spark, d):
    texts = table(spark, d, "file_texts").filter(F.col("content").isNotNull()).groupBy("path").agg(F.max("content").alias("content"))
    return workspace.previews(texts, _nodes(spark, d))


@query(
    f"""WITH {NODES}, k AS (SELECT DISTINCT path, line, end_line, kind, name FROM n WHERE path IS NOT NULL AND kind IN ('module', 'class', 'struct', 'enum', 'trait', 'interface', 'impl', 'function', 'method'))
SELECT path, count(*) AS n_entries, first(name ORDER BY line, end_line NULLS FIRST, kind, name) AS first_name FROM k GROUP BY path"""
)
def file_outlines(spark, d):
    return workspace.outline(_nodes(spark, d)).select("path", F.size("entries").cast("long").alias("n_entries"), F.col("entries")[0]["name"].alias("first_name"))


@query(
    f"""WITH a AS (SELECT {_PATH} AS path, max((snapshot_no, right(lower(digest), 64))) AS m FROM source_inventory WHERE digest IS NOT NULL GROUP BY 1), b AS (SELECT {_PATH} AS path, max((indexed_at, right(lower(digest), 64))) AS m FROM files WHERE digest IS NOT NULL GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.m[2] <> b.m[2]"""
)
def stale_files(spark, d):
    last = lambda name, by: table(spark, d, name).filter("digest IS NOT NULL").groupBy(normal_path(F.col("path")).alias("path")).agg(F.max(F.struct(F.col(by), normal_digest(F.col("digest")).alias("d"))).alias("m")).select("path", F.col("m.d").alias("digest"))
    return workspace.stale(last("source_inventory", "snapshot_no"), last("files", "indexed_at"))


@query()
def structural_search(spark, d):
    return code.search_structure(table(spark, d, "file_texts"), "$X.append($V * $N)")


@query(
    f"""WITH {NODES}, t AS (SELECT path, max(content) AS content FROM file_texts WHERE content IS NOT NULL GROUP BY path)
SELECT id, path, line, end_line, array_to_string(string_split(regexp_replace(content, '\r\n?', '\n', 'g'), '\n')[line:end_line], '\n') AS text FROM n JOIN t USING (path) WHERE line >= 1 AND end_line >= line"""
)
def source_snippets(spark, d):
    spans = _nodes(spark, d).filter(F.col("end_line").isNotNull()).select("id", "path", "line", "end_line")
    texts = table(spark, d, "file_texts").filter(F.col("content").isNotNull()).groupBy("path").agg(F.max("content").alias("content"))
    return workspace.snippet(texts, spans)


# -- routes and scopes

_URL = r"'https?://[^/\s)>\]]+(/[^\s)>\]]*)'"


@query(f"SELECT u AS url, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {_URL}, 1)) AS u FROM documents) GROUP BY u")
def document_urls(spark, d):
    return _urls(spark, d).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def _urls(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_URL.strip("'")), 1)).alias("url"))


_SEGMENT = r"^(<[^>]*>|:[^/]+|\{.*\}|\$\{.*\}|[0-9]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"


def _split_route(c: str) -> str:
    return f"list_transform(string_split(regexp_replace(lower(regexp_replace({c}, '[?#].*$', '')), '(.)/+$', '\\1'), '/'), lambda s: CASE WHEN regexp_matches(s, '{_SEGMENT}') THEN '{{param}}' ELSE s END)"


@query(
    f"""WITH {NODES}, u AS (SELECT DISTINCT '/' || path || CASE WHEN line % 2 = 0 THEN '/' || line ELSE '/tail' END AS client FROM n WHERE path IS NOT NULL AND line IS NOT NULL), r0 AS (SELECT DISTINCT '/' || path || CASE WHEN is_test THEN '/:id' ELSE '/tail' END AS route FROM n WHERE path IS NOT NULL UNION SELECT '/' || regexp_replace(path, '[^/]*$', '') || '{{file}}/{{id}}' FROM n WHERE path IS NOT NULL),
c AS (SELECT client, {_split_route('client')} AS a FROM u), r AS (SELECT DISTINCT {_split_route('route')} AS b FROM r0),
j AS (SELECT client, b, list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[i] AND b[i] = '{{param}}' THEN 2 WHEN a[i] = b[i] THEN 3 ELSE 1 END)) AS score FROM c JOIN r ON len(a) = len(b) AND a[2] = b[2] AND len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i] AND b[i] <> '{{param}}')) = 0),
k AS (SELECT *, max(score) OVER (PARTITION BY client) AS best FROM j)
SELECT client, array_to_string(min(b), '/') AS route, CAST(max(score) AS INTEGER) AS score FROM k WHERE score = best GROUP BY client HAVING count(*) = 1"""
)
def route_match(spark, d):
    """The tables have no routes: paths of nodes make some, plain and with parameters, and URLs that ask for them."""
    n = _nodes(spark, d).filter("path IS NOT NULL")
    asked = n.filter("line IS NOT NULL").select(F.concat(F.lit("/"), "path", F.when(F.col("line") % 2 == 0, F.concat(F.lit("/"), F.col("line").cast("string"))).otherwise("/tail")).alias("url"))
    plain = n.select(F.concat(F.lit("/"), "path", F.when(F.col("is_test"), "/:id").otherwise("/tail")).alias("route"))
    loose = n.select(F.concat(F.lit("/"), F.regexp_replace("path", "[^/]*$", ""), F.lit("{file}/{id}")).alias("route"))
    return routes.match_routes(asked, plain.union(loose))


@query(
    """WITH s AS (SELECT DISTINCT id AS owner, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS scope FROM nodes WHERE kind = 'component' AND path IS NOT NULL UNION SELECT 'all of ' || split_part(path, '/', 1), split_part(path, '/', 1) FROM nodes WHERE kind = 'component' AND path IS NOT NULL)
SELECT DISTINCT least(a.owner, b.owner) AS a, greatest(a.owner, b.owner) AS b FROM s a JOIN s b ON a.owner <> b.owner AND (a.scope = b.scope OR starts_with(a.scope, b.scope || '/'))"""
)
def scope_conflicts(spark, d):
    """Scopes of components, and one more for each whole repository, that these lie in."""
    n = table(spark, d, "nodes").filter("kind = 'component' AND path IS NOT NULL")
    scope = F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2)))
    repo = F.split_part("path", F.lit("/"), F.lit(1))
    return routes.scope_overlaps(n.select(F.col("id").alias("owner"), scope.alias("scope")).union(n.select(F.concat(F.lit("all of "), repo), F.concat(repo, F.lit("/**")))))


# -- surface

_FREE = "WITH k AS (SELECT kind, count(*) AS n, count(DISTINCT dst) AS n_targets FROM edge_occurrences GROUP BY kind) SELECT kind, n, n_targets FROM k WHERE n > 10"


@query(_FREE)
def sql_passthrough(spark, d):
    return paging.query(spark, _FREE, {"edge_occurrences": table(spark, d, "edge_occurrences")})


@query(f"WITH {NODES} SELECT id, kind, path FROM n ORDER BY path, line, id LIMIT 30 OFFSET 60")
def page_offset(spark, d):
    return _nodes(spark, d).orderBy("path", "line", "id").offset(60).limit(30).select("id", "kind", "path")


@query(f"WITH {NODES}, k AS (SELECT id, unnest(json_keys(details)) AS key, details FROM n WHERE details IS NOT NULL) SELECT key, count(*) AS n FROM k GROUP BY key")
def json_each_explode(spark, d):
    keys = F.explode(F.json_object_keys("details"))
    return _nodes(spark, d).select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT status, count(*) FILTER (WHERE language = 'rust') AS rust, count(*) FILTER (WHERE language = 'python') AS python, count(*) FILTER (WHERE language = 'typescript') AS typescript FROM (SELECT DISTINCT * FROM files) GROUP BY status"
)
def pivot_status(spark, d):
    return table(spark, d, "files").distinct().groupBy("status").agg(*[F.count_if(F.col("language") == x).alias(x) for x in ("rust", "python", "typescript")])


@query("SELECT DISTINCT path, len(string_split(path, '/')) AS n_parts, split_part(path, '/', -1) AS base, regexp_replace(path, '/?[^/]*$', '') AS parent FROM nodes WHERE path IS NOT NULL")
def path_parts(spark, d):
    return table(spark, d, "nodes").filter(F.col("path").isNotNull()).select("path", F.size(F.split("path", "/")).cast("long").alias("n_parts"), F.substring_index("path", "/", -1).alias("base"), F.regexp_replace("path", "/?[^/]*$", "").alias("parent")).distinct()


@query("SELECT DISTINCT repo, first_value(run_id) OVER (PARTITION BY repo ORDER BY started_at DESC, run_id DESC) AS run_id, max(started_at) OVER (PARTITION BY repo) AS started_at FROM index_runs")
def latest_run(spark, d):
    r = table(spark, d, "index_runs")
    return r.groupBy("repo").agg(F.max(F.struct("started_at", "run_id")).alias("m")).select("repo", "m.run_id", "m.started_at")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM x WHERE rn = 1")
def latest_trace(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return e.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT * FROM (SELECT doc_id, repo, source, updated_at, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC NULLS LAST, doc_id) AS place FROM documents WHERE source = 'board_message') WHERE place <= 10")
def board_page(spark, d):
    w = Window.partitionBy("repo").orderBy(F.desc_nulls_last("updated_at"), "doc_id")
    m = table(spark, d, "documents").filter("source = 'board_message'").withColumn("place", F.row_number().over(w).cast("long"))
    return m.filter("place <= 10").select("doc_id", "repo", "source", "updated_at", "place")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return stream.event_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = Q
