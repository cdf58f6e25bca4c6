"""Resolution coverage and its summaries.

Each occurrence is a reference that was resolved, is external, ambiguous or
unresolved; the summaries count these by language, file, reason and directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import within
from graphloom.operators.graph import Graph

STATUSES = ("resolved", "external", "ambiguous", "unresolved")

# What the resolver's evidence says for each cause, % for any run; the first match holds.
CAUSES = (
    ("dynamic_callee", "computed receiver or dynamic callee; callable identity is unknown"),
    ("shadowed_binding", "callee is shadowed by a parameter or local binding of unknown callable identity"),
    ("external_import_call", "call through external import %"),
    ("alias_target_missing", "import %: 1 modules, 0 alias targets"),
    ("missing_indexed_import", "no indexed provider for absolute import %"),
    ("missing_indexed_import", "import %: 0 modules, %"),
    ("no_lexical_candidate", "0 lexically justified candidates;%"),
)
# Reasons that a reader is shown.
REASONS = ("dynamic_callback", "unresolved_receiver_type", "framework_magic", "external_unindexed", "ambiguous_candidates", "shadowed_binding", "unknown")
ENCLOSING = ("function", "method", "struct", "class", "trait", "interface", "enum")
BLOCK = 64  # lines that a range join takes together


def status() -> Column:
    """Status of an occurrence: no target is unresolved, an external symbol external, a possible one ambiguous."""
    return (
        F.when(F.col("dst").isNull(), "unresolved").when(F.col("dst").startswith("external:"), "external").when(F.col("confidence") == "possible", "ambiguous").otherwise("resolved")
    )


def cause() -> Column:
    """Cause of a reference's state by its ``status`` and ``evidence``: ambiguous candidates, else what the evidence says, else other."""
    c = F.when(F.col("status") == "ambiguous", "ambiguous_candidates")
    for name, said in CAUSES:
        hit = F.col("evidence").ilike(said) if "%" in said else F.col("evidence") == said
        c = c.when(F.coalesce(hit, F.lit(False)), name)
    return c.otherwise("other")


def reason() -> Column:
    """Reason shown for a reference, by ``status``, ``cause``, ``expression`` and ``evidence``; null for what is resolved without any."""
    said = F.coalesce("evidence", F.lit(""))
    shadowed = said.contains(CAUSES[1][1])
    dotted = F.coalesce(F.col("expression").contains("."), F.lit(False))
    return (
        F.when(F.col("status") == "ambiguous", "ambiguous_candidates")
        .when(said.contains("diagnostic_reason=framework_magic"), "framework_magic")
        .when(shadowed & dotted, "unresolved_receiver_type")
        .when(shadowed, "dynamic_callback")
        .when(said.startswith("call through external import ") | (F.col("cause") == "external_import_call"), "external_unindexed")
        .when(F.col("cause") == "shadowed_binding", "shadowed_binding")
        .when(F.col("status") != "resolved", "unknown")
    )


def languages_of(nodes: DataFrame) -> DataFrame:
    """One language per owning file, the commonest of its nodes, ties by name: owner_path, language."""
    n = nodes.groupBy("owner_path", F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("language").isNotNull()).groupBy("owner_path").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("language"))).alias("m")).select("owner_path", "m.language")


def coverage(g: Graph) -> DataFrame:
    """Occurrences as references with language and status: owner_path, ordinal, line, kind, language, status, evidence, expression."""
    lang = F.coalesce("language", F.lit("unknown")).alias("language")
    return g.occurrences.join(languages_of(g.nodes), "owner_path", "left").select("owner_path", "ordinal", "line", "kind", lang, status().alias("status"), "evidence", F.col("dst").alias("expression"))


def explained(cov: DataFrame) -> DataFrame:
    """References with cause and reason."""
    return cov.withColumn("cause", cause()).withColumn("reason", reason())


def _blocks(df: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of line ranges, once for each block of lines that they touch."""
    return df.withColumn("block", F.explode(F.sequence(F.floor(F.col(first) / BLOCK), F.floor(F.col(last) / BLOCK))))


def with_islands(cov: DataFrame, islands: DataFrame, language: str = "javascript") -> DataFrame:
    """References within islands of another language (path, first, last) get that language; others keep theirs."""
    spans = _blocks(islands.filter(F.col("last") >= F.col("first")).select(F.col("path").alias("owner_path"), "first", "last").distinct(), "first", "last")
    refs = cov.select("owner_path", "ordinal", "line").filter(F.col("line").isNotNull()).withColumn("block", F.floor(F.col("line") / BLOCK))
    inside = refs.join(spans, ["owner_path", "block"]).filter((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last"))).select("owner_path", "ordinal").distinct().withColumn("__in", F.lit(True))
    return cov.join(inside, ["owner_path", "ordinal"], "left").withColumn("language", F.when(F.col("__in"), language).otherwise(F.col("language"))).select(*cov.columns)


def causes(cov: DataFrame) -> DataFrame:
    """Unresolved and ambiguous references by cause: status, cause, n, n_files."""
    open_ = explained(cov).filter(F.col("status").isin("unresolved", "ambiguous"))
    return open_.groupBy("status", "cause").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner_path").alias("n_files"))


def coverage_counts(cov: DataFrame) -> DataFrame:
    """Per file, language and status: the pre-aggregate behind the other counts."""
    return cov.groupBy("owner_path", "language", "status").agg(F.count(F.lit(1)).alias("n"))


def by_language(cov: DataFrame) -> DataFrame:
    """Per language a column per status and the health: resolved share of what is inside, in percent; null without any."""
    one = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    inside = (F.col("resolved") + F.col("unresolved") + F.col("ambiguous")).cast("double")
    return cov.groupBy("language").agg(*one).withColumn("health", F.try_divide(F.col("resolved") * F.lit(100.0), inside))


def reason_matrix(cov: DataFrame) -> DataFrame:
    """Every reason by every status with zeros filled in: reason, status, n, n_files."""
    grid = cov.sparkSession.createDataFrame([(c, s) for c in REASONS for s in STATUSES], "reason string, status string")
    n = explained(cov).filter(F.col("reason").isNotNull()).groupBy("reason", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner_path").alias("n_files"))
    return grid.join(n, ["reason", "status"], "left").na.fill(0, ["n", "n_files"])


def worst_files(cov: DataFrame, syntax: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Files with most unresolved or ambiguous references, and errors from ``syntax`` (owner_path, n): owner_path, n."""
    n = cov.filter(F.col("status").isin("unresolved", "ambiguous")).groupBy("owner_path").agg(F.count(F.lit(1)).alias("n"))
    both = n if syntax is None else n.unionByName(syntax.select("owner_path", F.col("n").cast("long").alias("n")))
    return both.groupBy("owner_path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "owner_path").limit(top)


def by_directory(cov: DataFrame) -> DataFrame:
    """Counts per first directory: repo, n, n_files and a column per status."""
    return cov.groupBy(F.substring_index("owner_path", "/", 1).alias("repo")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner_path").alias("n_files"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def by_workspace(cov: DataFrame, linked: DataFrame) -> DataFrame:
    """Counts per workspace: workspace, n, health and a column per status.

    Paths of linked workspaces (column ``name``) begin with the name in
    brackets; all others are primary. Linked ones without references have 0.
    """
    name = F.regexp_extract("owner_path", "^\\[([^\\]]+)\\]/", 1)
    names = linked.select(F.col("name").alias("workspace")).dropna().distinct()
    n = cov.groupBy(name.alias("workspace"), "status").agg(F.count(F.lit(1)).alias("n"))
    known = n.join(names.withColumn("__known", F.lit(True)), "workspace", "left")
    placed = known.withColumn("workspace", F.when(F.col("__known"), F.col("workspace")).otherwise("primary"))
    counts = placed.groupBy("workspace").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in STATUSES])
    every = names.union(cov.sparkSession.createDataFrame([("primary",)], "workspace string")).distinct().join(counts, "workspace", "left").na.fill(0, ["n", *STATUSES])
    inside = (F.col("resolved") + F.col("unresolved") + F.col("ambiguous")).cast("double")
    return every.withColumn("health", F.try_divide(F.col("resolved") * F.lit(100.0), inside))


def file_languages(files: DataFrame) -> DataFrame:
    """One language per path of the log, in one spelling, the least by name: path, language."""
    return files.filter(F.col("path").isNotNull()).groupBy("path").agg(F.min(spelled(F.col("language"))).alias("language"))


def spelled(language: Column) -> Column:
    """A language in one spelling; unknown without one."""
    lang = F.lower(F.coalesce(language, F.lit("unknown")))
    return F.when(lang == "py", "python").when(lang == "rs", "rust").when(lang == "ts", "typescript").when(lang == "md", "markdown").otherwise(lang)


def parse_errors(errors: DataFrame, languages: DataFrame) -> DataFrame:
    """Syntax errors (path, line, message) per language (path, language): language, n_errors, n_files."""
    return errors.join(languages, "path").groupBy("language").agg(F.count(F.lit(1)).alias("n_errors"), F.count_distinct("path").alias("n_files"))


def lint(errors: DataFrame, languages: DataFrame, supported: tuple[str, ...], scope: str = "", full: bool = False) -> DataFrame:
    """Stored syntax errors of supported languages at or below a path: rule_id, severity, language, path, line, message, message_truncated.

    Messages are cut to 512 characters unless ``full``.
    """
    j = errors.join(languages, "path").filter(F.col("language").isin(*supported) & within(F.col("path"), scope))
    long = F.lit(False) if full else F.coalesce(F.length("message") > 512, F.lit(False))
    text = F.col("message") if full else F.substring("message", 1, 512)
    return j.select(F.lit("syntax.parse").alias("rule_id"), F.lit("error").alias("severity"), "language", "path", "line", text.alias("message"), long.alias("message_truncated"))


def lint_summary(errors: DataFrame, languages: DataFrame, supported: tuple[str, ...], scope: str = "") -> DataFrame:
    """Per supported language files and errors at or below a path: language, n_files, n_errors, status."""
    own = languages.filter(F.col("language").isin(*supported) & within(F.col("path"), scope))
    n = errors.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    t = own.join(n, "path", "left").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_errors"))
    return t.withColumn("status", F.when(F.col("n_errors") > 0, "diagnostics_found").otherwise("no_stored_syntax_diagnostics"))


def index_counts(g: Graph) -> DataFrame:
    """One row of totals: n_nodes, n_edges, n_occurrences, n_files, n_external, n_unresolved."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("owner_path").alias("n_files"))
    e = g.keys.agg(F.count(F.lit(1)).alias("n_edges"))
    o = g.occurrences.agg(F.count(F.lit(1)).alias("n_occurrences"), F.count_if(F.col("dst").startswith("external:")).alias("n_external"), F.count_if(F.col("dst").isNull()).alias("n_unresolved"))
    return n.crossJoin(e).crossJoin(o)  # one row each


def status_counts(files: DataFrame) -> DataFrame:
    """Rows of the index log per status, languages brought to one spelling: language, status, n, n_paths."""
    return files.distinct().groupBy(spelled(F.col("language")).alias("language"), "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_paths"))


def _spans(nodes: DataFrame, *columns: str) -> DataFrame:
    """Line spans of symbols by blocks: id, path, a, b, block and further columns."""
    own = nodes.filter(F.col("end_line").isNotNull() & F.col("line").isNotNull() & (F.col("end_line") >= F.col("line")))
    return _blocks(own.select("id", "path", F.col("line").alias("a"), F.col("end_line").alias("b"), *columns), "a", "b")


def _within_spans(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """References (path, line) with each span around them; they meet on blocks of lines, so that long files are no large groups."""
    r = refs.filter(F.col("line").isNotNull()).withColumn("block", F.floor(F.col("line") / BLOCK))
    return r.join(spans, ["path", "block"]).filter((F.col("line") >= F.col("a")) & (F.col("line") <= F.col("b")))


def in_span(g: Graph) -> DataFrame:
    """References within the lines of each symbol of their file, by status: id, status, n. A line lies in all symbols that enclose it."""
    refs = g.occurrences.select(F.col("owner_path").alias("path"), "line", status().alias("status"))
    return _within_spans(refs, _spans(g.nodes)).groupBy("id", "status").agg(F.count(F.lit(1)).alias("n"))


def innermost(g: Graph) -> DataFrame:
    """The smallest symbol around each reference's line: owner_path, ordinal, id (ties by id)."""
    j = _within_spans(g.occurrences.select("owner_path", "ordinal", F.col("owner_path").alias("path"), "line"), _spans(g.nodes))
    return j.groupBy("owner_path", "ordinal").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("n"), F.col("id"))).alias("m")).select("owner_path", "ordinal", "m.id")


def analysis_gaps(nodes: DataFrame, cov: DataFrame) -> DataFrame:
    """Gaps that the analysis names within each symbol: id, path, line, expression, evidence."""
    refs = cov.filter(F.col("evidence").ilike("analysis gap:%")).select(F.col("owner_path").alias("path"), "line", "expression", "evidence")
    return _within_spans(refs, _spans(nodes)).select("id", "path", "line", "expression", "evidence")


def enclosing_names(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """The smallest symbol around each place (path, line), by its shortest unique name in the file: path, line, kind, name.

    That is the name, else the qualified name, else the id. Only functions,
    methods and types count.
    """
    per = lambda c: nodes.groupBy("path", c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    own = nodes.filter(F.col("kind").isin(*ENCLOSING)).select("id", "path", "line", "end_line", "kind", "name", "qualname")
    own = own.join(per("name"), ["path", "name"], "left").join(per("qualname"), ["path", "qualname"], "left")
    shown = F.when(F.coalesce("n_name", F.lit(1)) <= 1, F.col("name")).when(F.col("n_qualname") == 1, F.col("qualname")).otherwise(F.col("id"))
    j = _within_spans(places.select("path", "line").distinct(), _spans(own.withColumn("shown", shown), "kind", "shown"))
    best = F.min(F.struct((F.col("b") - F.col("a")).alias("n"), "id", "kind", "shown")).alias("m")
    return j.groupBy("path", "line").agg(best).select("path", "line", "m.kind", F.col("m.shown").alias("name"))


def changed_symbols(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols, other than modules and files, that changed line ranges (path, start, end) touch: id, path."""
    r = _blocks(ranges.filter(F.col("end") >= F.col("start")).select("path", "start", "end").distinct(), "start", "end")
    spans = _spans(nodes.filter(~F.col("kind").isin("module", "file")))
    return r.join(spans, ["path", "block"]).filter((F.col("a") <= F.col("end")) & (F.col("b") >= F.col("start"))).select("id", "path").distinct()


def unmapped_changes(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Changed ranges that touch no symbol: path, start, end."""
    r = ranges.select("path", "start", "end").distinct()
    spans = _spans(nodes.filter(~F.col("kind").isin("module", "file"))).select("path", "block", "a", "b")
    hit = _blocks(r.filter(F.col("end") >= F.col("start")), "start", "end").join(spans, ["path", "block"]).filter((F.col("a") <= F.col("end")) & (F.col("b") >= F.col("start")))
    return r.join(hit.select("path", "start", "end").distinct(), ["path", "start", "end"], "left_anti")


def first_of_file(g: Graph) -> DataFrame:
    """The first node of each file by (line, id): owner_path, id, line."""
    w = Window.partitionBy("owner_path").orderBy("line", "id")
    return g.nodes.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("owner_path", "id", "line")
