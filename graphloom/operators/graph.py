"""The graph behind the queries: facts in, typed edges out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import is_test_path, within
from graphloom.session import table

# The vocabulary of edge kinds and their part in dependencies.
FORWARD = ("calls", "possible_calls", "inherits", "implements", "overrides", "extends", "includes", "mutates", "handles", "references", "calls_endpoint", "defines_table", "queries_table", "mutates_table", "references_table")
REVERSE = ("decorates",)
STRUCTURAL = ("imports", "contains", "documents")
DATA_FLOW = ("mutates", "references", "handles")
SUBTYPING = ("inherits", "implements", "extends")
TEST_REACH = ("calls", "imports", "possible_calls", "implements", "overrides")
ENTRY_WIRING = ("handles", "routes_to", "dispatches", "listens_to")
TYPE_KINDS = ("class", "struct", "enum", "trait", "interface", "type", "record")
CALLABLE = ("function", "method")


@dataclass(frozen=True)
class Graph:
    """Facts of one index: nodes (a row per id), occurrences (repeats removed), the edges made of them and the edges' keys.

    ``keys`` is (src, kind, dst) straight from the rows: what needs no counts
    or evidence takes it, as it needs neither the repeats removed nor wide rows
    shuffled, and a filter on the kind reaches the scan. ``triples`` are the
    same with repeats, for what reads few of them.
    """

    nodes: DataFrame
    occurrences: DataFrame
    edges: DataFrame
    keys: DataFrame
    triples: DataFrame


def edge_table(occurrences: DataFrame) -> DataFrame:
    """Edges from occurrences: src, kind, dst, occurrence_count, and path, line, evidence, confidence of the first.

    The first occurrence is the least by (owner_path, ordinal). Occurrences
    without both ends are no edges. One grouping shuffle with partial
    aggregation before it, so hot pairs are combined early.
    """
    first = F.min(F.struct("owner_path", "ordinal", "line", "evidence", "confidence")).alias("f")
    rows = occurrences.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return rows.groupBy("src", "kind", "dst").agg(first, F.count(F.lit(1)).alias("occurrence_count")).select("src", "kind", "dst", "occurrence_count", F.col("f.owner_path").alias("path"), "f.line", "f.evidence", "f.confidence")


def graph(nodes: DataFrame, occurrences: DataFrame) -> Graph:
    """A graph from its fact tables; exact repeats of rows are removed, nodes without an id left out."""
    once = nodes.filter(F.col("id").isNotNull()).dropDuplicates(["id"])
    occ = occurrences.select("owner_path", "ordinal", "src", "kind", "dst", "line", "evidence", "confidence").distinct()
    triples = occurrences.select("src", "kind", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return Graph(once, occ, edge_table(occ), triples.distinct(), triples)


def load(spark: SparkSession, sf_dir: str) -> Graph:
    return graph(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edge_occurrences"))


def detail(name: str) -> Column:
    """A field of a node's JSON details as text; null where there is none."""
    return F.get_json_object("details", f"$.{name}")


def is_public() -> Column:
    """Whether a node's details call it public, written as true or as 1."""
    return F.coalesce(detail("is_public").isin("true", "1"), F.lit(False))


def compact(nodes: DataFrame) -> DataFrame:
    """The short projection of nodes."""
    return nodes.select("id", "kind", "name", "qualname", "path", "line", "end_line", "is_test")


def described_edges(g: Graph) -> DataFrame:
    """Edges with kinds and paths of both ends; ends outside the index have nulls there."""
    ends = g.nodes.select("id", "kind", "path")
    s = ends.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"), F.col("path").alias("src_path"))
    t = ends.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"), F.col("path").alias("dst_path"))
    return g.edges.join(s, "src", "left").join(t, "dst", "left").select("src", "src_kind", "src_path", "kind", "dst", "dst_kind", "dst_path", "occurrence_count", "line", "evidence", "confidence")


def dangling(g: Graph) -> DataFrame:
    """Edges whose source, or whose target other than an external symbol, is no node: src, kind, dst."""
    ids = g.nodes.select("id")
    e = g.keys
    no_src = e.join(ids, e["src"] == ids["id"], "left_anti")
    inner = e.filter(~F.col("dst").startswith("external:"))
    no_dst = inner.join(ids, inner["dst"] == ids["id"], "left_anti")
    return no_src.unionByName(no_dst).distinct()


def neighbours(g: Graph) -> DataFrame:
    """Both directions of every edge: id, other, kind, direction."""
    out = g.keys.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", F.lit("out").alias("direction"))
    back = g.keys.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", F.lit("in").alias("direction"))
    return out.unionByName(back)


def degree_summary(g: Graph) -> DataFrame:
    """Per node: callers, callees, and occurrences of calls each way."""
    calls = g.edges.filter("kind = 'calls'")
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callees"), F.sum("occurrence_count").alias("calls_out"))
    back = calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.sum("occurrence_count").alias("calls_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.nodes.select("id").join(out, "id", "left").join(back, "id", "left").select("id", *[zero(c) for c in ("callers", "calls_in", "callees", "calls_out")])


def in_scope(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes at or below a path."""
    return nodes.filter(within(F.col("path"), prefix))


def without_archives(nodes: DataFrame) -> DataFrame:
    """Nodes outside archive directories, whatever the letters' case."""
    p = F.lower("path")
    return nodes.filter(~(p.startswith("archive/") | p.contains("/archive/")))


def test_flags(nodes: DataFrame) -> DataFrame:
    """Nodes whose stored test flag differs from what their path says: id, path, is_test, by_path."""
    by_path = is_test_path(F.col("path"))
    return nodes.filter(F.col("path").isNotNull() & ~F.col("is_test").eqNullSafe(by_path)).select("id", "path", "is_test", by_path.alias("by_path"))
