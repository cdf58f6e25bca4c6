"""Modules of the graph: topology, boundaries, and cycles between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import within
from graphloom.operators.components import strong_components
from graphloom.operators.graph import Graph, is_public


def module_of(path: Column, segments: int = 2) -> Column:
    """The first directories of a path, its file name dropped."""
    return F.substring_index(F.regexp_replace(path, "/?[^/]*$", ""), "/", segments)


def parent_of(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _module_edges(g: Graph) -> DataFrame:
    m = g.nodes.select("id", module_of(F.col("path")).alias("m"))
    a, b = m.select(F.col("id").alias("src"), F.col("m").alias("source")), m.select(F.col("id").alias("dst"), F.col("m").alias("target"))
    return g.keys.join(a, "src").join(b, "dst").select("source", "target", "kind", "src", "dst")


def topology(g: Graph) -> DataFrame:
    """Per module: nodes, edges within, in and out, cohesion and role.

    Cohesion is the share of edges that stay within, null without edges. The
    role is isolated without edges across, source with outgoing ones only,
    sink with incoming ones only, else hub.
    """
    e = _module_edges(g)
    inner = e.filter("source = target").groupBy(F.col("source").alias("module")).agg(F.count(F.lit(1)).alias("internal"))
    out = e.filter("source <> target").groupBy(F.col("source").alias("module")).agg(F.count(F.lit(1)).alias("outgoing"))
    back = e.filter("source <> target").groupBy(F.col("target").alias("module")).agg(F.count(F.lit(1)).alias("incoming"))
    n = g.nodes.groupBy(module_of(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("n_nodes"))
    t = n.join(inner, "module", "left").join(out, "module", "left").join(back, "module", "left").na.fill(0, ["internal", "outgoing", "incoming"])
    total = F.col("internal") + F.col("outgoing") + F.col("incoming")
    role = F.when((F.col("outgoing") == 0) & (F.col("incoming") == 0), "isolated").when(F.col("incoming") == 0, "source").when(F.col("outgoing") == 0, "sink").otherwise("hub")
    return t.select("module", "n_nodes", "internal", "outgoing", "incoming", F.try_divide(F.col("internal").cast("double"), total.cast("double")).alias("cohesion"), role.alias("role"))


def module_links(g: Graph) -> DataFrame:
    """Per pair of modules: number of edges and the dominant kind (most edges, then the least name)."""
    e = _module_edges(g).filter("source <> target").groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "target")
    r = e.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "kind"))).withColumn("n_edges", F.sum("n").over(w))
    return r.filter("rank = 1").select("source", "target", "n_edges", F.col("kind").alias("dominant_kind"))


def exports(g: Graph) -> DataFrame:
    """Public nodes of a module that other modules use: module, id, n_callers (distinct sources outside)."""
    public = g.nodes.filter(is_public()).select(F.col("id").alias("dst"))
    e = _module_edges(g).filter("source <> target").join(public, "dst", "left_semi")
    return e.groupBy(F.col("target").alias("module"), F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_callers"))


def examples(g: Graph, top: int = 5) -> DataFrame:
    """Per pair of modules the edges across and the first ``top`` examples in order: source, target, n_edges, examples."""
    e = _module_edges(g).filter("source <> target")
    return _counted_examples(e, ["source", "target"], ["dst", "src", "kind"], top)


def _counted_examples(e: DataFrame, group: list[str], order: list[str], top: int) -> DataFrame:
    """Number of edges of each group and the first ``top`` as text; the limit reaches the window, so no group is sorted whole."""
    w = Window.partitionBy(*group).orderBy(*order)
    first = e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    lists = first.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "src", "kind", "dst").alias("text")))), lambda x: x["text"]), "; ").alias("examples"))
    return e.groupBy(*group).agg(F.count(F.lit(1)).alias("n_edges")).join(lists, group)


def contract(g: Graph, path: str, top: int = 5) -> DataFrame:
    """The boundary of a directory: direction (inbound or outbound), module (the folder at the other end), n_edges, examples.

    Edges with one end at or below the path and the other outside count; ends
    that are no nodes do not.
    """
    ends = g.nodes.select("id", within(F.col("path"), path).alias("inside"), parent_of(F.col("path")).alias("folder"))
    a = ends.select(F.col("id").alias("src"), F.col("inside").alias("src_in"), F.col("folder").alias("src_folder"))
    b = ends.select(F.col("id").alias("dst"), F.col("inside").alias("dst_in"), F.col("folder").alias("dst_folder"))
    across = g.keys.join(a, "src").join(b, "dst").filter(F.col("src_in") != F.col("dst_in"))
    e = across.select(F.when(F.col("src_in"), "outbound").otherwise("inbound").alias("direction"), F.when(F.col("src_in"), F.col("dst_folder")).otherwise(F.col("src_folder")).alias("module"), "src", "kind", "dst")
    outside, inside = F.when(F.col("direction") == "outbound", F.col("dst")).otherwise(F.col("src")), F.when(F.col("direction") == "outbound", F.col("src")).otherwise(F.col("dst"))
    return _counted_examples(e.withColumn("o", outside).withColumn("i", inside), ["direction", "module"], ["o", "i", "kind"], top)


def members(g: Graph, path: str) -> DataFrame:
    """The nodes at or below a directory, modules and files first: first (0 for these, else 1), id, kind, path, line."""
    first = F.when(F.col("kind").isin("module", "file"), 0).otherwise(1)
    return g.nodes.filter(within(F.col("path"), path)).select(first.alias("first"), "id", "kind", "path", "line")


def directories(g: Graph) -> DataFrame:
    """Every directory above a node's path: directory, n_nodes (at or below it)."""
    parts = F.split(parent_of(F.col("path")), "/")
    d = g.nodes.filter(F.col("path").contains("/")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("directory"))
    return d.groupBy("directory").agg(F.count(F.lit(1)).alias("n_nodes"))


def cycles(g: Graph, kinds: tuple[str, ...] = ("calls", "imports")) -> DataFrame:
    """Nodes on circles of the given kinds with the size of their component: component, id, size."""
    on = strong_components(g.keys.filter(F.col("kind").isin(*kinds)).select("src", "dst"))
    n = on.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return on.join(n, "component").select("component", "id", "size")


def largest_cycles(g: Graph, top: int = 5) -> DataFrame:
    """The largest components by (size, then id): component, size."""
    return cycles(g).select("component", "size").distinct().orderBy(F.desc("size"), "component").limit(top)
