"""Strongly connected components of a directed graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import SMALL, cut, drop, scratch, small

LAST_EDGES = SMALL  # edges that one task finishes; rounds over so few cost more than the search
HOPS = 3  # steps that a round takes at once while its frontier is small


def _one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of more than one node, by depth-first search with an explicit stack."""
    out: dict[str, list[str]] = {}
    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            out.setdefault(a, []).append(b)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    held: set[str] = set()
    rows: list[tuple[str, str]] = []
    for start in out:
        if start in order:
            continue
        work = [(start, 0)]
        while work:
            node, at = work.pop()
            if at == 0:
                order[node] = low[node] = len(order)
                open_.append(node)
                held.add(node)
            targets = out.get(node, ())
            descended = False
            while at < len(targets):
                t = targets[at]
                at += 1
                if t not in order:
                    work += [(node, at), (t, 0)]
                    descended = True
                    break
                if t in held:
                    low[node] = min(low[node], order[t])
            if descended:
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == order[node]:
                part = []
                while True:
                    t = open_.pop()
                    held.discard(t)
                    part.append(t)
                    if t == node:
                        break
                if len(part) > 1:
                    name = min(part, key=str.encode)
                    rows += [(t, name) for t in part]
    yield pd.DataFrame(rows, columns=["id", "label"])


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The greatest label (id, label) that reaches each id along the edges (a, b), its own included; labels are ids.

    What reaches a node's label reaches the node too, so that a round also
    takes the label's label, and long ways shrink to their logarithm.
    """
    state, front = labels, labels
    while True:
        sent = edges.join(small(front), F.col("a") == F.col("id")).select(F.col("b").alias("n_id"), F.col("label").alias("n_label"))
        far = front.select(F.col("id").alias("n_id"), F.col("label").alias("far")).join(state.select(F.col("id").alias("far"), F.col("label").alias("n_label")), "far").select("n_id", "n_label")
        near = state.select(F.col("id").alias("n_id"), F.col("label").alias("near")).join(small(front).select(F.col("id").alias("near"), F.col("label").alias("n_label")), "near").select("n_id", "n_label")
        best = sent.unionByName(far).unionByName(near).groupBy("n_id").agg(F.max("n_label").alias("n_label"))
        better = F.coalesce(F.col("n_label") > F.col("label"), F.lit(False))
        both = cut(state.join(best, F.col("id") == F.col("n_id"), "left").select("id", F.when(better, F.col("n_label")).otherwise(F.col("label")).alias("label"), better.alias("new")), F.col("new"))
        if state is not labels:
            drop(last)
        last, state, front = both, both.select("id", "label"), both.filter("new").select("id", "label")
        front.n_rows = both.n_where
        if not both.n_where:
            return state


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids that the edges (a, b) reach from the start ids (a written table), those included: id.

    While little is new a round takes several steps at once. What is found is
    appended to, never rewritten.
    """
    parts, front = [start], start
    while True:
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        found, hop = None, small(front)
        for _ in range(HOPS if front.n_rows <= SMALL else 1):
            hop = edges.join(hop.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
            found = hop if found is None else found.unionByName(hop)
        front = cut(found.distinct().join(seen, "id", "left_anti"))
        if not front.n_rows:
            return seen
        parts.append(front)


def strong_components(links: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """Nodes that lie on a circle, with their component: id, component, in_circle; a written table.

    ``links`` has src and dst; rows with a null end are ignored and repeats
    count once. ``component`` is the smallest id of the component in byte
    order. Nodes on no circle are left out. Ends that nothing enters or leaves
    are processed first, over and over; only what is left is searched. There
    every node takes the greatest id that reaches it as its colour, and in each
    colour class what reaches the node that gave the colour is a component;
    what remains of the classes is searched again. When no more than
    ``last_edges`` edges are left, some ten megabytes, one task finishes them.
    """
    with scratch(links.sparkSession) as keep:
        edges = cut(links.select(F.col("src").alias("a"), F.col("dst").alias("b")).dropna().distinct())
        loops = edges.filter(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
        edges = cut(edges.filter(F.col("a") != F.col("b")))
        found = []
        while True:
            while edges.n_rows > last_edges:
                kept = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
                kept = cut(kept.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
                if kept.n_rows == edges.n_rows:
                    break
                edges = kept
            if edges.n_rows <= last_edges:
                if edges.n_rows:
                    found.append(cut(edges.coalesce(1).mapInPandas(_one_task, "id string, label string")))
                break
            ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
            colours = _spread(edges, cut(ids.withColumn("label", F.col("id"))))
            ca, cb = colours.select(F.col("id").alias("a"), F.col("label").alias("la")), colours.select(F.col("id").alias("b"), F.col("label").alias("lb"))
            inner = cut(edges.join(ca, "a").join(cb, "b").filter(F.col("la") == F.col("lb")).select("a", "b"))
            heads = cut(colours.filter(F.col("id") == F.col("label")).select("id"))
            core = cut(closure(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), heads).join(colours, "id"))
            found.append(core)
            out = core.select("id")
            edges = cut(inner.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti"))
        single = loops.distinct()
        if not found:
            return keep(cut(single.select("id", F.col("id").alias("component"), F.lit(True).alias("in_circle"))))
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        names = every.groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n"))
        named = every.join(names, "label").filter("n > 1").select("id", "component")
        single = single.join(named.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
        return keep(cut(named.unionByName(single).withColumn("in_circle", F.lit(True))))
