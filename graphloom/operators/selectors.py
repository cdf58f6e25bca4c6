"""From what a caller writes to a node."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = 101


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    def __init__(self, selector: str, ids: list[str]):
        super().__init__(f"{selector}: {len(ids)} candidates")
        self.ids = ids


def enclosing(nodes: DataFrame, path: str, line: int) -> DataFrame:
    """Nodes of a file around a line, the smallest span first: id, span."""
    n = nodes.filter((F.col("path") == path) & (F.col("line") <= line) & (F.coalesce("end_line", "line") >= line))
    return n.select("id", (F.coalesce("end_line", "line") - F.col("line")).alias("span")).orderBy("span", "id")


def candidates(nodes: DataFrame, selector: str) -> DataFrame:
    """Candidates of the first way that has any, at most 101, by id: id.

    The ways are: id; path:line or path#Lline; path:name; kind:name; name or
    qualified name; last parts of a qualified name.
    """
    ways = [nodes.filter(F.col("id") == selector)]
    if m := re.fullmatch(r"(.+?)(?::|#L)(\d+)", selector):
        ways.append(enclosing(nodes, m[1], int(m[2])).limit(1))
    if ":" in selector:
        head, _, name = selector.rpartition(":")
        ways.append(nodes.filter((F.col("path") == head) & ((F.col("name") == name) | (F.col("qualname") == name))))
        ways.append(nodes.filter((F.col("kind") == head) & ((F.col("name") == name) | (F.col("qualname") == name))))
    ways.append(nodes.filter((F.col("name") == selector) | (F.col("qualname") == selector)))
    ways.append(nodes.filter(F.col("qualname").endswith("." + selector)))
    for way in ways:
        found = way.select("id").distinct().orderBy("id").limit(CANDIDATES)
        if found.limit(1).count():
            return found
    return nodes.select("id").limit(0)


def select(nodes: DataFrame, selector: str) -> str:
    """The one node a selector means; NotFound without any, Ambiguous with several."""
    ids = [r["id"] for r in candidates(nodes, selector).collect()]  # at most 101
    if not ids:
        raise NotFound(selector)
    if len(ids) > 1:
        raise Ambiguous(selector, ids)
    return ids[0]


def suffix_references(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Resolves names (column ``name``) by priority: qualified name 0, name 1, last part 2; only the best priority's candidates count.

    Gives name, priority, n_candidates and id, which is null where several fit.
    """
    n = names.select("name").dropna().distinct()
    q = nodes.select("id", F.col("qualname").alias("key"), F.lit(0).alias("priority"))
    m = nodes.select("id", F.col("name").alias("key"), F.lit(1).alias("priority"))
    s = nodes.filter(F.col("qualname").contains(".")).select("id", F.substring_index("qualname", ".", -1).alias("key"), F.lit(2).alias("priority"))
    keyed = q.unionByName(m).unionByName(s).withColumnRenamed("key", "name")
    per = keyed.join(n, "name").groupBy("name", "priority").agg(F.count_distinct("id").alias("n_candidates"), F.min("id").alias("id"))
    best = per.groupBy("name").agg(F.min(F.struct("priority", "n_candidates", "id")).alias("b"))
    return best.select("name", "b.priority", "b.n_candidates", F.when(F.col("b.n_candidates") == 1, F.col("b.id")).alias("id"))
