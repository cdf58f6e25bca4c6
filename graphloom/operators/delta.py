"""Maintenance by changed files, with results equal to a full rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import edge_table
from graphloom.session import cut


def affected_owners(occurrences: DataFrame, nodes: DataFrame, changed: DataFrame, kinds: tuple[str, ...] = ("imports", "includes", "renders", "possible_calls")) -> DataFrame:
    """Files to look at again: the changed ones and those that refer to them over the kinds, at any distance: owner_path."""
    home = nodes.select(F.col("id").alias("dst"), F.col("owner_path").alias("target")).dropDuplicates(["dst"])
    uses = cut(occurrences.filter(F.col("kind").isin(*kinds)).join(home, "dst").select("owner_path", "target").filter("owner_path <> target").distinct())
    seen = front = cut(changed.select("owner_path").dropna().distinct())
    while True:
        nxt = uses.join(front.select(F.col("owner_path").alias("target")), "target").select("owner_path").distinct()
        front = cut(nxt.join(seen, "owner_path", "left_anti"))
        if not front.n_rows:
            return seen
        seen = seen.unionByName(front)


def replace_owners(old: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows with those of the owners taken out and their new ones put in; other owners' new rows are ignored."""
    o = owners.select("owner_path").distinct()
    return old.join(o, "owner_path", "left_anti").unionByName(new.join(o, "owner_path", "left_semi"))


def refresh_edges(edges: DataFrame, old: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges after a change of owners' occurrences: only keys that the old or new rows of these owners touch are made anew.

    ``edges`` belong to ``old``; ``new`` holds all occurrences after the change.
    """
    o = owners.select("owner_path").distinct()
    key = ["src", "kind", "dst"]
    touched = old.join(o, "owner_path", "left_semi").select(*key).unionByName(new.join(o, "owner_path", "left_semi").select(*key)).dropna().distinct()
    kept = edges.join(touched, key, "left_anti")
    return kept.unionByName(edge_table(new.join(touched, key, "left_semi")))
