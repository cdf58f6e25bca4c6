"""Duplicate files and symbols, exact and near."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import normal_digest, normal_path


def duplicate_files(files: DataFrame) -> DataFrame:
    """Groups of paths with the same digest: digest, n_files, size, duplicated_bytes.

    A path counts once per digest; null digests form no group. The group's size
    is its largest recorded one, and a null size counts as 0.
    """
    f = files.select(normal_path(F.col("path")).alias("path"), normal_digest(F.col("digest")).alias("digest"), F.coalesce("size", F.lit(0)).alias("size")).dropna(subset=["digest", "path"])
    per_path = f.groupBy("digest", "path").agg(F.max("size").alias("size"))
    g = per_path.groupBy("digest").agg(F.count(F.lit(1)).alias("n_files"), F.max("size").alias("size")).filter("n_files > 1")
    return g.withColumn("duplicated_bytes", F.col("size") * (F.col("n_files") - 1))


def duplicate_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal texts by their SHA-256: text_digest, n_rows, first (the least key)."""
    rows = texts.select(F.col(key).alias("key"), F.sha2(F.col(text), 256).alias("text_digest")).filter(F.col("text_digest").isNotNull()).distinct()
    return rows.groupBy("text_digest").agg(F.count(F.lit(1)).alias("n_rows"), F.min("key").alias("first")).filter("n_rows > 1")


def symbol_bodies(nodes: DataFrame, texts: DataFrame, min_lines: int = 10) -> DataFrame:
    """Bodies of symbols cut out of their files: id, name, n_lines, body (lines trimmed, blank ones dropped).

    Symbols without an end line, or whose file is shorter than their first
    line, have no body; bodies of fewer than ``min_lines`` lines are left out.
    """
    once = texts.filter(F.col("content").isNotNull()).groupBy("path").agg(F.max("content").alias("content"))
    own = nodes.dropDuplicates(["id"]).filter(F.col("end_line").isNotNull() & (F.col("line") >= 1) & (F.col("end_line") >= F.col("line"))).select("id", "name", "path", "line", "end_line")
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    cut_out = F.slice(lines, F.col("line").cast("int"), (F.col("end_line") - F.col("line") + 1).cast("int"))
    body = F.filter(F.transform(cut_out, lambda x: F.trim(x)), lambda x: x != "")
    return own.join(once, "path").select("id", "name", body.alias("body")).withColumn("n_lines", F.size("body").cast("long")).filter(F.col("n_lines") >= min_lines)


def duplicate_symbols(bodies: DataFrame) -> DataFrame:
    """Groups of symbols with equal bodies: body_digest, n_symbols, n_lines, first."""
    h = bodies.select("id", "n_lines", F.sha2(F.array_join("body", "\n"), 256).alias("body_digest"))
    return h.groupBy("body_digest").agg(F.count(F.lit(1)).alias("n_symbols"), F.max("n_lines").alias("n_lines"), F.min("id").alias("first")).filter("n_symbols > 1")


def near_clones(bodies: DataFrame, least: float = 0.8) -> DataFrame:
    """Symbols of one name whose bodies agree in at least ``least`` of their lines, position by position: name, cluster, id.

    Equal bodies are one representative first. Along the order of ids each
    representative joins the first cluster whose first member it resembles, or
    starts one. Only clusters of two or more symbols are given. Names are
    clustered one at a time; cluster heads are kept, members are not. A body
    is compared with the heads that have a pair of lines in the same place: as
    fewer lines may differ than there are pairs, no other can resemble it.
    """
    if least < 0.75:
        raise ValueError("pairs of lines find all likenesses of 0.75 or more only")
    h = bodies.select("name", "id", "body", F.sha2(F.array_join("body", "\n"), 256).alias("digest"))
    rep = h.groupBy("name", "digest").agg(F.min(F.struct("id", "body")).alias("r")).select("name", "digest", F.col("r.id").alias("id"), F.col("r.body").alias("body"))
    ordered = rep.repartition("name").sortWithinPartitions("name", "id")

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, heads, places = None, [], {}
        for batch in batches:
            out = []
            for n, d, i, body in zip(batch["name"], batch["digest"], batch["id"], batch["body"]):
                if n != name:
                    name, heads, places = n, [], {}
                body = list(body)
                # a body of one line has no pair and stands for itself
                pairs = [(k, hash((body[k], body[k + 1]))) for k in range(0, len(body) - 1, 2)] or [(0, hash(tuple(body)))]
                for at in sorted({x for p in pairs for x in places.get(p, ())}):
                    head_id, head = heads[at]
                    longest = max(len(head), len(body))
                    if min(len(head), len(body)) >= least * longest and sum(a == b for a, b in zip(head, body)) >= least * longest:
                        break
                else:
                    for p in pairs:
                        places.setdefault(p, []).append(len(heads))
                    heads.append((i, body))
                    head_id = i
                out.append((n, d, head_id))
            yield pd.DataFrame(out, columns=["name", "digest", "cluster"])

    made = ordered.mapInPandas(cluster, "name string, digest string, cluster string")
    members = h.select("name", "digest", "id").join(made, (h["name"].eqNullSafe(made["name"])) & (h["digest"] == made["digest"])).select(h["name"], made["cluster"], h["id"])
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    return members.join(n, "cluster", "left_semi")
