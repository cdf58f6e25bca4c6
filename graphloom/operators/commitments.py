"""Content commitments: a digest per owner, domain and whole index that does not depend on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL = "\u0000"


def row_text(columns: list[str]):
    """A row as one text; nulls differ from every value and columns can't run together."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def leaves(domain: str, rows: DataFrame, owner: str, columns: list[str]) -> DataFrame:
    """One digest per owner of a domain: domain, owner, n_rows, digest.

    It is the SHA-256 of the owner's sorted row digests, in pages of sorted
    hashes: an owner of any size is digested page by page (rows whose digest
    starts alike), then over its pages. Repeated rows count once.
    """
    d = rows.select(F.col(owner).alias("owner"), F.sha2(row_text(columns), 256).alias("h")).distinct()
    pages = d.groupBy("owner", F.substring("h", 1, 3).alias("page")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"), F.count(F.lit(1)).alias("n"))
    per = pages.groupBy("owner").agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "p"))), lambda x: x["p"]), ""), 256).alias("digest"))
    return per.select(F.lit(domain).alias("domain"), F.coalesce("owner", F.lit("")).alias("owner"), "n_rows", "digest")


def domain_digests(leaf: DataFrame) -> DataFrame:
    """One digest per domain over its owners, paged the same way: domain, n_owners, digest."""
    h = leaf.select("domain", F.sha2(F.concat_ws(NULL, "owner", "digest"), 256).alias("h"))
    pages = h.groupBy("domain", F.substring("h", 1, 3).alias("page")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"), F.count(F.lit(1)).alias("n"))
    return pages.groupBy("domain").agg(F.sum("n").alias("n_owners"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "p"))), lambda x: x["p"]), ""), 256).alias("digest"))


def root(domains: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """The index's digest over its domains and metadata: root. A row per domain is all that meets in one task."""
    meta = ";".join(f"{k}={v}" for k, v in sorted((metadata or {}).items()))
    parts = domains.agg(F.array_sort(F.collect_list(F.concat_ws(NULL, "domain", "digest"))).alias("d"))
    return parts.select(F.sha2(F.concat_ws(NULL, F.array_join("d", NULL), F.lit(meta)), 256).alias("root"))


def graph_leaves(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Leaves of the graph's two domains, by owning file."""
    n = leaves("nodes", nodes, "owner_path", ["id", "kind", "name", "qualname", "path", "line", "end_line", "is_test", "language", "generated", "details"])
    return n.unionByName(leaves("occurrences", occurrences, "owner_path", ["ordinal", "src", "kind", "dst", "line", "evidence", "confidence"]))


def posting_leaves(texts: DataFrame, owner: str, columns: list[str]) -> DataFrame:
    """Leaves of a full-text index over text columns, by owner: each term with its column and place is a row."""
    from graphloom.functions.text import words

    parts = [texts.select(F.col(owner).alias("owner"), F.lit(c).alias("column"), F.posexplode(words(F.coalesce(F.col(c), F.lit("")))).alias("place", "term")) for c in columns]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return leaves("postings", rows.withColumn("owner", F.col("owner").cast("string")), "owner", ["column", "term", "place"])


def verify(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Owners whose digest is missing, unexpected or different: domain, owner, problem."""
    a, b = stored.select("domain", "owner", F.col("digest").alias("was")), now.select("domain", "owner", F.col("digest").alias("is_now"))
    j = a.join(b, ["domain", "owner"], "full")
    p = F.when(F.col("is_now").isNull(), "missing").when(F.col("was").isNull(), "unexpected").when(F.col("was") != F.col("is_now"), "different")
    return j.select("domain", "owner", p.alias("problem")).filter(F.col("problem").isNotNull())


def reseal(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored leaves with those of changed owners replaced."""
    return stored.join(changed.select("domain", "owner"), ["domain", "owner"], "left_anti").unionByName(changed)
