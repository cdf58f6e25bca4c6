"""Source trees and their texts as tables."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import extension, glob_pattern
from graphloom.session import Folder

# Languages by file ending.
ENDINGS = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "vue": "vue", "proto": "proto", "html": "html", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "json": "json", "sql": "sql", "md": "markdown", "go": "go", "java": "java", "cs": "csharp", "kt": "kotlin", "php": "php", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
}
MAX_FILE = 5 << 20


def language_of(path: Column) -> Column:
    """Language that a file's ending names; null for unknown endings."""
    pairs = [x for k, v in ENDINGS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[extension(path)]


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_file: int = MAX_FILE) -> DataFrame:
    """Files below a folder: path (relative), size, modified, language, status, digest, content.

    ``include`` and ``exclude`` are path globs. Files beyond ``max_file`` bytes
    have the status skipped and no content or digest.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    rows = raw.select(F.substring(rel, F.lit(len(os.path.abspath(base)) + 2), F.lit(1 << 30)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    for globs, wanted in ((include, True), (exclude, False)):
        if globs:
            hit = F.col("path").rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
            rows = rows.filter(hit if wanted else ~hit)
    fits = F.col("size") <= max_file
    return rows.select("path", "size", "modified", language_of(F.col("path")).alias("language"), F.when(fits, "indexed").otherwise("skipped").alias("status"), F.when(fits, F.sha2("content", 256)).alias("digest"), F.when(fits, F.decode("content", "UTF-8")).alias("content"))


def check_bounds(files: DataFrame, most_files: int = 100_000, most_bytes: int = 500 << 20) -> None:
    """ValueError if a scan has more files, or more bytes to read, than an index is meant for."""
    n = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("size"))), F.lit(0)).alias("b")).first()
    if n["n"] > most_files or n["b"] > most_bytes:
        raise ValueError(f"{n['n']} files with {n['b']} bytes; the limits are {most_files} and {most_bytes}")


def unchanged(listing: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits a listing by (path, size, modified): files to read again, and files whose last row can be reused."""
    key = ["path", "size", "modified"]
    return listing.join(last.select(*key), key, "left_anti"), last.join(listing.select(*key), key, "left_semi")


def lines(texts: DataFrame) -> DataFrame:
    """Lines of files: path, line (from 1), text. Null contents have none; any line end counts."""
    split = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    return texts.filter(F.col("path").isNotNull() & F.col("content").isNotNull()).distinct().select("path", F.posexplode(split).alias("line", "text")).withColumn("line", F.col("line") + 1)


def search_lines(texts: DataFrame, pattern: str, context: int = 0, literal: bool = False) -> DataFrame:
    """Lines that match, and those within ``context`` lines of one: path, line, text, is_match.

    A line near several matches is given once. The lines of a file are
    exploded within its own row, so no join is needed.
    """
    split = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    hit = (lambda x: F.contains(x, F.lit(pattern))) if literal else (lambda x: x.rlike(pattern))
    rows = texts.filter(F.col("path").isNotNull() & F.col("content").isNotNull()).distinct().select("path", split.alias("l"))
    rows = rows.withColumn("m", F.filter(F.transform("l", lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())).filter(F.size("m") > 0)
    near = F.array_distinct(F.flatten(F.transform("m", lambda i: F.sequence(F.greatest(i - context, F.lit(0)), F.least(i + context, F.size("l") - 1)))))
    return rows.select("path", "l", "m", F.explode(near).alias("i")).select("path", (F.col("i") + 1).alias("line"), F.get("l", F.col("i")).alias("text"), F.array_contains("m", F.col("i")).alias("is_match"))


def snippet(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The lines of spans (path, line, end_line): path, line, end_line, text; shorter where the file ends before."""
    split = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    s = spans.filter((F.col("line") >= 1) & (F.col("end_line") >= F.col("line")))
    return s.join(texts.select("path", split.alias("l")), "path").select(*spans.columns, F.array_join(F.slice("l", F.col("line").cast("int"), (F.col("end_line") - F.col("line") + 1).cast("int")), "\n").alias("text"))


def verified(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Texts with whether their digest is the recorded one: path, digest, recorded, matches (null without a record)."""
    d = texts.select("path", F.sha2("content", 256).alias("digest")).distinct()
    return d.join(files.select("path", F.col("digest").alias("recorded")), "path", "left").withColumn("matches", F.col("digest") == F.col("recorded"))


def cached_facts(sources: DataFrame, cache: DataFrame, rules: str) -> tuple[DataFrame, DataFrame]:
    """Facts found in the cache for (digest, rules), and the sources that still have to be extracted."""
    c = cache.filter(F.col("rules") == rules)
    return c.join(sources.select("digest").distinct(), "digest", "left_semi"), sources.join(c.select("digest"), "digest", "left_anti")


def publish(tables: dict[str, DataFrame], root: str, generation: str, expected: str | None = None) -> str:
    """Writes the tables of a generation, checks that all can be read, and then points to them; returns the folder.

    Readers see the old generation or the new one, never a mixture. Pointers
    are numbered and a number is taken once, so that of two writers that start
    from the same generation one fails. With ``expected`` the current pointer
    must name that generation.
    """
    spark = next(iter(tables.values())).sparkSession
    state = current(spark, root)
    if expected is not None and state.get("generation") != expected:
        raise RuntimeError("another generation was published")
    at = f"{root.rstrip('/')}/gen-{generation}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{at}/{name}")
        if spark.read.schema(df.schema).parquet(f"{at}/{name}").count() != seen.get.get("n", 0):
            raise RuntimeError(f"{name} was not written whole")
    point(spark, root, state, {"generation": generation, "path": at})
    return at


def point(spark: SparkSession, root: str, state: dict, new: dict) -> None:
    """Publishes what follows ``state``; RuntimeError if something else already does."""
    no = state.get("no", 0) + 1
    try:
        Folder(spark, root).publish(f"current-{no:012d}.json", json.dumps(new | {"no": no}))
    except FileExistsError:
        raise RuntimeError("another generation was published") from None


def current(spark: SparkSession, root: str) -> dict:
    """What the latest pointer names; empty before the first generation."""
    folder = Folder(spark, root)
    names = [n for n in folder.names() if n.startswith("current-")]
    return json.loads(folder.read(names[-1])) if names else {}


def stale(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files of a listing (path, digest) that differ from what is indexed: path, change (added, removed or changed)."""
    a, b = listing.select("path", F.col("digest").alias("now")).alias("a"), indexed.select("path", F.col("digest").alias("was")).alias("b")
    j = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    change = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    return j.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).filter(F.col("change").isNotNull())


def plan_refresh(changes: DataFrame, rebuild_share: float, n_indexed: int) -> str:
    """What a stale index needs: fresh, delta, or rebuild if more than a share of what is indexed changed."""
    n = changes.limit(int(n_indexed * rebuild_share) + 1).count()
    return "fresh" if n == 0 else "rebuild" if n > n_indexed * rebuild_share else "delta"


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of files (path, content) that only one version has, as often as it has them more: path, text, version, n."""
    both = lines(old).groupBy("path", "text").agg(F.count(F.lit(1)).alias("a")).join(lines(new).groupBy("path", "text").agg(F.count(F.lit(1)).alias("b")), ["path", "text"], "full").na.fill(0, ["a", "b"])
    return both.filter("a <> b").select("path", "text", F.when(F.col("a") > F.col("b"), "old").otherwise("new").alias("version"), F.abs(F.col("a") - F.col("b")).alias("n"))


def outline(nodes: DataFrame, kinds: tuple[str, ...] = ("module", "class", "struct", "enum", "trait", "interface", "impl", "function", "method")) -> DataFrame:
    """The outline of each file: path, entries (kind, name, line, end_line in order of lines)."""
    e = F.struct("line", "end_line", "kind", "name")
    return nodes.filter(F.col("kind").isin(*kinds) & F.col("path").isNotNull()).groupBy("path").agg(F.array_sort(F.collect_set(e)).alias("entries"))


def previews(texts: DataFrame, nodes: DataFrame, before: int = 3) -> DataFrame:
    """Each symbol's lines with up to ``before`` leading ones, cut off where an earlier symbol of the file ends: id, path, first, end_line, text."""
    own = nodes.filter(F.col("line").isNotNull() & F.col("end_line").isNotNull() & (F.col("line") >= 1) & (F.col("end_line") >= F.col("line")))
    ends = own.select("path", F.col("end_line").alias("e")).distinct()
    # only ends within the leading lines matter
    near = own.select("id", "path", "line", F.explode(F.sequence(F.col("line") - before, F.col("line") - 1)).alias("e")).join(ends, ["path", "e"], "left_semi").groupBy("id").agg(F.max("e").alias("e"))
    spans = own.join(near, "id", "left").select("id", "path", F.greatest(F.col("line") - before, F.coalesce(F.col("e") + 1, F.lit(1)), F.lit(1)).alias("line"), "end_line")
    return snippet(texts, spans).select("id", "path", F.col("line").alias("first"), "end_line", "text")


def export(rows: DataFrame, column: str, root: str, name: str) -> str:
    """Writes a text column to a folder below ``root``, in the order of the rows; returns the folder. Names leading out of it are refused."""
    if name.startswith("/") or ".." in name.split("/") or not name:
        raise ValueError(name)
    at = f"{root.rstrip('/')}/{name}"
    rows.select(F.col(column).cast("string").alias("value")).write.text(at)
    return at
