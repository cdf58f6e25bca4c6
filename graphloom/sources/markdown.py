"""Markdown documents as sections, links and claims."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import slug

_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_LINK = re.compile(r"(?<!!)\[([^\]\n]*)\]\(([^)\s]+)(?:[ \t]+\"[^\"]*\")?\)")
_WIKI = re.compile(r"\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]")
_SYMBOL = re.compile(r"`([A-Za-z_][\w]*(?:(?:::|\.)[A-Za-z_]\w*)*)(?:\(\))?`")
_INVARIANT = re.compile(r"^\s*(?:[-*]\s+)?(?:\*\*)?(?:INVARIANT|Invariant)(?:\*\*)?\s*:\s*(?:\*\*)?\s*(.+)$")


def front_matter(text: str) -> tuple[dict[str, str], int]:
    """Keys of a leading --- block and the number of lines it takes."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return {}, 0
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            pairs = (x.partition(":") for x in lines[1:i] if ":" in x)
            return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}, i + 1
    return {}, 0


def split_sections(text: str) -> list[dict]:
    """Sections of a document: title, level, line and text; what stands before the first heading has no title.

    Headings inside fenced code are none. An empty document has no sections.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    _, skip = front_matter(text)
    out: list[dict] = []
    fence = None
    for i, line in enumerate(text.split("\n")[skip:], skip + 1):
        mark = _FENCE.match(line)
        if mark and (fence is None or (mark[1][0] == fence[0] and len(mark[1]) >= len(fence))):
            fence = mark[1] if fence is None else None
        head = None if fence is not None or mark else _HEADING.match(line)
        if head:
            out.append({"title": head[2], "level": len(head[1]), "line": i, "body": []})
        elif out:
            out[-1]["body"].append(line)
        elif line.strip():
            out.append({"title": None, "level": 0, "line": i, "body": [line]})
    return [{**s, "body": "\n".join(s["body"]).strip("\n")} for s in out]


SECTIONS = "ordinal long, title string, level long, line long, body string, links array<string>, wikilinks array<string>, symbols array<string>, invariants array<string>"


def sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections of documents with their links, wiki links, named symbols and invariants, in order.

    Null texts have none.
    """
    kind = documents.schema[key].dataType.simpleString()
    strings = pa.list_(pa.string())
    key_type = pa.int64() if kind in ("bigint", "int") else pa.string()
    schema = pa.schema([(key, key_type), ("ordinal", pa.int64()), ("title", pa.string()), ("level", pa.int64()), ("line", pa.int64()), ("body", pa.string()), *[(n, strings) for n in ("links", "wikilinks", "symbols", "invariants")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for n, s in enumerate(split_sections(t or "")):
                        body = s["body"]
                        rows.append({key: k, "ordinal": n, "title": s["title"], "level": s["level"], "line": s["line"], "body": body, "links": [m[2] for m in _LINK.finditer(body)], "wikilinks": [m[1].strip() for m in _WIKI.finditer(body)], "symbols": sorted({m[1] for m in _SYMBOL.finditer(body)}), "invariants": [m[1].strip() for line in body.split("\n") if (m := _INVARIANT.match(line))]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.select(F.col(key).cast("long" if key_type == pa.int64() else "string"), text).mapInArrow(run, f"{key} {'long' if key_type == pa.int64() else 'string'}, {SECTIONS}")


def typed_documents(documents: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Documents with what their front matter says: key, doc_type (by place without one), title, status."""
    schema = f"{key} string, doc_type string, title string, status string"
    out = pa.schema([(key, pa.string()), ("doc_type", pa.string()), ("title", pa.string()), ("status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head, _ = front_matter((t or "").replace("\r\n", "\n").replace("\r", "\n"))
                rows.append({key: k, "doc_type": head.get("doc_type"), "title": head.get("title"), "status": head.get("status")})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    found = documents.select(F.col(key).cast("string").alias(key), text).mapInArrow(run, schema)
    return found.withColumn("doc_type", F.coalesce("doc_type", default_type(F.col(key))))


def default_type(path: Column) -> Column:
    """Document type by place: contract below docs/milestones or docs/contracts, else guide."""
    return F.when(path.rlike("(?:^|/)docs/(?:milestones|contracts)/"), "contract").otherwise("guide")


def anchors(section: DataFrame, key: str = "doc_id") -> DataFrame:
    """Anchors of titled sections; repeated ones of a document get -1, -2 and so on: key, ordinal, anchor."""
    from pyspark.sql import Window

    s = section.filter(F.col("title").isNotNull()).select(key, "ordinal", slug(F.col("title")).alias("slug"))
    n = F.row_number().over(Window.partitionBy(key, "slug").orderBy("ordinal")) - 1
    return s.select(key, "ordinal", F.when(n == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))).alias("anchor"))


def resolved(path: Column) -> Column:
    """A relative path without . and, as far as there are folders to leave, without .. at any depth."""

    def step(held: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(held) > 0) & ~F.element_at(held, -1).eqNullSafe("..")
        return F.when(x == ".", held).when(up, F.slice(held, 1, F.size(held) - 1)).otherwise(F.concat(held, F.array(x)))

    return F.array_join(F.aggregate(F.split(F.regexp_replace(path, "/+", "/"), "/"), F.array().cast("array<string>"), step), "/")


LINES = "^L([0-9]+)(?:C[0-9]+)?(?:-L?([0-9]+))?$"


def broken_links(section: DataFrame, paths: DataFrame, key: str = "path", n_lines: DataFrame | None = None) -> DataFrame:
    """Relative links whose target file is not among ``paths``, whose anchor is not in it, or whose lines it does not have: key, link, problem.

    Links are percent-decoded; those to other sites and within mail are not
    looked at. Line anchors (L3, L3-L9) are checked where ``n_lines`` (path,
    n_lines) knows the file.
    """
    link = section.select(key, F.explode("links").alias("link")).filter(~F.col("link").rlike("^(?:[a-z][a-z0-9+.-]*:|//)"))
    plain = F.coalesce(F.try_url_decode(F.regexp_replace("link", "\\+", "%2B")), F.col("link"))
    target = F.regexp_replace(F.substring_index(plain, "#", 1), "^\\./", "")
    folder = F.regexp_replace(F.col(key), "[^/]*$", "")
    full = F.when(target == "", F.col(key)).when(target.startswith("/"), F.substring(target, 2, 1 << 20)).otherwise(F.concat(folder, target))
    wanted = link.select(key, "link", resolved(full).alias("target"), F.when(plain.contains("#"), F.substring_index(plain, "#", -1)).alias("anchor"))
    files = paths.select(F.col("path").alias("target")).distinct()
    known = anchors(section, key).select(F.col(key).alias("target"), "anchor").distinct()
    gone = wanted.join(files, "target", "left_anti").select(key, "link", F.lit("no such file").alias("problem"))
    there = wanted.join(files, "target", "left_semi").filter(F.col("anchor").isNotNull())
    lined = F.col("anchor").rlike(LINES)
    lost = there.filter(F.col("target").endswith(".md") & ~lined).join(known, ["target", "anchor"], "left_anti").select(key, "link", F.lit("no such anchor").alias("problem"))
    out = gone.unionByName(lost)
    if n_lines is not None:
        last = F.coalesce(F.nullif(F.regexp_extract("anchor", LINES, 2), F.lit("")), F.regexp_extract("anchor", LINES, 1)).cast("long")
        first = F.regexp_extract("anchor", LINES, 1).cast("long")
        over = there.filter(lined).join(n_lines.select(F.col("path").alias("target"), "n_lines"), "target").filter((first < 1) | (last < first) | (last > F.col("n_lines")))
        out = out.unionByName(over.select(key, "link", F.lit("no such lines").alias("problem")))
    return out.distinct()


def dead_symbols(section: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Symbols that documents name and no node has as name or qualified name: key, symbol."""
    named = section.select(key, F.explode("symbols").alias("symbol")).distinct()
    names = nodes.select(F.col("name").alias("symbol")).union(nodes.select("qualname")).distinct()
    return named.join(names, "symbol", "left_anti").select(key, "symbol")
