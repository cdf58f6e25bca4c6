"""Schemas that drift between files (problem 6).

A file's layout, the sorted list of its paths with their raw types, is the
statistic that everything else follows from. It is taken in one pass over the
bodies and is small, as alike files have alike layouts. Changes are found by
walking the layouts of a series; the series is walked in chunks of files, whose
ends are linked by a second, much shorter walk, so that a series of any length
spans many tasks. The consistent table casts each value to its path's type.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ranks import running
from graphloom.session import cut, scratch

CHUNK = 1000  # files of a series that one walk takes
COLUMN_SHARE = 0.01  # share of the files from which on a path is a column of its own
FIELD, ENTRY = "\u0001", "\u0002"  # between a path, its parent and its type; between the paths of a layout
CODES = {"number": "n", "string": "s", "boolean": "b", "array": "a", "object": "o", None: "-"}
TYPES = {c: t for t, c in CODES.items()}


def _kind(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def _refuse(name: str):
    raise ValueError(name)


def _clean(pairs: list[tuple[str, object]]) -> dict:
    """An object without the separators in its keys and without lone surrogates, each of which becomes U+FFFD."""
    whole = lambda x: x.translate({1: 0xFFFD, 2: 0xFFFD}).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return {whole(k): whole(v) if isinstance(v, str) else v for k, v in pairs}


_ODD = re.compile(r"\\u(?:000[12]|[dD][89a-fA-F])")


def _parse(body: str | None) -> dict | None:
    """The top object of a body; None if it is no JSON object, or nested beyond what the JSON parser takes."""
    try:
        top = json.loads(body, parse_constant=_refuse, object_pairs_hook=_clean if _ODD.search(body) else None) if body else None
    except (ValueError, RecursionError):
        return None
    return top if isinstance(top, dict) else None


def _fields(top: dict) -> Iterator[tuple[str, str, str | None, object]]:
    """Fields at any depth, those in arrays aside: path, parent, type, value."""
    todo = [("", top)]
    while todo:
        prefix, node = todo.pop()
        for key, v in node.items():
            path, kind = f"{prefix}.{key}" if prefix else key, _kind(v)
            yield path, prefix, kind, v
            if kind == "object":
                todo.append((path, v))


def _layout(body: str | None) -> str | None:
    top = _parse(body)
    if top is None:
        return None
    return ENTRY.join(sorted(f"{path}{FIELD}{prefix}{FIELD}{CODES[kind]}" for path, prefix, kind, _ in _fields(top)))


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = [_layout(b) for b in part.column(4).to_pylist()]
            kept = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(found, pa.string())], names=["result_name", "series", "recorded_at", "received_at", "layout"])
            yield kept.filter(pa.array([x is not None for x in found]))


def received_layouts(results: DataFrame) -> DataFrame:
    """One row per file, received again or not: result_name, series, recorded_at, received_at, ord, layout; a written table.

    ``ord`` is the file's place in its series, from 0; equal times of a series
    are ordered by name. Of a file received more than once the first holds
    (null times first, then by series, time and layout). Files without a name
    or series, and bodies that are no JSON object, are left out.
    """
    named = results.filter(F.col("result_name").isNotNull() & F.col("series").isNotNull() & F.col("body").isNotNull())
    schema = f"result_name string, series string, recorded_at {results.schema['recorded_at'].dataType.simpleString()}, received_at {results.schema['received_at'].dataType.simpleString()}, layout string"
    rows = named.select("result_name", "series", "recorded_at", "received_at", "body").mapInArrow(_layouts, schema)
    first = rows.groupBy("result_name").agg(F.min(F.struct("received_at", "series", "recorded_at", "layout")).alias("r"))
    once = first.select("result_name", "r.*")
    with scratch(results.sparkSession) as keep:
        return keep(cut(running(once, ["series"], ["recorded_at", "result_name"], out="ord")))


def _walk(standing: dict[str, tuple[str, str]] | None, layout: str) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str, str, str]], list[tuple[str, str, str | None, str]]]:
    """One step along a series: the paths with parent and standing type, the retyped ones, and those that came or went.

    ``standing`` is what held before, None before the first file. Retyped:
    path, parent, type, old type. Came or went: path, parent, type, change. The
    type '-' is that of a field which has only held null.
    """
    now: dict[str, tuple[str, str]] = {}
    retyped, moved = [], []
    for entry in layout.split(ENTRY) if layout else ():
        path, parent, code = entry.split(FIELD)
        was = standing.get(path) if standing is not None else None
        if was is None:
            if standing is not None:
                moved.append((path, parent, code, "added"))
        elif code == "-":
            code = was[1]
        elif was[1] not in ("-", code):
            retyped.append((path, parent, code, was[1]))
        now[path] = (parent, code)
    if standing is not None and len(standing) + sum(m[3] == "added" for m in moved) > len(now):
        moved += [(path, parent, code, "removed") for path, (parent, code) in standing.items() if path not in now]
    return now, retyped, moved


def _cases(retyped: list, moved: list) -> Iterator[tuple[str, str, str | None, str | None]]:
    """Reported cases of a step: field, change, was, type. What lies in an object that changed itself is left out."""
    changed = {x[0] for x in retyped} | {x[0] for x in moved}
    for path, parent, code, was in retyped:
        if parent not in changed:
            yield path, "retyped", TYPES[was], TYPES[code]
    groups: dict[tuple[str, str], list] = {}
    for path, parent, code, change in moved:
        if parent not in changed:
            groups.setdefault((parent, code), []).append((path, change))
    for (_, code), found in groups.items():
        if code != "-" and len(found) == 2 and found[0][1] != found[1][1]:
            (new,), (old,) = ([p for p, c in found if c == x] for x in ("added", "removed"))
            yield new, "renamed", old, TYPES[code]
        else:
            for path, change in found:
                yield path, change, None, TYPES[code]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each chunk as far as the chunk alone tells: '?' stands for the type that held before it."""
    key, standing, rows = None, None, []
    for batch in batches:
        for series, chunk, layout in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (series, chunk) != key:
                if key is not None:
                    rows.append((*key, _text(standing)))
                key, standing = (series, chunk), None
            if standing is None and chunk > 0:
                # what is null in the chunk's first file may have stood before, or be new there
                standing = {p: (q, "?" if c == "-" else c) for p, q, c in (e.split(FIELD) for e in layout.split(ENTRY) if e)}
            else:
                standing = _walk(standing, layout)[0]
        yield _batch(rows)
        rows = []
    if key is not None:
        yield _batch([(*key, _text(standing))])


def _text(standing: dict[str, tuple[str, str]]) -> str:
    return ENTRY.join(f"{p}{FIELD}{q}{FIELD}{c}" for p, (q, c) in sorted(standing.items()))


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["series", "chunk", "state"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the ends of a series' chunks in order, the state that each next chunk starts from."""
    series_now, before = None, {}
    for batch in batches:
        rows = []
        for series, chunk, state in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if series != series_now:
                series_now, before = series, {}
            held = {p: (q, c) for p, q, c in (e.split(FIELD) for e in state.split(ENTRY) if e)}
            before = {p: (q, before.get(p, (q, "-"))[1] if c == "?" else c) for p, (q, c) in held.items()}
            rows.append((series, chunk + 1, _text(before)))
        yield _batch(rows)


def field_changes(layouts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Changes of fields from each file of a series to the next: series, ord, result_name, field, change, was, type.

    ``layouts`` is what :func:`received_layouts` gives. ``change`` is added,
    removed, renamed (``was`` is the old path) or retyped (``was`` is the old
    type). A null keeps a field in place and leaves its last type standing; a
    field absent for a while is a new field when it returns. What lies inside
    an object that itself changed is left out. In one object a rename is one
    field that went and one that came with the same type, each the only one of
    that type.
    """
    steps = layouts.select("series", F.floor(F.col("ord") / chunk).alias("chunk"), "ord", "result_name", "layout")
    in_order = lambda df, *by: df.repartition(*by).sortWithinPartitions(*dict.fromkeys([*by, "chunk", *(["ord"] if "ord" in df.columns else [])]))
    # only series of more than one chunk have anything to link
    longer = layouts.groupBy("series").agg(F.max("ord").alias("m")).filter(F.col("m") >= chunk).select("series")
    state = "series string, chunk long, state string"
    ends = in_order(steps.join(longer, "series", "left_semi"), "series", "chunk").select("series", "chunk", "layout").mapInArrow(_ends, state)
    starts = cut(in_order(ends, "series").mapInArrow(_linked, state))
    first = steps.select("series", "chunk", "ord", "result_name", "layout", F.lit(None).cast("string").alias("state"))
    given = starts.select("series", "chunk", F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("string").alias("result_name"), F.lit(None).cast("string").alias("layout"), "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, standing, last = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for series, no, ord_, name, layout, start in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (series, no) != key:
                    key, standing, last = (series, no), None, None
                if layout is None:  # sorts before the chunk's files
                    standing = {p: (q, c) for p, q, c in (e.split(FIELD) for e in start.split(ENTRY) if e)}
                    continue
                if layout == last:
                    continue
                standing, retyped, moved = _walk(standing, layout)
                # files with nulls go through the walk each time, as what stands differs from what they show
                last = layout if not layout.endswith("-") and f"-{ENTRY}" not in layout else None
                if retyped or moved:
                    out += [(series, ord_, name, *c) for c in _cases(retyped, moved)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i == 1 else pa.string()) for i in range(7)], names=["series", "ord", "result_name", "field", "change", "was", "type"])

    both = in_order(first.unionByName(given), "series", "chunk")
    return both.mapInArrow(run, "series string, ord long, result_name string, field string, change string, was string, type string")


def file_types(layouts: DataFrame) -> DataFrame:
    """The paths of each file with their types: series, ord, result_name, path, type (null for a null)."""
    entry = F.split("e", FIELD)
    kinds = F.create_map(*[F.lit(x) for c, t in TYPES.items() if t for x in (c, t)])
    rows = layouts.filter(F.col("layout") != "").select("series", "ord", "result_name", F.explode(F.split("layout", ENTRY)).alias("e"))
    return rows.select("series", "ord", "result_name", entry[0].alias("path"), F.try_element_at(kinds, entry[2]).alias("type"))


def path_types(layouts: DataFrame) -> DataFrame:
    """Per path and type the files that have it; ``main`` marks the path's commonest type: path, type, n_files, main.

    Files of one layout are counted together before their paths are taken
    apart. Ties go to the smaller type name. A path that only ever holds null
    has the type null and no main one.
    """
    alike = layouts.groupBy("layout").agg(F.count(F.lit(1)).alias("n")).filter(F.col("layout") != "")
    entry = F.split("e", FIELD)
    kinds = F.create_map(*[F.lit(x) for c, t in TYPES.items() if t for x in (c, t)])
    rows = alike.select("n", F.explode(F.split("layout", ENTRY)).alias("e")).select("n", entry[0].alias("path"), F.try_element_at(kinds, entry[2]).alias("type"))
    n = rows.groupBy("path", "type").agg(F.sum("n").alias("n_files"))
    w = Window.partitionBy("path").orderBy(F.col("type").isNull(), F.desc("n_files"), "type")
    return n.select("path", "type", "n_files", ((F.row_number().over(w) == 1) & F.col("type").isNotNull()).alias("main"))


def _cast(v, target: str):
    """A value as its column's type: the value, or None and whether the cast failed. Text that spells a number or flag is one."""
    kind = _kind(v)
    if kind is None:
        return None, False
    if target == "number":
        try:
            return (float(v), False) if kind in ("number", "string") else (None, True)
        except (ValueError, OverflowError):
            return None, True
    if target == "boolean":
        if kind == "boolean":
            return v, False
        low = v.strip().lower() if kind == "string" else None
        return (low == "true", False) if low in ("true", "false") else (None, True)
    if target == "array":
        return (json.dumps(v), False) if kind == "array" else (None, True)
    if kind == "object":
        return None, True
    return (v if kind == "string" else json.dumps(v)), False


def _targets(layouts: DataFrame, share: float) -> list[tuple[str, str]]:
    """Paths of at least a share of the files with their main types, other than objects.

    As a file has a bounded number of fields, there are at most that number
    over the share, whatever the number of files.
    """
    types = path_types(layouts)
    least = layouts.count() * share
    own = types.groupBy("path").agg(F.sum("n_files").alias("n"), F.max(F.when(F.col("main"), F.col("type"))).alias("type"))
    return [(r["path"], r["type"]) for r in own.filter((F.col("n") >= least) & F.col("type").isNotNull() & (F.col("type") != "object")).orderBy("path").collect()]


def _by_name(results: DataFrame, layouts: DataFrame) -> DataFrame:
    """The body that holds for each file of ``layouts``: result_name, series, recorded_at, ord, body."""
    key = ["result_name", "series", "recorded_at", "received_at"]
    a, b = results.filter(F.col("body").isNotNull()).alias("a"), layouts.alias("b")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = a.join(b, same).select("b.result_name", "b.series", "b.recorded_at", "b.ord", "b.layout", "a.body")
    return j.groupBy("result_name", "series", "recorded_at", "ord", "layout").agg(F.min("body").alias("body"))


def consistent_table(results: DataFrame, layouts: DataFrame, share: float = COLUMN_SHARE) -> DataFrame:
    """One row per file with the same typed columns for all: result_name, series, recorded_at, a column per path, other, failed.

    A path that at least ``share`` of the files have is a column named like it,
    of its main type: double, boolean, or string (arrays as JSON text). The
    rarer ones stand in the map ``other`` as JSON text. ``failed`` lists the
    paths whose value is not null and did not fit the column; an object where
    a value belongs is such. Names clashing with the fixed columns get a
    leading underscore.
    """
    wanted = _targets(layouts, share)
    fixed = {"result_name", "series", "recorded_at", "other", "failed"}
    names = {p: f"_{p}" if p.lower() in fixed else p for p, _ in wanted}
    taken: set[str] = set()
    for p in names:  # columns that differ by letters' case only
        while names[p].lower() in taken:
            names[p] = "_" + names[p]
        taken.add(names[p].lower())
    arrow = {"number": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array": pa.string()}
    sql = {"number": "double", "boolean": "boolean", "string": "string", "array": "string"}
    files = _by_name(results, layouts).select("result_name", "series", "recorded_at", "body")
    at = files.schema["recorded_at"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {p: (i, t) for i, (p, t) in enumerate(wanted)}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                columns: list[list] = [[None] * part.num_rows for _ in wanted]
                other, failed = [], []
                for n, body in enumerate(part.column(3).to_pylist()):
                    rest, bad = [], []
                    for path, _, kind, v in _fields(_parse(body) or {}):
                        place = index.get(path)
                        if place is None:
                            if kind not in ("object", None):
                                rest.append((path, json.dumps(v)))
                        else:
                            columns[place[0]][n], wrong = _cast(v, place[1])
                            if wrong:
                                bad.append(path)
                    other.append(sorted(rest))
                    failed.append(sorted(bad))
                arrays = [*(part.column(i) for i in range(3)), *(pa.array(c, arrow[t]) for c, (_, t) in zip(columns, wanted)), pa.array(other, pa.map_(pa.string(), pa.string())), pa.array(failed, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["result_name", "series", "recorded_at", *names.values(), "other", "failed"])

    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    schema = ", ".join(["result_name string", "series string", f"recorded_at {at}", *(f"{quoted(names[p])} {sql[t]}" for p, t in wanted), "other map<string,string>", "failed array<string>"])
    return files.mapInArrow(run, schema)
