"""Facts of source files: Python declarations and calls, SQL table uses, manifests, and structural search."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- Python


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.path, self.scope, self.rows = path, [], []
        self.top = f"module:{path}"

    def here(self) -> str:
        return f"py:{self.path}:{'.'.join(self.scope)}" if self.scope else self.top

    def add(self, kind: str, line: int, end: int, name: str, detail: str | None = None, target: str | None = None) -> None:
        self.rows.append({"path": self.path, "sort": kind, "src": self.here(), "name": name, "line": line, "end_line": end, "detail": detail, "target": target})

    def declare(self, node, kind: str) -> None:
        for d in node.decorator_list:
            self.add("decorates", d.lineno, d.end_lineno, ast.unparse(d), None, ".".join([*self.scope, node.name]))
        self.add(kind, node.lineno, node.end_lineno, ".".join([*self.scope, node.name]), ast.get_docstring(node))
        self.scope.append(node.name)
        for base in getattr(node, "bases", []):
            self.add("inherits", base.lineno, base.end_lineno, ast.unparse(base))
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        self.declare(node, "function")

    def visit_AsyncFunctionDef(self, node) -> None:
        self.declare(node, "function")

    def visit_ClassDef(self, node) -> None:
        self.declare(node, "class")

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("imports", node.lineno, node.end_lineno, a.name)

    def visit_ImportFrom(self, node) -> None:
        for a in node.names:
            self.add("imports", node.lineno, node.end_lineno, "." * node.level + ".".join(x for x in (node.module, a.name) if x))

    def visit_Call(self, node) -> None:
        self.add("calls", node.lineno, node.end_lineno, ast.unparse(node.func))
        self.generic_visit(node)


def python_facts(path: str, content: str) -> list[dict]:
    """Declarations, imports, calls, bases and decorators of a Python file; one row of sort error if it does not parse."""
    v = _Facts(path)
    try:
        v.visit(ast.parse(content))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"path": path, "sort": "error", "src": v.top, "name": type(e).__name__, "line": getattr(e, "lineno", None) or 1, "end_line": None, "detail": None, "target": None}]
    return v.rows


# -- SQL

_SQL_TOKEN = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'|\$(\w*)\$.*?\$\1\$|"((?:[^"]|"")+)"|`([^`]+)`|[A-Za-z_][\w$]*|[(),.;]""", re.S)
_USES = {"FROM": "queries_table", "JOIN": "queries_table", "INTO": "mutates_table", "UPDATE": "mutates_table", "TABLE": "defines_table", "VIEW": "defines_table", "REFERENCES": "references_table"}


def sql_uses(content: str) -> list[tuple[str, str, int]]:
    """Tables that SQL text uses: (use, table, line). Names of common table expressions are none; comments and strings hide."""
    tokens = []
    for m in _SQL_TOKEN.finditer(content):
        t = m.group()
        if t[0] in "-/'$":
            continue
        quoted = m.group(2) or m.group(3)
        tokens.append((quoted or t, bool(quoted), m.start()))
    local = {t.lower() for i, (t, q, _) in enumerate(tokens) if i + 2 < len(tokens) and tokens[i + 1][0].upper() == "AS" and tokens[i + 2][0] == "(" and i and tokens[i - 1][0].upper() in ("WITH", "RECURSIVE", ",")}
    out, i = [], 0
    while i < len(tokens):
        word, quoted, _ = tokens[i]
        use = None if quoted else _USES.get(word.upper())
        i += 1
        if use is None or (word.upper() == "UPDATE" and i > 1 and tokens[i - 2][0].upper() in ("ON", "FOR", "DO")):
            continue
        if word.upper() == "FROM" and i > 1 and tokens[i - 2][0].upper() == "DELETE":
            use = "mutates_table"
        dropped = word.upper() in ("TABLE", "VIEW") and i > 1 and tokens[i - 2][0].upper() in ("DROP", "ALTER", "TRUNCATE")
        while i < len(tokens) and tokens[i][0].upper() in ("IF", "NOT", "EXISTS", "ONLY", "LATERAL") and not tokens[i][1]:
            i += 1
        while i < len(tokens) and (tokens[i][1] or re.match(r"[A-Za-z_]", tokens[i][0])) and tokens[i][0].upper() not in ("SELECT", "VALUES", "SET"):
            name, at = tokens[i][0], tokens[i][2]
            i += 1
            while i + 1 < len(tokens) and tokens[i][0] == ".":
                name += "." + tokens[i + 1][0]
                i += 2
            if name.lower() not in local and not (i < len(tokens) and tokens[i][0] == "(" and use == "queries_table"):
                out.append(("mutates_table" if dropped else use, name, content.count("\n", 0, at) + 1))
            if use != "queries_table" or word.upper() != "FROM":
                break
            j = i
            if j < len(tokens) and tokens[j][0].upper() == "AS":
                j += 1
            if j + 1 < len(tokens) and tokens[j][0] != "," and tokens[j + 1][0] == ",":
                j += 1
            if j < len(tokens) and tokens[j][0] == ",":
                i = j + 1
            else:
                break
    return out


_LITERAL = re.compile(r"""//[^\n]*|\"{3}(.*?)\"{3}|'{3}(.*?)'{3}|`([^`]*)`|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'""", re.S)
_STATEMENT = re.compile(r"\s*(?:SELECT\b.*\bFROM\b|WITH\b.*\bAS\s*\(|INSERT\s+INTO\b|UPDATE\b.*\bSET\b|DELETE\s+FROM\b|CREATE\s+(?:TABLE|VIEW)\b)", re.I | re.S)


def embedded_sql(content: str) -> list[tuple[str, str, int]]:
    """Tables used by SQL statements in string literals of code: (use, table, line of the code)."""
    out = []
    for m in _LITERAL.finditer(content):
        group = m.lastindex
        if group and _STATEMENT.match(m[group]):
            first = content.count("\n", 0, m.start(group))
            out += [(use, name, first + line) for use, name, line in sql_uses(m[group])]
    return out


# -- manifests


def manifest(path: str, content: str) -> dict | None:
    """Name, version, members and dependencies that a manifest declares; None for other files or broken ones."""
    base = path.rsplit("/", 1)[-1]
    try:
        if base == "Cargo.toml":
            t = tomllib.loads(content)
            p = t.get("package", {})
            return _component(p.get("name"), p.get("version"), t.get("workspace", {}).get("members", []), [*t.get("dependencies", {}), *t.get("dev-dependencies", {})])
        if base == "pyproject.toml":
            t = tomllib.loads(content)
            p = t.get("project") or t.get("tool", {}).get("poetry", {})
            deps = p.get("dependencies", [])
            names = list(deps) if isinstance(deps, dict) else [re.split(r"[\s<>=!~;\[(]", d, maxsplit=1)[0] for d in deps]
            return _component(p.get("name"), p.get("version"), [], names)
        if base == "package.json":
            t = json.loads(content)
            w = t.get("workspaces", [])
            return _component(t.get("name"), t.get("version"), w.get("packages", []) if isinstance(w, dict) else w, [*t.get("dependencies", {}), *t.get("devDependencies", {})])
        if base == "pnpm-workspace.yaml":
            block = re.search(r"(?m)^packages:[ \t]*\n((?:[ \t]*-.*\n?|[ \t]*\n)*)", content)
            return _component(None, None, [x.strip("'\"") for x in re.findall(r"(?m)^[ \t]*-[ \t]*(\S+)", block[1])] if block else [], [])
        if base == "go.mod":
            name = re.search(r"(?m)^module\s+(\S+)", content)
            deps = re.findall(r"(?m)^(?:require\s+|\t)([\w./-]+\.[\w./-]+)\s+v\S+", content)
            return _component(name and name[1], None, [], deps)
    except (ValueError, AttributeError, TypeError):
        return None
    return None


def _component(name, version, members, dependencies) -> dict:
    text = lambda x: x if isinstance(x, str) else None
    return {"name": text(name), "version": text(version), "members": [str(m) for m in members], "dependencies": sorted({str(d) for d in dependencies})}


# -- structural search

_HOLE = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)?|\$([A-Z_][A-Z0-9_]*)")


def matches(pattern: str, content: str) -> list[tuple[int, int, str]]:
    """Places of a Python text that have the pattern's structure: (line, end_line, bindings as JSON).

    ``$NAME`` stands for one expression, alike wherever it is repeated;
    ``$$$NAME`` for any number of items of a list.
    """
    holes: dict[str, tuple[str, bool]] = {}

    def named(m: re.Match[str]) -> str:
        many = m.group().startswith("$$$")
        key = f"hole_{'many' if many else 'one'}_{m.group(1) or m.group(2) or len(holes)}"
        holes[key] = (m.group(1) or m.group(2) or "", many)
        return key

    tree = ast.parse(_HOLE.sub(named, pattern)).body[0]
    wanted = tree.value if isinstance(tree, ast.Expr) else tree
    try:
        source = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []

    def hole(p) -> tuple[str, bool] | None:
        p = p.value if isinstance(p, ast.Expr) else p
        return holes.get(p.id) if isinstance(p, ast.Name) else holes.get(p.arg) if isinstance(p, ast.arg) else None

    def one(p, n, bound: dict) -> dict | None:
        h = hole(p) if isinstance(p, ast.AST) else None
        if h and not h[1]:
            text = ast.unparse(n) if isinstance(n, ast.AST) else repr(n)
            if not h[0] or bound.get(h[0], text) == text:
                return bound | ({h[0]: text} if h[0] else {})
            return None
        if isinstance(p, str) and p in holes and isinstance(n, str):
            name = holes[p][0]
            return bound | {name: n} if bound.get(name, n) == n else None
        if isinstance(p, list):
            return many(p, n, bound) if isinstance(n, list) else None
        if not isinstance(p, ast.AST):
            return bound if p == n and type(p) is type(n) else None
        if type(p) is not type(n):
            return None
        for field in p._fields:
            if field in ("ctx", "type_comment", "kind", "type_params"):
                continue
            got = one(getattr(p, field, None), getattr(n, field, None), bound)
            if got is None:
                return None
            bound = got
        return bound

    def many(p: list, n: list, bound: dict) -> dict | None:
        if not p:
            return None if n else bound
        h = hole(p[0])
        if h and h[1]:
            for k in range(len(n) + 1):
                text = ", ".join(ast.unparse(x) for x in n[:k])
                if h[0] and bound.get(h[0], text) != text:
                    continue
                got = many(p[1:], n[k:], bound | ({h[0]: text} if h[0] else {}))
                if got is not None:
                    return got
            return None
        if not n:
            return None
        got = one(p[0], n[0], bound)
        return None if got is None else many(p[1:], n[1:], got)

    out = []
    for node in ast.walk(source):
        if hasattr(node, "lineno"):
            got = one(wanted, node, {})
            if got is not None:
                out.append((node.lineno, node.end_lineno, json.dumps(got, sort_keys=True)))
    return sorted(set(out))


# -- over tables


def _per_file(texts: DataFrame, ending: str, fields: list[tuple[str, str]], rows_of) -> DataFrame:
    """Rows that a function makes of each file with an ending; exact repeats of files count once."""
    kinds = {"string": pa.string(), "long": pa.int64(), "strings": pa.list_(pa.string())}
    spelled = {"strings": "array<string>"}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [r for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows_of(p, c)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = texts.select("path", "content").filter(F.col("path").rlike(ending) & F.col("content").isNotNull())
    return own.mapInArrow(run, ", ".join(f"{n} {spelled.get(k, k)}" for n, k in fields)).distinct()


def extract_python(texts: DataFrame) -> DataFrame:
    """Facts of Python files: path, sort, src, name, line, end_line, detail, target."""
    fields = [("path", "string"), ("sort", "string"), ("src", "string"), ("name", "string"), ("line", "long"), ("end_line", "long"), ("detail", "string"), ("target", "string")]
    return _per_file(texts, "\\.py$", fields, python_facts)


def extract_sql(texts: DataFrame) -> DataFrame:
    """Table uses of SQL files: path, use, name, line."""
    return _per_file(texts, "\\.sql$", [("path", "string"), ("use", "string"), ("name", "string"), ("line", "long")], lambda p, c: [{"path": p, "use": u, "name": t, "line": n} for u, t, n in sql_uses(c)])


def extract_embedded_sql(texts: DataFrame) -> DataFrame:
    """Table uses of SQL in string literals of code: path, use, name, line."""
    return _per_file(texts, "\\.(?:py|rs|ts|js|go)$", [("path", "string"), ("use", "string"), ("name", "string"), ("line", "long")], lambda p, c: [{"path": p, "use": u, "name": t, "line": n} for u, t, n in embedded_sql(c)])


def extract_manifests(texts: DataFrame) -> DataFrame:
    """Components that manifests declare: path, name, version, members, dependencies."""
    fields = [("path", "string"), ("name", "string"), ("version", "string"), ("members", "strings"), ("dependencies", "strings")]
    return _per_file(texts, "(?:^|/)(?:Cargo\\.toml|pyproject\\.toml|package\\.json|pnpm-workspace\\.yaml|go\\.mod)$", fields, lambda p, c: [{"path": p, **m}] if (m := manifest(p, c)) else [])


def search_structure(texts: DataFrame, pattern: str, names: DataFrame | None = None) -> DataFrame:
    """Places of Python files with a pattern's structure: path, line, end_line, bindings.

    ``names`` (column path) narrows the files that are parsed at all.
    """
    own = texts if names is None else texts.join(names.select("path").distinct(), "path", "left_semi")
    return _per_file(own, "\\.py$", [("path", "string"), ("line", "long"), ("end_line", "long"), ("bindings", "string")], lambda p, c: [{"path": p, "line": a, "end_line": b, "bindings": x} for a, b, x in matches(pattern, c)])
