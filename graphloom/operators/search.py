"""Full-text search over symbols and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import within
from graphloom.functions.text import STOP_WORDS, words
from graphloom.session import cut

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def posting_hits(texts: DataFrame, key: str, columns: dict[str, float], terms: list[str]) -> DataFrame:
    """One row per text that has terms: key, length (all its terms), hits (term and weight of each wanted one); a written table.

    ``columns`` gives the text columns and their weights. What is not asked for
    is dropped within the row, before anything is exploded or shuffled.
    """
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    found = [words(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    rows = texts.select(F.col(key).alias("key"), *[x.alias(f"__{i}") for i, x in enumerate(found)])
    weighted = lambda w: lambda x: F.struct(x.alias("term"), F.lit(float(w)).alias("w"))
    held = [F.transform(F.filter(F.col(f"__{i}"), lambda x: F.array_contains(wanted, x)), weighted(w)) for i, w in enumerate(columns.values())]
    length = sum((F.size(f"__{i}") for i in range(1, len(held))), F.size("__0"))
    return cut(rows.select("key", length.alias("length"), F.concat(*held).alias("hits")).filter("length > 0"))


def bm25(texts: DataFrame, key: str, columns: dict[str, float], terms: list[str]) -> DataFrame:
    """Okapi BM25 of the texts that have any of the terms: key, score, matched (terms found).

    A term counts in each column times the column's weight; the length is the
    plain number of terms. The inverse document frequency is
    ln((N - n + 0.5) / (n + 0.5)), never below a small positive value, over all
    texts that have terms.
    """
    rows = posting_hits(texts, key, columns, sorted({t.lower() for t in terms}))
    stats = rows.agg(F.count(F.lit(1)).alias("n_all"), F.avg("length").alias("mean"))
    tf = rows.filter(F.size("hits") > 0).select("key", "length", F.explode("hits").alias("x")).groupBy("key", "length", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row per query term; one row
    idf = F.greatest(F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("key").agg(F.sum(idf * weight).alias("score"), F.count(F.lit(1)).alias("matched"))


def query_terms(query: str, drop: tuple[str, ...] = ()) -> list[str]:
    """Terms of a query: runs of letters and digits in lower case, without the words to drop."""
    return [t for t in ("".join(x).lower() for x in _runs(query)) if t not in drop]


def _runs(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for c in text:
        if c.isalnum():
            out[-1].append(c)
        elif out[-1]:
            out.append([])
    return [x for x in out if x]


def component_path(paths: DataFrame, component: str, aliases: dict[str, str] | None = None, owners: dict[str, str] | None = None) -> str:
    """The path that a component's name stands for.

    A path of ``paths`` (column ``path``) or one above such is taken as it is;
    then ``aliases`` (name to owner) and ``owners`` (path to owner) are asked;
    then the first path that has the name as a folder; else the name stays.
    """
    name = component.strip().rstrip("/")
    if not name or paths.filter(within(F.col("path"), name)).limit(1).count():
        return name
    owner = (aliases or {}).get(name, name).lower()
    for path, own in (owners or {}).items():
        if own.lower() in (owner, name.lower()):
            return path.rstrip("/")
    for path in owners or {}:
        if path.lower() == name.lower() or path.endswith("/" + name):
            return path.rstrip("/")
    first = paths.filter(F.col("path").contains(f"/{name}/")).agg(F.min("path").alias("p")).first()["p"]
    return first.partition(f"/{name}/")[0] + "/" + name if first else name


def in_archive(path: Column) -> Column:
    """Whether a path lies in an archive folder, whatever the letters' case."""
    p = F.lower(path)
    return p.startswith("archive/") | p.contains("/archive/")


def search_documents(documents: DataFrame, query: str, key: str = "doc_id", title: str = "title", body: str = "body", top: int | None = None, doc_type: str = "", component: str = "") -> DataFrame:
    """Documents by a query: key, score, matched, all_terms; those with all terms first, then by score and key.

    Titles count three times, stop words not at all; a query of stop words
    finds nothing. Statistics are over all documents. ``doc_type`` keeps those
    of a type (column ``doc_type``), ``component`` those at or below a path
    (column ``path``); documents in archives (as far as ``path`` is given) are
    left out unless the component is one itself.
    """
    terms = query_terms(query, STOP_WORDS)
    found = bm25(documents, key, {title: 3.0, body: 1.0}, terms)
    keep = None
    if doc_type:
        keep = F.col("doc_type") == doc_type
    if "path" in documents.columns:
        inside = within(F.col("path"), component)
        if not (component == "archive" or component.startswith("archive/") or component.endswith("/archive") or "/archive/" in component):
            inside = inside & ~in_archive(F.col("path"))
        keep = inside if keep is None else keep & inside
    if keep is not None:
        found = found.join(documents.filter(keep).select(F.col(key).alias("key")), "key", "left_semi")
    out = found.withColumn("all_terms", F.col("matched") == len(set(terms)))
    return out if top is None else out.orderBy(F.desc("all_terms"), F.desc("score"), "key").limit(top)


def titled(documents: DataFrame, *keep: str) -> DataFrame:
    """Documents with the first heading of their text as title and the text as body, and further columns."""
    return documents.select("doc_id", *keep, F.regexp_extract(F.coalesce("text", F.lit("")), "(?m)^#+[ \\t]+(.*)$", 1).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def snippet(text: Column, term: str, width: int = 240) -> Column:
    """A part of the text of at most ``width`` characters around the first place of a term."""
    at = F.greatest(F.instr(F.lower(text), term.lower()) - width // 4, F.lit(1))
    return F.substring(F.regexp_replace(F.substring(text, at, F.lit(width)), "\\s+", " "), 1, width)


def _like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def symbols_in(nodes: DataFrame, kind: str = "", path: str = "", include_docs: bool = False) -> DataFrame:
    """Symbols of a kind (functions and methods count as each other) at or below a path; Markdown only if asked for."""
    keep = within(F.col("path"), path)
    if kind:
        keep = keep & F.col("kind").isin(*({"function", "method"} if kind in ("function", "method") else {kind}))
    if not include_docs:
        keep = keep & (F.col("language") != "markdown")
    return nodes.filter(keep)


def exact_symbols(nodes: DataFrame, name: str) -> DataFrame:
    """Symbols whose name (rank 0) or qualified name (rank 2) is the given one, letters' case aside: id, rank."""
    low = name.lower()
    r = F.when(F.lower("name") == low, 0).when(F.lower("qualname") == low, 2)
    return nodes.select("id", r.alias("rank")).filter(F.col("rank").isNotNull())


def wildcard_symbols(nodes: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose name (rank 0) or qualified name (rank 1) matches a pattern with *, letters' case aside: id, rank."""
    like = _like(pattern)
    r = F.when(F.col("name").ilike(like), 0).when(F.col("qualname").ilike(like), 1)
    return nodes.select("id", r.alias("rank")).filter(F.col("rank").isNotNull())


def prefix_symbols(nodes: DataFrame, prefix: str) -> DataFrame:
    """Symbols by the beginning of a name: id, score, reason (name_pattern or qualified_pattern).

    A term of the symbol's text must begin so, and the name (500 more), the
    qualified name or a part of it behind ``::`` or ``.`` too.
    """
    like = _like(prefix) + "%"
    named = F.col("name").ilike(like)
    qualified = F.col("qualname").ilike(like) | F.col("qualname").ilike("%::" + like) | F.col("qualname").ilike("%." + like)
    rows = nodes.filter(F.coalesce(named | qualified, F.lit(False))).withColumn("text", search_text())
    low = F.lit(prefix.lower())
    begun = F.size(F.filter(words("text"), lambda x: x.startswith(low))) > 0
    return rows.filter(begun).select("id", F.when(F.coalesce(named, F.lit(False)), 500.0).otherwise(0.0).alias("score"), F.when(F.coalesce(named, F.lit(False)), "name_pattern").otherwise("qualified_pattern").alias("reason"))


WITH_TYPES = ("function", "method", "constructor")
TAKES, RETURNS = "takestype", "returnstype"  # in front of a type's terms in the indexed text


def _terms_of(text: Column, before: str) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}]+)"), 1), lambda x: F.concat(F.lit(before), x)), " ")


def search_text() -> Column:
    """The text by which a symbol is found: name, qualified name, path, doc, parameters and types, decorators, and a module's references.

    Terms of parameter and return types stand there with a mark before them
    too, so that a type is told from a name. Broken or missing details add
    nothing.
    """
    d = lambda x: F.get_json_object("details", f"$.{x}")
    params = F.from_json(d("param_types"), "map<string,string>")
    typed = F.array_join(F.transform(F.filter(F.map_entries(params), lambda e: e["value"].isNotNull()), lambda e: F.concat_ws(" ", F.concat_ws(":", e["key"], e["value"]), _terms_of(e["value"], TAKES))), " ")
    returned = F.coalesce(declared_type(), d("return_type"))
    callable_ = F.col("kind").isin(*WITH_TYPES)
    listed = lambda x: F.array_join(F.from_json(d(x), "array<string>"), " ")
    return F.concat_ws(
        " ", "name", "qualname", "path", d("doc"), F.when(callable_, typed), F.when(callable_ & returned.isNotNull(), F.concat(F.lit("returns:"), returned, F.lit(" "), _terms_of(returned, RETURNS))), listed("decorators"), F.when(F.col("kind") == "module", listed("references"))
    )


BOOST, EXACT, PREFIX, ALL_TERMS = 50, 1000.0, 500.0, 250.0


def search_symbols(nodes: DataFrame, keys: DataFrame, pattern: str, kind: str = "", path: str = "", include_docs: bool = False, window: int = 50) -> DataFrame:
    """Symbols by a pattern: id, score, boost, in_window, reason; in the order of :data:`SYMBOL_ORDER` (with the nodes' path and line).

    Symbols named exactly so, letters' case aside, are the answer if there are
    any, unless the pattern's terms are also the types that some symbol takes
    or returns. Else text relevance adds to a base: 1000 for the exact name or
    qualified name, 500 for a name that starts so. A pattern with spaces asks
    for any of its terms and gives 250 more for all; another asks for all, or
    for any if that finds nothing. The first ``window`` come first and gain 50
    if anything but containment and documentation refers to them (``keys``:
    src, kind, dst). Statistics are over all nodes.
    """
    own, low = symbols_in(nodes, kind, path, include_docs), pattern.lower()
    terms = query_terms(pattern)
    eq = lambda c: F.coalesce(F.lower(c) == low, F.lit(False))
    prefix, fragment = F.coalesce(F.lower("name").startswith(low), F.lit(False)), F.coalesce(F.lower("name").contains(low), F.lit(False))
    reason = F.when(eq("name"), "exact_name").when(eq("qualname"), "exact_qualified_name").when(prefix, "name_prefix").when(fragment, "name_fragment").otherwise("indexed_text").alias("reason")
    place = ["path", "line", "id"]
    exact = own.filter(eq("name") | eq("qualname"))
    if exact.limit(1).count() and not (terms and _typed(own, terms).limit(1).count()):
        found = exact.select(*place, F.when(eq("name"), 0.0).otherwise(-2.0).alias("score"), reason)
        return _boosted(found, keys, window, place)
    if not terms:
        raise ValueError("a pattern must have a letter or digit")
    scored = bm25(nodes.withColumn("text", search_text()), "id", {"text": 1.0}, terms).withColumnRenamed("key", "id")
    base = F.when(eq("name") | eq("qualname"), EXACT).when(prefix, PREFIX).otherwise(0.0)
    all_terms = F.coalesce(F.col("matched") == len(set(terms)), F.lit(False))
    both = own.join(scored, "id", "left").filter(F.col("matched").isNotNull() | prefix | eq("qualname"))
    natural = not pattern.startswith("@") and any(c.isspace() for c in pattern)
    bonus = F.when(all_terms, ALL_TERMS).otherwise(0.0) if natural and len(terms) > 1 else F.lit(0.0)
    relevance = F.coalesce("score", F.lit(0.0))
    if not natural:
        strict = both.filter(all_terms | prefix | eq("qualname"))
        if strict.limit(1).count() or len(terms) == 1 or pattern.startswith("@"):
            both, relevance = strict, F.when(all_terms, relevance).otherwise(0.0)
    return _boosted(both.select(*place, F.round(base + bonus + relevance, 6).alias("score"), reason), keys, window, place)


def _typed(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Symbols that take, or that return, types with all the terms."""
    found = words(search_text())
    marked = [F.size(F.array_except(F.array(*[F.lit(mark + t) for t in terms]), found)) == 0 for mark in (TAKES, RETURNS)]
    return nodes.filter(F.col("kind").isin(*WITH_TYPES)).filter(marked[0] | marked[1])


SYMBOL_ORDER = ["in_window DESC", "score + boost DESC", "path", "line", "id"]


def _boosted(found: DataFrame, keys: DataFrame, window: int, place: list[str]) -> DataFrame:
    found = cut(found)
    best = found.orderBy(F.desc("score"), *place).limit(window).select("id")
    used = keys.filter(~F.col("kind").isin("contains", "documents", "references_doc")).join(F.broadcast(best.withColumnRenamed("id", "dst")), "dst", "left_semi").select(F.col("dst").alias("id")).distinct()  # at most the window
    best = best.withColumn("in_window", F.lit(True)).join(used.withColumn("boost", F.lit(BOOST)), "id", "left")
    return found.join(F.broadcast(best), "id", "left").select("id", "score", F.coalesce("boost", F.lit(0)).alias("boost"), F.coalesce("in_window", F.lit(False)).alias("in_window"), "reason")


def suggestions(nodes: DataFrame, name: str, top: int = 5) -> DataFrame:
    """The names nearest to a misspelt one: name, distance; by (distance, name)."""
    return nodes.select("name").distinct().select("name", F.levenshtein(F.lower("name"), F.lit(name.lower())).alias("distance")).filter(F.col("distance").isNotNull()).orderBy("distance", "name").limit(top)


def declared_type() -> Column:
    """The return type that a node's signature declares: what follows -> (or : in TypeScript and JavaScript) behind the balanced parameters; null without one."""
    sig = F.get_json_object("details", "$.signature")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when((c == ")") & (s["depth"] > 0), -1).otherwise(0)
        closes = (s["end"] == 0) & (c == ")") & (s["depth"] == 1)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(closes, s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(sig, ""), start, step, lambda s: s["end"])
    tail = F.when(end > 0, F.ltrim(F.substring(sig, end + 1, F.length(sig))))
    colon = F.col("language").isin("typescript", "javascript")
    got = F.when(tail.startswith("->"), F.substring(tail, F.lit(3), F.length(tail))).when(colon & tail.startswith(":"), F.substring(tail, F.lit(2), F.length(tail)))
    trimmed = F.trim(F.regexp_replace(F.trim(F.substring_index(got, " where ", 1)), ":+$", ""))
    return F.when(trimmed != "", trimmed)


def declared_types(nodes: DataFrame) -> DataFrame:
    """Return types declared in signatures: id, return_type."""
    return nodes.select("id", declared_type().alias("return_type")).filter(F.col("return_type").isNotNull())


def taking_or_returning(nodes: DataFrame, returns: str | None = None, takes: str | None = None) -> DataFrame:
    """Symbols by a part of the types they declare, letters' case aside, * for any run: id.

    Return types stand in ``details.return_type``, parameter types in the
    values of ``details.param_types``; broken or missing details match nothing.
    """
    like = lambda t: "%" + _like(t) + "%"
    keep = F.lit(True)
    if returns is not None:
        keep = keep & F.coalesce(F.get_json_object("details", "$.return_type").ilike(like(returns)), F.lit(False))
    if takes is not None:
        types = F.map_values(F.from_json(F.get_json_object("details", "$.param_types"), "map<string,string>"))
        keep = keep & F.coalesce(F.exists(types, lambda x: x.ilike(like(takes))), F.lit(False))
    return nodes.filter(keep).select("id")
