"""Tokenising and shaping of names and texts with built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _folded() -> tuple[str, str]:
    """Lower-case letters with marks below U+2000, and what they are without: what Unicode takes apart into a letter and marks, and ø."""
    pairs = [("ø", "o")]
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and c == c.lower() and parts[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folded()

# Words that a document search drops from a query.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics, as an array; marks that stand alone separate words."""
    return F.regexp_extract_all(F.translate(F.lower(text), _ACCENTED, _PLAIN), F.lit("([\\p{L}\\p{N}]+)"), 1)


def name_parts(name: Column) -> Column:
    """Lower-case parts of a CamelCase or snake_case name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def slug(title: Column) -> Column:
    """Anchor of a heading: lower case, no punctuation, spaces as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^\\p{L}\\p{N}\\s_-]", ""), "\\s", "-")


def first_sentence(doc: Column) -> Column:
    """The first sentence of a text, or its first line if that is shorter."""
    return F.trim(F.regexp_extract(F.ltrim(doc), "^([^\\n]*?[.!?](?=\\s|$)|[^\\n]*)", 1))


def route(path: Column) -> Column:
    """Route in lower case without a trailing slash, its parameters written {param}."""
    low = F.regexp_replace(F.lower(F.regexp_replace(path, "[?#].*$", "")), "(?<=.)/+$", "")
    segment = lambda s: F.when(
        s.rlike("^(?:<[^>]*>|:[^/]+|\\{.*\\}|\\$\\{.*\\}|[0-9]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"), "{param}"
    ).otherwise(s)
    return F.array_join(F.transform(F.split(low, "/"), segment), "/")


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: * within a segment, ** across segments, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if not c.isalnum() and c not in "_/" else c)
            i += 1
    return f"^{out}$"


def extension(path: Column) -> Column:
    """Ending of a file name in lower case, '' without one."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), "\\.([^.]+)$", 1))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes as a signed number; null for null."""
    return _fnv1a(text)


@F.pandas_udf(LongType())
def _fnv1a(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        out.append(h - (1 << 64) if h >> 63 else h)
    return pd.Series(out, dtype="Int64")
