"""Spelling rules for paths and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """``/`` as separator, no leading ``./`` and no empty or ``.`` segments."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "/(?:\\.?/)+", "/")
    return F.regexp_replace(slashed, "^(?:\\./+)+", "")


def normal_digest(digest: Column) -> Column:
    """The 64 hexadecimal digits in lower case; what holds none stays as it is, trimmed and lower-cased."""
    low = F.lower(F.trim(digest))
    found = F.regexp_extract(low, "(?:^|[^0-9a-f])([0-9a-f]{64})$", 1)
    return F.when(found != "", found).otherwise(low)


def repo_of(path: Column) -> Column:
    """First segment of a path."""
    return F.substring_index(path, "/", 1)


def is_test_path(path: Column) -> Column:
    """Whether a path belongs to tests: a ``test``/``tests`` segment or a test-like base name."""
    base = F.substring_index(path, "/", -1)
    return (
        path.rlike("(?:^|/)tests?(?:/|$)")
        | base.startswith("test_")
        | base.endswith("_test.go")
        | base.contains(".test.")
        | base.contains(".spec.")
    )


def within(path: Column, prefix: str) -> Column:
    """Path equal to ``prefix`` or below it, as a byte range that Parquet statistics can prune; '' is everything."""
    if prefix == "":
        return F.lit(True)
    return (path == prefix) | ((path >= prefix + "/") & (path < prefix + "0"))
