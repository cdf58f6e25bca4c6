"""Pages of ordered results, and the guard in front of free SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

LIMIT, LEAST, MOST = 30, 1, 100
PROBE = 1001


class StaleGeneration(ValueError):
    """A later page was asked for of a generation that is no longer there."""


def page(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int = LIMIT, generation: str = "", pinned: str | None = None) -> dict:
    """One page with its envelope: total, offset, limit, has_more, next_offset, items, generation.

    ``order`` must be total for pages to be disjoint. From the second page on
    ``pinned`` names the generation seen before, by 8 characters at least.
    """
    if not LEAST <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be {LEAST} to {MOST}, and offset not negative")
    if offset and (not pinned or len(pinned) < min(8, len(generation)) or not generation.startswith(pinned)):
        raise StaleGeneration(generation)
    rows = df.orderBy(*order).offset(offset).limit(limit + 1).collect()  # one more than asked, at most 101
    more = len(rows) > limit
    items = [r.asDict(recursive=True) for r in rows[:limit]]
    return {"total": df.count(), "offset": offset, "limit": limit, "has_more": more, "next_offset": offset + limit if more else None, "items": items, "generation": generation}


def bounded_total(df: DataFrame, probe: int = PROBE) -> int | None:
    """The number of rows if below ``probe``, else None, without counting on."""
    n = df.limit(probe).count()
    return None if n >= probe else n


def trimmed(envelope: dict, budget: int = 96 * 1024) -> dict:
    """The envelope with items dropped from its end until their text fits the budget in bytes."""
    size, kept = 0, []
    for item in envelope["items"]:
        size += len(repr(item).encode())
        if size > budget:
            break
        kept.append(item)
    cut = len(kept) < len(envelope["items"])
    return envelope | {"items": kept, "has_more": envelope["has_more"] or cut, "next_offset": envelope["offset"] + len(kept) if cut else envelope["next_offset"]}


_TRIVIA = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)


def read_only(spark: SparkSession, statement: str) -> None:
    """Raises ValueError unless the text is one query: SELECT or WITH, no command, no second statement, no file path as table."""
    head = statement[_TRIVIA.match(statement).end() :]
    if not re.match(r"(?:select|with)\b", head, re.I):
        raise ValueError("only SELECT and WITH are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    text = plan.toString()
    if plan.getClass().getSimpleName() in ("InsertIntoStatement", "CreateTableAsSelect") or "InsertInto" in text:
        raise ValueError("only SELECT and WITH are allowed")
    if re.search(r"UnresolvedRelation \[(?:parquet|csv|json|text|orc|binaryFile|avro|jdbc|delta), ", text, re.I):
        raise ValueError("tables only, no files")


def query(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of a guarded query over the named tables."""
    read_only(spark, statement)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)
