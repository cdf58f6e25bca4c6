"""Per-key results when a few keys hold most rows (problem 5).

A sketch names the heavy keys: those with at least one row in a thousand, of
which there can't be more than a thousand. They go to every task by broadcast.
A heavy key's rows are spread by record over all tasks and pre-aggregated; the
other keys, none of which can burden a task, take the ordinary shuffle by key.
The union of both is the result. Every row is shuffled once with its key and
two hashes, and repeats of a record are dropped where it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

HEAVY = 1000  # a key is heavy from one in so many rows on
TRACKED = 8192
NULL, BETWEEN = "\u0002", "\u0001"


def heavy_keys(rows: DataFrame, keys: list[str], one_in: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Keys that a mergeable frequent-items sketch gives at least one in ``one_in`` rows: the key columns, at most ``one_in`` rows.

    The sketch keeps ``tracked`` counters per partition and merges them, so its
    cost does not depend on the number of keys. It sees repeats too. The list
    only steers how a key is processed; no count comes from it.
    """
    item = F.concat_ws(BETWEEN, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in keys])
    sketch = rows.select(item.alias("item")).agg(F.expr(f"approx_top_k(item, {one_in}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n"))
    found = sketch.select("n", F.explode("top").alias("t")).filter(F.col("t.count") * one_in >= F.col("n"))
    part = F.split("t.item", BETWEEN)
    value = lambda i, c: F.when(part[i] != NULL, part[i]).cast(rows.schema[c].dataType)
    return found.select(*[value(i, c).alias(c) for i, c in enumerate(keys)]).distinct().limit(one_in)


def key_results(rows: DataFrame, keys: list[str], record: list[str], distinct_of: str | None = None, one_in: int = HEAVY) -> DataFrame:
    """Count of records, and of distinct values of a column, per key: keys, n_rows, n_distinct (null without ``distinct_of``), heavy.

    ``record`` names the columns that identify a record; rows alike in these
    and in the key are repeats and count once; texts among them are compared by two
    64-bit hashes. Rows with a null key form a key of their own; null values are
    records but no distinct value. ``rows`` may have any further columns.
    """
    value = [distinct_of] if distinct_of else []
    text = [c for c in record if rows.schema[c].dataType.simpleString() == "string"]
    whole = [c for c in record if c not in text]
    # texts travel as 128 bits, which rows of the same owner share and compress; numbers as they are
    ids = [F.when(F.col(c).isNotNull(), F.xxhash64(*seed, c)).alias(f"__{c}_{i}") for c in text for i, seed in enumerate(([], [F.lit(1)]))]
    small = rows.select(*keys, *value, *ids, *[F.col(c).alias(f"__{c}") for c in whole])
    rec = [c for c in small.columns if c not in (*keys, *value)]
    top = cut(heavy_keys(rows, keys, one_in).withColumn("__code", F.monotonically_increasing_id()))
    codes = F.broadcast(top)  # at most one_in rows
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in keys]
    tagged = small.join(codes, same(small, codes), "left").select(*[small[c] for c in small.columns], "__code")
    n_distinct = F.count(distinct_of) if distinct_of else F.lit(None).cast("long")

    # heavy: spread by record, repeats dropped there, then one partial row per key (and value) of each task
    h = tagged.filter(F.col("__code").isNotNull()).groupBy("__code", *rec, *value).agg(F.lit(1).alias("__n"))
    if value:
        h = h.groupBy("__code", *value).agg(F.count(F.lit(1)).alias("__n"))
    h = h.groupBy("__code").agg(F.sum("__n").alias("n_rows"), n_distinct.alias("n_distinct"))
    h = h.join(codes, "__code").select(*keys, "n_rows", "n_distinct")

    # light: one shuffle by key, within which repeats, values and keys are grouped without another
    own = tagged.filter(F.col("__code").isNull()).repartition(*keys).groupBy(*keys, *rec, *value).agg(F.lit(1).alias("__n"))
    if value:
        own = own.groupBy(*keys, *value).agg(F.count(F.lit(1)).alias("__n"))
    light = own.groupBy(*keys).agg(F.sum("__n").alias("n_rows"), n_distinct.alias("n_distinct"))
    n = F.col("n_rows").cast("long").alias("n_rows")
    return h.select(*keys, n, "n_distinct", F.lit(True).alias("heavy")).unionByName(light.select(*keys, n, "n_distinct", F.lit(False).alias("heavy")))


def edge_key_results(occurrences: DataFrame, with_sources: bool = True) -> DataFrame:
    """Results per kind and dst of ``edge_occurrences``, repeats counted once: kind, dst, n_rows, n_distinct, heavy.

    ``with_sources`` adds the number of distinct ``src``; null ``dst`` is a key
    too. A record is an (owner_path, ordinal).
    """
    return key_results(occurrences, ["kind", "dst"], ["owner_path", "ordinal"], "src" if with_sources else None)


def dominant_keys(occurrences: DataFrame, one_in: int = 100) -> DataFrame:
    """Keys with a non-null dst that hold at least one in ``one_in`` of all distinct rows: kind, dst, n_rows, total."""
    per_key = cut(edge_key_results(occurrences, with_sources=False))
    total = per_key.agg(F.sum("n_rows").alias("total"))
    j = per_key.crossJoin(F.broadcast(total))  # one row
    return j.filter(F.col("dst").isNotNull() & (F.col("n_rows") * one_in >= F.col("total"))).select("kind", "dst", "n_rows", "total")
