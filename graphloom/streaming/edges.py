"""Edges kept up to date from a stream of occurrence files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import cut, exists, scratch
from graphloom.sources.workspace import current, point

EDGES = "src string, kind string, dst string, occurrence_count long, path string, line long, evidence string, confidence string"
OCCURRENCES = "owner_path string, ordinal long, src string, kind string, dst string, line long, evidence string, confidence string"


SHARDS = 64
KEY = ["src", "kind", "dst"]


def contributions(occurrences: DataFrame) -> DataFrame:
    """What each owner adds to each edge: owner_path, src, kind, dst, n, first (its first occurrence)."""
    rows = occurrences.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return rows.groupBy("owner_path", *KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("owner_path", "ordinal", "line", "evidence", "confidence")).alias("first"))


def summed(parts: DataFrame) -> DataFrame:
    """Edges from contributions, as :func:`graphloom.operators.graph.edge_table` makes them from occurrences."""
    e = parts.groupBy(*KEY).agg(F.sum("n").alias("occurrence_count"), F.min("first").alias("f"))
    return e.select(*KEY, "occurrence_count", F.col("f.owner_path").alias("path"), "f.line", "f.evidence", "f.confidence")


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, shards: int = SHARDS) -> None:
    """Takes a batch of whole owners into the tables below ``root``; a batch applied before changes nothing.

    The batch's owners replace their earlier occurrences. Occurrences lie in
    shards by owner, what owners contribute to edges and the edges themselves
    in shards by source. A batch reads and writes only the shards it touches; a
    pointer then names the latest folder of each. An owner's rows must come in
    one batch; repeats within it count once.
    """
    state = current(spark, root)
    if state and state["batch"] >= batch_id:
        return
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")

    def held(name: str, which: set[str], schema) -> DataFrame:
        found = [p for s, p in state.get(name, {}).items() if s in which]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    with scratch(spark):
        new = cut(batch.dropDuplicates(["owner_path", "ordinal"]))
        owners = new.select("owner_path").distinct()
        of = lambda df, c: {str(r["s"]) for r in df.select(shard(c).alias("s")).distinct().collect()}  # noqa: E731  at most the number of shards
        own = of(new, "owner_path")
        old = held("occurrences", own, new.schema)
        added = contributions(new)
        sources = of(new.select("src").unionByName(old.join(owners, "owner_path", "left_semi").select("src")).dropna(), "src")
        at = f"{root.rstrip('/')}/batch-{batch_id}-{uuid.uuid4().hex[:8]}"
        old.join(owners, "owner_path", "left_anti").unionByName(new).withColumn("shard", shard("owner_path")).write.partitionBy("shard").parquet(f"{at}/occurrences")
        parts = held("contributions", sources, added.schema).join(owners, "owner_path", "left_anti").unionByName(added)
        parts.withColumn("shard", shard("src")).write.partitionBy("shard").parquet(f"{at}/contributions")
        summed(spark.read.schema(added.schema).parquet(f"{at}/contributions")).withColumn("shard", shard("src")).write.partitionBy("shard").parquet(f"{at}/edges")
        moved = {name: state.get(name, {}) | {s: f"{at}/{name}/shard={s}" for s in which} for name, which in (("occurrences", own), ("contributions", sources), ("edges", sources))}
        # a shard that lost its last row has no folder
        point(spark, root, state, {"batch": batch_id, **{name: {s: p for s, p in m.items() if exists(spark, p)} for name, m in moved.items()}})


def maintained(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The maintained ``occurrences`` or ``edges`` as of the latest batch."""
    found = sorted(current(spark, root).get(table, {}).values())
    schema = OCCURRENCES if table == "occurrences" else EDGES
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def maintain(spark: SparkSession, source: str, root: str, checkpoint: str, schema: str = OCCURRENCES, files_per_batch: int = 1000):
    """A streaming query that applies every new file of a folder once and then stops; later calls go on from there.

    The files of an owner must arrive together, so that one batch takes them.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda b, i: apply_batch(b.sparkSession, root, b, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type, batch or streaming: start, event_type, n, total.

    In a stream, events later than ``late`` behind the newest are left out.
    Times without a zone are read as the session's.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
