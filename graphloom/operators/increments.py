"""Processing only new or changed records (problem 2).

A record gets a sequence number within its stream when it is first seen, and
keeps it. What has been processed is a set of disjoint intervals of numbers per
stream; subtracting them from the available ranges leaves the gaps, which
include records that were committed late, below numbers already processed.
Intervals are kept in blocks of fixed length, so a stream of any size is worked
on in many small groups.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import normal_digest, normal_path, repo_of
from graphloom.operators.snapshots import _small, holding_rows
from graphloom.session import Folder, delete, fresh

BLOCK = 1 << 16
STREAMS = 4096


def intervals(numbers: DataFrame, stream: str = "stream", seq: str = "seq") -> DataFrame:
    """Disjoint intervals that cover the numbers: stream, block, lo, hi (both inclusive).

    Repeated numbers count once, null ones not at all. An interval ends at its
    block's end even if the next block goes on.
    """
    n = numbers.select(F.col(stream).alias("stream"), F.col(seq).cast("long").alias("seq")).dropna().distinct()
    n = n.withColumn("block", F.floor(F.col("seq") / BLOCK))
    w = Window.partitionBy("stream", "block").orderBy("seq")
    island = n.withColumn("island", F.col("seq") - F.row_number().over(w))
    return island.groupBy("stream", "block", "island").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).drop("island")


def merged(pieces: DataFrame) -> DataFrame:
    """Union of intervals (stream, lo, hi) that may overlap or touch, as disjoint intervals cut at block ends."""
    cut_up = pieces.filter(F.col("lo") <= F.col("hi")).select(
        "stream", F.col("lo").alias("l"), F.col("hi").alias("h"), F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))).alias("block")
    )
    cut_up = cut_up.select("stream", "block", F.greatest("l", F.col("block") * BLOCK).alias("lo"), F.least("h", F.col("block") * BLOCK + BLOCK - 1).alias("hi"))
    w = Window.partitionBy("stream", "block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = cut_up.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    numbered = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("stream", "block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def gaps(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Available minus processed intervals, both as :func:`merged` gives them: stream, block, lo, hi.

    Between two processed intervals, before the first and after the last lies
    what is still open; it is cut to what is available. Processed numbers that
    are no longer available change nothing.
    """
    done = processed.groupBy("stream", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("done"))
    both = available.join(done, ["stream", "block"], "left")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    ends = F.coalesce(F.col("done"), none)
    left = F.concat(F.array(F.col("lo")), F.transform(ends, lambda x: x["hi"] + 1))
    right = F.concat(F.transform(ends, lambda x: x["lo"] - 1), F.array(F.col("hi")))
    opened = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    clipped = both.select("stream", "block", "lo", "hi", F.explode(opened).alias("g"))
    clipped = clipped.select("stream", "block", F.greatest("lo", "g.a").alias("lo"), F.least("hi", "g.b").alias("hi"))
    return clipped.filter(F.col("lo") <= F.col("hi"))


def in_intervals(records: DataFrame, wanted: DataFrame, stream: str = "stream", seq: str = "seq") -> DataFrame:
    """Records whose number lies in one of the intervals; all their columns, each record once."""
    numbers = wanted.select(F.col("stream").alias(stream), F.explode(F.sequence("lo", "hi")).alias(seq))
    return records.join(numbers, [stream, seq], "left_semi")


def newest_listing(inventory: DataFrame) -> DataFrame:
    """Holding rows of each repository's newest snapshot: repo, path, snapshot_no, digest, size; older snapshots are left out before the shuffle."""
    rows = delivered(inventory).withColumn("repo", repo_of(F.col("path")))
    last = _small(rows.groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no")))
    return holding_rows(rows.join(last, ["repo", "snapshot_no"]).drop("repo"))


def recorded_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """What the log records for each path under succeeded runs, its latest write: path, digest, status.

    A run succeeded if any of its rows says so. Rows without a path or run are
    left out; null write times are the earliest; of equal times the greater
    (digest, status) holds.
    """
    good = runs.filter(F.col("outcome") == "succeeded").select("run_id").distinct()
    kept = files.filter(F.col("path").isNotNull()).join(good, "run_id", "left_semi")
    row = F.struct(F.col("indexed_at").alias("at"), normal_digest(F.col("digest")).alias("digest"), F.col("status").alias("status"))
    return kept.groupBy(normal_path(F.col("path")).alias("path")).agg(F.max(row).alias("r")).select("path", "r.digest", "r.status")


class Ledger:
    """Exactly-once runs over numbered records, with output and progress committed together.

    ``root`` is a folder that driver and executors share; ``key`` names the
    columns that tell records apart. Every commit writes its tables under an
    attempt folder of its own and then publishes one small manifest that names
    it. A run that dies before that leaves nothing visible, and the next run
    finds the same gaps again. Manifests are numbered; publishing fails if
    another run took the number, so no record is taken twice.

    A commit adds only what is new: records with their numbers, the intervals
    processed, the output. Every ``compact_every`` runs the intervals are
    merged into one table, from which later reads start.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], streams: int = STREAMS, compact_every: int = 16):
        self.spark, self.root, self.key, self.streams, self.compact_every = spark, root.rstrip("/"), list(key), streams, compact_every
        self.manifests = Folder(spark, f"{self.root}/manifests")

    # -- state

    def commits(self) -> list[dict]:
        """The published manifests in order: no, attempt, parts (the tables it added)."""
        return [json.loads(self.manifests.read(n)) for n in self.manifests.names() if n.endswith(".json")]

    def _parts(self, part: str, schema: str) -> DataFrame:
        found = [f"{c['attempt']}/{part}" for c in self.commits() if part in c["parts"]]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def processed(self) -> DataFrame:
        """Disjoint processed intervals: stream, block, lo, hi."""
        log = self.commits()
        base = max((i for i, c in enumerate(log) if "merged" in c["parts"]), default=0)
        found = [f"{c['attempt']}/{'merged' if 'merged' in c['parts'] else 'intervals'}" for c in log[base:] if {"merged", "intervals"} & {*c["parts"]}]
        schema = "stream long, block long, lo long, hi long"
        if not found:
            return self.spark.createDataFrame([], schema)
        return merged(self.spark.read.schema(schema).parquet(*found).select("stream", "lo", "hi"))

    def numbered(self, like: DataFrame) -> DataFrame:
        """All registered records, with the types of ``like``: key columns, stream, seq."""
        return self._parts("records", ", ".join(f"`{c}` {like.schema[c].dataType.simpleString()}" for c in self.key) + ", stream long, seq long")

    def output(self) -> DataFrame | None:
        """All committed output, or None before the first."""
        found = [f"{c['attempt']}/output" for c in self.commits() if "output" in c["parts"]]
        return self.spark.read.parquet(*found) if found else None

    # -- commits

    def _commit(self, attempt: str, parts: list[str]) -> int:
        log = self.commits()
        no = self._expected
        if log and log[-1]["no"] >= no:
            raise FileExistsError(str(no))
        self.manifests.publish(f"{no:012d}.json", json.dumps({"no": no, "attempt": attempt, "parts": parts}))
        return no

    def _attempt(self) -> str:
        log = self.commits()
        self._expected = (log[-1]["no"] if log else 0) + 1
        return f"{self.root}/attempt-{int(time.time())}-{uuid.uuid4().hex}"

    def register(self, records: DataFrame, order: list[str]) -> int:
        """Number the records that have no number yet; returns the manifest number, or the last one if there were none.

        Records are told apart by the key, in which null equals null; repeats
        count once. New records of a stream (a hash shard of the key, so that
        no key's value is a stream of its own) follow its highest number in
        the given order, then by the key. Records once numbered keep their
        numbers, also when they are delivered again or late.
        """
        attempt = self._attempt()
        once = records.groupBy(*self.key).agg(*[F.min(c).alias(f"__{i}") for i, c in enumerate(order)])
        old = self.numbered(records)
        if self.commits():
            a, b = once.alias("a"), old.alias("b")
            same = None
            for c in self.key:
                e = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
                same = e if same is None else same & e
            once = a.join(b, same, "left_anti")
        # one shuffle by the key's hash serves the numbering; the highest numbers are a row per stream
        shard = F.pmod(F.xxhash64(*self.key), F.lit(self.streams))
        w = Window.partitionBy("stream").orderBy(*[f"__{i}" for i in range(len(order))], *self.key)
        local = once.withColumn("stream", shard).withColumn("local", F.row_number().over(w).cast("long"))
        last = old.groupBy("stream").agg(F.max("seq").alias("last"))
        new = local.join(F.broadcast(last), "stream", "left")  # at most a row per stream
        new.select(*self.key, "stream", (F.coalesce("last", F.lit(-1)) + F.col("local")).alias("seq")).write.parquet(attempt + "/records")
        return self._commit(attempt, ["records"])

    def numbers_of(self, records: DataFrame) -> DataFrame:
        """The numbers of registered records among ``records``: stream, seq; those never registered have none."""
        a, b = self.numbered(records).alias("a"), records.select(*self.key).alias("b")
        same = None
        for c in self.key:
            e = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            same = e if same is None else same & e
        return a.join(b, same, "left_semi").select("stream", "seq")

    def adopt(self, records: DataFrame) -> int:
        """Commit that exactly these registered records have been processed, as another log says; its word replaces all earlier intervals."""
        attempt = self._attempt()
        intervals(self.numbers_of(records)).write.parquet(attempt + "/merged")
        return self._commit(attempt, ["merged"])

    def open(self, records: DataFrame) -> DataFrame:
        """The gaps among registered records: what is available of ``records`` minus what is processed, as intervals."""
        return gaps(intervals(self.numbers_of(records)), self.processed())

    def taken(self, records: DataFrame, wanted: DataFrame) -> DataFrame:
        """The key columns, stream and seq of the registered records whose numbers lie in the wanted intervals."""
        return in_intervals(self.numbered(records), wanted.select("stream", "lo", "hi"))

    def run(self, records: DataFrame, process, fail_before_commit: bool = False) -> int:
        """Process the registered records among ``records`` that are not processed yet, and commit; returns the manifest number.

        ``process`` maps their rows (key, stream, seq) to the output.
        ``fail_before_commit`` serves tests of recovery.
        """
        attempt = self._attempt()
        todo = self.open(records)
        todo.write.parquet(attempt + "/intervals")
        todo = self.spark.read.schema(todo.schema).parquet(attempt + "/intervals")
        process(self.taken(records, todo)).write.parquet(attempt + "/output")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        parts = ["intervals", "output"]
        log = self.commits()
        base = max((i for i, c in enumerate(log) if "merged" in c["parts"]), default=-1)
        if sum("intervals" in c["parts"] for c in log[base + 1 :]) + 1 >= self.compact_every:
            merged(self.processed().select("stream", "lo", "hi").unionByName(todo.select("stream", "lo", "hi"))).write.parquet(attempt + "/merged")
            parts.append("merged")
        return self._commit(attempt, parts)

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Delete attempts that no manifest names and that began more than so many seconds ago; returns their number."""
        named = {c["attempt"].rpartition("/")[2] for c in self.commits()}
        folder = Folder(self.spark, self.root)
        gone = [n for n in folder.names() if n.startswith("attempt-") and n not in named and int(n.split("-")[1]) <= time.time() - older_than]
        for n in gone:
            delete(self.spark.sparkContext, f"{self.root}/{n}")
        return len(gone)


def delivered(inventory: DataFrame) -> DataFrame:
    """The inventory's rows as records to be numbered: path, snapshot_no, digest (normal spellings), size, delivered_at.

    Rows without a path or snapshot number are left out.
    """
    rows = inventory.select(normal_path(F.col("path")).alias("path"), F.col("snapshot_no").cast("long").alias("snapshot_no"), normal_digest(F.col("digest")).alias("digest"), F.col("size").cast("long").alias("size"), "delivered_at")
    return rows.filter(F.col("path").isNotNull() & F.col("snapshot_no").isNotNull())


VERSION = ["path", "digest"]


def pending_files(inventory: DataFrame, files: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """Files that the next index run must take: repo, snapshot_no, path, digest, size, stream, seq.

    A record is a version of a file, its path and digest, and is numbered when
    the inventory first delivers it. Versions that the log's latest write under
    a succeeded run records as indexed or skipped are adopted as processed
    intervals; the newest listing's versions are what is available. The gaps
    between the two are the result: neither side knows of the other but through
    the numbers. With ``root``, a ledger kept from run to run, only new versions
    are numbered. Empty tables give none or, with no log, all records.
    """
    spark = inventory.sparkSession
    listed = newest_listing(inventory).filter(F.col("digest").isNotNull())
    ledger = Ledger(spark, root or fresh(spark), VERSION)
    ledger.register(delivered(inventory).filter(F.col("digest").isNotNull()), ["delivered_at", "snapshot_no"])
    ledger.adopt(recorded_state(files, runs).filter(F.col("status").isin("indexed", "skipped")))
    todo = ledger.taken(listed, ledger.open(listed))
    return todo.join(listed, VERSION).select("repo", "snapshot_no", "path", "digest", "size", "stream", "seq")


def replayed(inventory: DataFrame, until: list, root: str | None = None) -> DataFrame:
    """Each version of a file with the run that took it, over runs at several times: run, path, digest, stream, seq.

    Run ``i`` sees what had been delivered before ``until[i]`` (a null time is
    before all), the last run everything. Each run is first stopped before its
    commit and then repeated, as after a failure. Versions delivered late, with
    snapshots that earlier runs have seen, fill gaps. Every version comes out
    exactly once.
    """
    spark = inventory.sparkSession
    rows = delivered(inventory).filter(F.col("digest").isNotNull())
    ledger = Ledger(spark, root or fresh(spark), VERSION)
    for i, end in enumerate([*until, None], 1):
        seen = rows if end is None else rows.filter(F.col("delivered_at").isNull() | (F.col("delivered_at") < F.lit(end)))
        ledger.register(seen, ["delivered_at", "snapshot_no"])
        for failing in (True, False):
            try:
                ledger.run(seen, lambda df, i=i: df.select(F.lit(i).alias("run"), *VERSION, "stream", "seq"), fail_before_commit=failing)
            except RuntimeError:
                pass
    return ledger.output()
