"""What changed between full snapshots (problem 1).

Snapshots are kept in a store whose files are range-partitioned by path and
sorted by (path, snapshot): each delivery adds one sorted file per range, and
the changes are a merge of the sorted files of each range, which needs no
shuffle of what is stored.
"""

from __future__ import annotations

import json
import uuid
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import normal_digest, normal_path, repo_of
from graphloom.session import Folder, cut, fresh

COLUMNS = ["snapshot_no", "delivered_at", "path", "digest", "size"]


def holding_rows(inventory: DataFrame) -> DataFrame:
    """One row per snapshot and path, that of the latest delivery: repo, path, snapshot_no, digest, size.

    Rows without a path or snapshot number are left out. A null delivery time
    is the earliest; of equal times the greater (digest, size) holds.
    Further columns of the input are ignored.
    """
    held = _delivered(inventory).groupBy("path", "snapshot_no").agg(F.max("row").alias("row"))
    return held.select(repo_of(F.col("path")).alias("repo"), "path", "snapshot_no", "row.digest", "row.size")


def _delivered(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        F.col("snapshot_no").cast("long").alias("snapshot_no"),
        normal_path(F.col("path")).alias("path"),
        F.struct(F.col("delivered_at").cast("timestamp_ntz").alias("at"), normal_digest(F.col("digest")).alias("digest"), F.col("size").cast("long").alias("size")).alias("row"),
    ).filter(F.col("path").isNotNull() & F.col("snapshot_no").isNotNull())


def snapshot_list(inventory: DataFrame) -> DataFrame:
    """The snapshots of each repository with their neighbours: repo, snapshot_no, prev_no, next_no.

    The list has a row per delivery, not per file, so its windows stay small.
    """
    return _neighbours(inventory.select(repo_of(normal_path(F.col("path"))).alias("repo"), F.col("snapshot_no").cast("long").alias("snapshot_no")).dropna().distinct())


def _neighbours(named: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo").orderBy("snapshot_no")
    return named.select("repo", "snapshot_no", F.lag("snapshot_no").over(w).alias("prev_no"), F.lead("snapshot_no").over(w).alias("next_no"))


BROADCAST_ROWS = 200_000  # snapshots that a list may have to be sent to every task
PER_RANGE = 100  # paths sampled for each range bound
ROW = "struct<at:timestamp_ntz,digest:string,size:bigint>"


def _labels(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` buckets a number that Spark's bucketing puts there, so that every range has a bucket of its own."""
    i = F.col("id").cast("int")
    got = spark.range(64 * n).groupBy(F.pmod(F.hash(i), F.lit(n)).alias("b")).agg(F.min(i).alias("label")).orderBy("b").collect()
    return [r["label"] for r in got]


class SnapshotStore:
    """Snapshots kept range-partitioned and sorted by key, to which deliveries are added.

    ``root`` is a folder that driver and executors share. The bounds of the
    ranges come from a bounded sample of the first delivery's paths
    (``PER_RANGE`` for each range) and stay. A delivery is shuffled once, into
    its ranges, and written as one sorted bucket file per range, in a part of
    the table that a manifest then names; a delivery that fails leaves nothing
    visible.
    """

    def __init__(self, spark: SparkSession, root: str, ranges: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Folder(spark, f"{self.root}/manifests")
        self.n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"graphloom_{uuid.uuid4().hex}"
        self.bounds: list[str] = []
        self.labels: list[int] = []
        if first := self.manifests.read("layout.json"):
            layout = json.loads(first)
            self.bounds, self.labels, self.n = layout["bounds"], layout["labels"], layout["ranges"]
            self._declare()

    def _declare(self) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.name} (path STRING, snapshot_no BIGINT, row {ROW}, `range` INT, part INT) USING parquet"
            f" PARTITIONED BY (part) CLUSTERED BY (`range`) SORTED BY (path, snapshot_no) INTO {self.n} BUCKETS LOCATION '{self.root}/rows'"
        )
        if self.parts():
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _range(self, path: Column) -> Column:
        """Label of the range of a path, by two searches of about sqrt(n) comparisons each."""
        if not self.bounds:
            return F.lit(self.labels[0])
        step = max(1, isqrt(len(self.bounds)))
        blocks = [self.bounds[i : i + step] for i in range(0, len(self.bounds), step)]
        text = lambda xs: F.array(*[F.lit(x) for x in xs])
        below = lambda xs: F.size(F.filter(xs, lambda b: b <= path))
        coarse = F.greatest(below(text([x[0] for x in blocks])), F.lit(1))
        place = (coarse - 1) * step + below(F.element_at(F.array(*[text(x) for x in blocks]), coarse))
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), place + 1)

    def parts(self) -> list[int]:
        """Numbers of the deliveries that are in the store."""
        return [int(n[5:-5]) for n in self.manifests.names() if n.startswith("part-")]

    def load(self, inventory: DataFrame) -> int:
        """Add a delivery of one or more snapshots, or parts of such; returns its number.

        Rows without a path or snapshot number are left out, further columns
        ignored, repeats dropped.
        """
        rows, part = _delivered(inventory), max(self.parts(), default=-1) + 1
        if not self.labels:
            self.labels = _labels(self.spark, self.n)
            drawn = [r["path"] for r in rows.select("path").orderBy(F.xxhash64("path")).limit(PER_RANGE * self.n).collect()]  # bounded
            drawn.sort(key=str.encode)
            self.bounds = sorted({drawn[len(drawn) * i // self.n] for i in range(1, self.n)}, key=str.encode) if drawn else []
            self.manifests.publish("layout.json", json.dumps({"bounds": self.bounds, "labels": self.labels, "ranges": self.n}))
            self._declare()
        # hash partitioning by the label is the partitioning of the buckets: the grouping, the sort and the write stay within tasks
        ranged = rows.withColumn("range", self._range(F.col("path"))).repartition(self.n, "range")
        held = ranged.groupBy("range", "path", "snapshot_no").agg(F.max("row").alias("row"))
        held.select("path", "snapshot_no", "row", "range", F.lit(part).alias("part")).write.mode("append").partitionBy("part").bucketBy(self.n, "range").sortBy("path", "snapshot_no").format("parquet").saveAsTable(self.name)
        self.manifests.publish(f"part-{part}.json", "{}")
        return part

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """The rows that hold, those of the latest delivery: range, path, snapshot_no, digest, size.

        A null delivery time is the earliest; of equal times the greater
        (digest, size) holds.
        """
        table = self.spark.table(self.name).filter(F.col("part").isin(self.parts() if parts is None else parts))
        held = table.groupBy("range", "path", "snapshot_no").agg(F.max("row").alias("row"))
        return held.select("range", "path", "snapshot_no", "row.digest", "row.size")

    def snapshots(self) -> DataFrame:
        """The snapshots of each repository with their neighbours: repo, snapshot_no, prev_no, next_no."""
        table = self.spark.table(self.name).filter(F.col("part").isin(self.parts()))
        return _neighbours(table.select(repo_of(F.col("path")).alias("repo"), "snapshot_no").distinct())

    def changes(self, of_part: int | None = None) -> DataFrame:
        """Changes from each snapshot of a repository to the next: see :func:`snapshot_changes`.

        With ``of_part`` only those of the snapshots that this delivery touched
        and of the ones after them, which is what a delivery can change; only
        the snapshots compared are looked at.
        """
        known = self.spark.createDataFrame([], "repo string, snapshot_no long, prev_no long, next_no long") if not self.labels else self.snapshots()
        if not self.labels:
            return _merged(self.spark.createDataFrame([], "range int, path string, snapshot_no long, digest string, size long"), known)
        rows = self.rows()
        if of_part is not None:
            table = self.spark.table(self.name).filter(F.col("part") == of_part)
            touched = table.select(repo_of(F.col("path")).alias("repo"), "snapshot_no").distinct().withColumn("touched", F.lit(True))
            near = known.join(touched, ["repo", "snapshot_no"], "left")
            w = Window.partitionBy("repo").orderBy("snapshot_no")
            due = F.coalesce("touched", F.lag("touched").over(w), F.lit(False))
            near = near.withColumn("due", due).withColumn("wanted", F.col("due") | F.coalesce(F.lead(due).over(w), F.lit(False)))
            near = _small(near.filter("wanted").drop("touched", "wanted"))
            rows = rows.withColumn("repo", repo_of(F.col("path"))).join(near.select("repo", "snapshot_no"), ["repo", "snapshot_no"], "left_semi").drop("repo")
            return _merged(rows, near.drop("due")).join(near.filter("due").select("repo", "snapshot_no"), ["repo", "snapshot_no"], "left_semi").select(*CHANGES)
        return _merged(rows, _small(known))


def _small(known: DataFrame) -> DataFrame:
    """A list with a row per snapshot or repository, written once, and broadcast if it was counted to be small; else Spark joins it by shuffle."""
    known = cut(known)
    return F.broadcast(known) if known.n_rows <= BROADCAST_ROWS else known


def _differs(a: Column, b: Column, c: Column, d: Column) -> Column:
    return ~(a.eqNullSafe(b) & c.eqNullSafe(d))


CHANGES = ["repo", "snapshot_no", "path", "change", "old_digest", "new_digest", "old_size", "new_size"]


def _merged(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The merge per range: two pointers, a row and the one after it, over rows sorted by (path, snapshot_no).

    Neighbours of the same path either are consecutive snapshots and get
    compared, or have a gap between them. Whether a gap, a beginning or an end
    is a change depends on the snapshots that the repository has; only those
    boundary rows, and only by their numbers, meet the list of snapshots.
    """
    w = Window.partitionBy("range", "path").orderBy("snapshot_no")
    here = F.struct("snapshot_no", "digest", "size")
    pairs = rows.withColumn("nxt", F.lead(here).over(w)).withColumn("first", F.lag("snapshot_no").over(w).isNull())
    certain = F.col("nxt.snapshot_no") == F.col("snapshot_no") + 1
    differ = _differs(F.col("digest"), F.col("nxt.digest"), F.col("size"), F.col("nxt.size"))
    # neighbours in consecutive numbers that are equal decide nothing further
    open_rows = pairs.filter(F.col("first") | F.col("nxt").isNull() | ~certain | differ).withColumn("repo", repo_of(F.col("path")))
    j = open_rows.join(known, ["repo", "snapshot_no"])

    def event(no: Column, change: str, old: bool, new: str | None) -> Column:
        none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("long")
        od, os = (F.col("digest"), F.col("size")) if old else (none_s, none_l)
        nd, ns = {"nxt": (F.col("nxt.digest"), F.col("nxt.size")), "here": (F.col("digest"), F.col("size")), None: (none_s, none_l)}[new]
        return F.struct(no.alias("snapshot_no"), F.lit(change).alias("change"), od.alias("old_digest"), nd.alias("new_digest"), os.alias("old_size"), ns.alias("new_size"))

    has_next = F.col("nxt").isNotNull()
    adjacent = has_next & (F.col("nxt.snapshot_no") == F.col("next_no"))
    events = F.array(
        F.when(F.col("first") & F.col("prev_no").isNotNull(), event(F.col("snapshot_no"), "added", False, "here")),
        F.when(adjacent & differ, event(F.col("nxt.snapshot_no"), "changed", True, "nxt")),
        F.when(~F.coalesce(adjacent, F.lit(False)) & F.col("next_no").isNotNull(), event(F.col("next_no"), "removed", True, None)),
        F.when(has_next & ~F.coalesce(adjacent, F.lit(False)), event(F.col("nxt.snapshot_no"), "added", False, "nxt")),
    )
    out = j.select("repo", "path", F.explode(F.array_compact(events)).alias("e"))
    return out.select("repo", "e.snapshot_no", "path", *[f"e.{c}" for c in CHANGES[3:]])


def snapshot_changes(inventory: DataFrame) -> DataFrame:
    """Changes from each snapshot of a repository to the next: repo, snapshot_no, path, change and both sides' values.

    The inventory goes into a store of its own, and the changes are the merge
    of the store's ranges. The first snapshot of a repository is compared with
    nothing and gives no rows; an empty inventory gives none either.
    """
    store = SnapshotStore(inventory.sparkSession, fresh(inventory.sparkSession))
    store.load(inventory)
    return store.changes()


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes per repository, snapshot and kind."""
    return changes.groupBy("repo", "snapshot_no", "change").agg(F.count(F.lit(1)).alias("n"))
