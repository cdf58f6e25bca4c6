"""Reads over task and board tables: pages, unread messages, dependencies, and comparison of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scoped(records: DataFrame, **scope: str | None) -> DataFrame:
    """Records whose columns have the given values; a None asks for nothing."""
    for column, value in scope.items():
        if value is not None:
            records = records.filter(F.col(column) == value)
    return records


def with_prefix(records: DataFrame, column: str, prefix: str) -> DataFrame:
    """Records whose key begins with a prefix."""
    return records.filter(F.col(column).startswith(prefix))


def newest(messages: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """The newest messages of each group, without their payload, newest first: all other columns and place (from 1).

    Equal times go by the greater id. ``top`` is at most 50.
    """
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return messages.drop("payload").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= min(top, 50))


def inbox(messages: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """Active messages of each recipient that have not been read, oldest first: recipient, id, created_at, place (from 1).

    ``reads`` has recipient and id, a row for each message marked as read.
    """
    open_ = messages.filter((F.col("status") == "active") & F.col("recipient").isNotNull()).select("recipient", "id", "created_at").distinct()
    if reads is not None:
        open_ = open_.join(reads.select("recipient", "id"), ["recipient", "id"], "left_anti")
    w = Window.partitionBy("recipient").orderBy(F.asc_nulls_first("created_at"), "id")
    return open_.withColumn("place", F.row_number().over(w))


def marked_read(reads: DataFrame, messages: DataFrame, upto: DataFrame) -> DataFrame:
    """The reads after each recipient of ``upto`` (recipient, created_at) has read all up to that time: recipient, id; each once."""
    due = messages.join(upto.select("recipient", F.col("created_at").alias("until")), "recipient").filter(F.col("created_at") <= F.col("until"))
    return reads.select("recipient", "id").unionByName(due.select("recipient", "id")).distinct()


def unmet(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies (task_id, dependency_id, satisfied) that are neither satisfied nor completed tasks: task_id, dependency_id, known."""
    t = tasks.select(F.col("task_id").alias("dependency_id"), "status").dropDuplicates(["dependency_id"])
    open_ = dependencies.filter(~F.coalesce("satisfied", F.lit(False))).select("task_id", "dependency_id").distinct()
    j = open_.join(t.withColumn("known", F.lit(True)), "dependency_id", "left").filter(F.col("known").isNull() | ~F.coalesce(F.col("status") == "completed", F.lit(False)))
    return j.select("task_id", "dependency_id", F.coalesce("known", F.lit(False)).alias("known"))


def merged_view(declared: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Declared and stored rows as one per key, stored values first: key, columns, source (both, declared or stored)."""
    a, b = declared.select(key, *columns, F.lit(True).alias("__d")).alias("a"), stored.select(key, *columns, F.lit(True).alias("__s")).alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    source = F.when(F.col("__d") & F.col("__s"), "both").when(F.col("__d"), "declared").otherwise("stored")
    return j.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns], source.alias("source"))


def parity(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that only one of two tables of the same columns has, as often as it has them more: the columns, only_in."""
    same = stored.select(*declared.columns)
    return declared.exceptAll(same).withColumn("only_in", F.lit("declared")).unionByName(same.exceptAll(declared).withColumn("only_in", F.lit("stored")))
