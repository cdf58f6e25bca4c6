"""Running numbers and sums within groups of any size.

A window partitioned by the group puts a hot group into one task. Here rows
are range-partitioned by group and order instead, so that a hot group spans
many partitions; each partition numbers its own rows and small per-partition
totals, shifted by a prefix sum, link the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut


def running(df: DataFrame, group: list[str], order: list[str], value: Column | None = None, out: str = "rn", partitions: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group, the row itself excluded.

    Without ``value`` it is the row's number from 0. ``order`` should be unique
    within a group; ties take an arbitrary but fixed order. Rows with a null
    group form a group of their own. A null value counts as 0.
    """
    clash = {"__pid", "__local", "__v", "__sum", "__off"} & set(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    v = F.lit(1).cast("long") if value is None else F.coalesce(value, F.lit(0)).cast("long")
    keys = [F.col(c) for c in [*group, *order]]
    ranged = df.withColumn("__v", v)
    ranged = ranged.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("__pid", F.spark_partition_id())
    local = Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # the partition id is fixed once, by the written copy
    fixed = cut(ranged)
    fixed = fixed.withColumn("__local", F.coalesce(F.sum("__v").over(local), F.lit(0)))
    # one row for each group and partition that holds a part of it
    parts = fixed.groupBy(*group, "__pid").agg(F.sum("__v").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    spread = parts.withColumn("__off", F.sum("__sum").over(before)).filter(F.col("__off").isNotNull()).drop("__sum")
    a, b = fixed.alias("a"), spread.alias("b")
    same = F.col("a.__pid") == F.col("b.__pid")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = a.join(b, same, "left")
    total = F.col("a.__local") + F.coalesce(F.col("b.__off"), F.lit(0))
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], total.alias(out))
