"""Reads over tasks and messages, with their SQL.

The tables have no tasks: orders stand for tasks (customers for milestones),
lines of orders for dependencies, events for messages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import records, traversal
from graphloom.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_TASKS = "t AS (SELECT o_orderkey AS task_id, o_custkey AS milestone_ref, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ready' ELSE 'parked' END AS status, o_orderpriority AS stage FROM orders)"
_DEPS = "dp AS (SELECT l_orderkey AS task_id, l_orderkey - l_linenumber AS dependency_id, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS satisfied FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY ALL)"
_BOARD = "m AS (SELECT event_id AS id, 'M' || (user_id % 50) AS milestone_ref, user_id AS task_id, event_type AS topic, 'R' || (user_id % 7) AS recipient, ts AS created_at, CASE WHEN value < 50 THEN 'active' ELSE 'withdrawn' END AS status FROM events)"


def _tasks(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "ready").otherwise("parked")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("milestone_ref"), status.alias("status"), F.col("o_orderpriority").alias("stage"))


def _dependencies(spark, d):
    line = table(spark, d, "lineitem").filter("l_orderkey % 4 <> 0")
    return line.groupBy(F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") - F.col("l_linenumber")).alias("dependency_id")).agg((F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)) == 1).alias("satisfied"))


def _messages(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("M"), (F.col("user_id") % 50).cast("string")).alias("milestone_ref"), F.col("user_id").alias("task_id"), F.col("event_type").alias("topic"),
        F.concat(F.lit("R"), (F.col("user_id") % 7).cast("string")).alias("recipient"), F.col("ts").alias("created_at"), F.when(F.col("value") < 50, "active").otherwise("withdrawn").alias("status"), F.col("props").alias("payload"),
    )


@query(f"WITH {_TASKS}, {_DEPS} SELECT dp.task_id, dp.dependency_id, t.task_id IS NOT NULL AS known FROM dp LEFT JOIN t ON t.task_id = dp.dependency_id WHERE NOT satisfied AND (t.task_id IS NULL OR t.status <> 'completed')")
def unmet_dependencies(spark, d):
    return records.unmet(_tasks(spark, d), _dependencies(spark, d))


@query(f"WITH {_TASKS} SELECT * FROM t WHERE stage = '1-URGENT' AND starts_with(CAST(milestone_ref AS VARCHAR), '1')")
def tasks_of_scope(spark, d):
    t = records.scoped(_tasks(spark, d), stage="1-URGENT", status=None)
    return records.with_prefix(t.withColumn("key", F.col("milestone_ref").cast("string")), "key", "1").drop("key")


@query(f"WITH {_BOARD} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY milestone_ref, task_id ORDER BY created_at DESC NULLS LAST, id DESC) AS INTEGER) AS place FROM m) WHERE place <= 10")
def board_newest(spark, d):
    return records.newest(_messages(spark, d), ["milestone_ref", "task_id"])


@query(f"WITH {_BOARD} SELECT recipient, id, created_at, CAST(row_number() OVER (PARTITION BY recipient ORDER BY created_at NULLS FIRST, id) AS INTEGER) AS place FROM (SELECT DISTINCT recipient, id, created_at FROM m WHERE status = 'active' AND topic <> 'click')")
def board_inbox(spark, d):
    m = _messages(spark, d)
    return records.inbox(m, m.filter("topic = 'click'").select("recipient", "id"))


@query(f"WITH {_BOARD}, u AS (SELECT recipient, (min(created_at) + (max(created_at) - min(created_at)) / 2) AS until FROM m GROUP BY recipient) SELECT id, recipient FROM m WHERE topic = 'click' UNION SELECT m.id, m.recipient FROM m JOIN u ON u.recipient = m.recipient AND m.created_at <= u.until")
def board_marked_read(spark, d):
    m = _messages(spark, d)
    upto = m.groupBy("recipient").agg((F.min("created_at") + (F.max("created_at") - F.min("created_at")) / 2).alias("created_at"))
    return records.marked_read(m.filter("topic = 'click'").select("recipient", "id"), m, upto)


@query(f"WITH {_TASKS}, a AS (SELECT task_id, stage, 'draft' AS status FROM t WHERE task_id % 3 <> 0), b AS (SELECT task_id, stage, status FROM t WHERE task_id % 5 <> 0) SELECT coalesce(b.task_id, a.task_id) AS task_id, coalesce(b.stage, a.stage) AS stage, coalesce(b.status, a.status) AS status, CASE WHEN a.task_id IS NULL THEN 'stored' WHEN b.task_id IS NULL THEN 'declared' ELSE 'both' END AS source FROM a FULL JOIN b ON a.task_id = b.task_id")
def milestone_view(spark, d):
    """Tasks that one source declares and another stores; each lacks some."""
    t = _tasks(spark, d)
    return records.merged_view(t.filter("task_id % 3 <> 0").withColumn("status", F.lit("draft")), t.filter("task_id % 5 <> 0"), "task_id", ["stage", "status"])


@query("WITH a AS (SELECT o_custkey AS owner, o_orderpriority AS entry FROM orders), b AS (SELECT o_custkey AS owner, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderpriority END AS entry FROM orders) SELECT *, 'declared' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'stored' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def matrix_parity(spark, d):
    o = table(spark, d, "orders")
    declared = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("entry"))
    stored = o.select(F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "P", "none").otherwise(F.col("o_orderpriority")).alias("entry"))
    return records.parity(declared, stored)


@query(
    """WITH RECURSIVE t AS (SELECT DISTINCT s_suppkey AS id FROM supplier), nd AS (SELECT id, (id + 1) // 2 AS needs FROM t WHERE id > 2), w AS (SELECT id, 0 AS wave FROM t WHERE id <= 2 UNION ALL SELECT nd.id, w.wave + 1 FROM w JOIN nd ON nd.needs = w.id),
s AS (SELECT s_suppkey AS owner, 'area' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '/part' ELSE '' END AS scope FROM supplier)
SELECT DISTINCT least(a.owner, b.owner) AS a, greatest(a.owner, b.owner) AS b, x.wave FROM s a JOIN s b ON a.owner <> b.owner AND (a.scope = b.scope OR starts_with(a.scope, b.scope || '/')) JOIN w x ON x.id = a.owner JOIN w y ON y.id = b.owner AND y.wave = x.wave"""
)
def wave_clashes(spark, d):
    """Suppliers stand for tasks, each needing the one of half its number, and nations for scopes."""
    s = table(spark, d, "supplier")
    ids = s.select(F.col("s_suppkey").alias("id"))
    needs = ids.filter("id > 2").select("id", F.floor((F.col("id") + 1) / 2).alias("needs"))
    scopes = s.select(F.col("s_suppkey").alias("owner"), F.concat(F.lit("area"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "/part").otherwise("")).alias("scope"))
    return traversal.wave_clashes(traversal.waves(ids, needs), scopes)


QUERIES = Q
