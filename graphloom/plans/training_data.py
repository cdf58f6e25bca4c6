"""Queries of the core problems on training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import drift, hierarchy, increments, skew, snapshots
from graphloom.session import fresh, table


def p1_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "source_inventory")).select("snapshot_no", "path", "change")


def p1_changes(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "source_inventory"))


def p1_merged(spark, d):
    """Changes after the inventory came in three deliveries by time, each merged into the same store."""
    inv = table(spark, d, "source_inventory")
    t = inv.agg(F.min("delivered_at").alias("lo"), F.max("delivered_at").alias("hi")).first()
    store = snapshots.SnapshotStore(spark, fresh(spark))
    at = F.col("delivered_at")
    if t["lo"] is not None:
        a, b = (F.lit(t["lo"] + (t["hi"] - t["lo"]) * x // 10) for x in (4, 7))
        for part in (at.isNull() | (at < a), (at >= a) & (at < b), at >= b):
            store.load(inv.filter(part))
    return store.changes()


def p1_counts(spark, d):
    return snapshots.change_counts(snapshots.snapshot_changes(table(spark, d, "source_inventory")))


def p2_found(spark, d):
    return p2_pending(spark, d).select("path")


def p2_pending(spark, d):
    got = increments.pending_files(table(spark, d, "source_inventory"), table(spark, d, "files"), table(spark, d, "index_runs"))
    return got.select("repo", "snapshot_no", "path", "digest", "size")


def p2_runs(spark, d):
    """Runs at three times over the inventory as delivered by then, each failing once before its commit: the run that took each version."""
    inv = table(spark, d, "source_inventory")
    t = inv.agg(F.min("delivered_at").alias("lo"), F.max("delivered_at").alias("hi")).first()
    ends = [] if t["lo"] is None else [t["lo"] + (t["hi"] - t["lo"]) * x // 10 for x in (4, 7)]
    return increments.replayed(inv, ends).select("run", "path", "digest")


def p3_found(spark, d):
    return hierarchy.circles(hierarchy.containment_links(table(spark, d, "edge_occurrences")))


def p3_tree(spark, d):
    return _tree(spark, d).withColumn("path", F.array_join("path", " > ")).drop("tree_size")


def _tree(spark, d):
    return hierarchy.hierarchy(hierarchy.containment_links(table(spark, d, "edge_occurrences")))


def p3_descendants(spark, d):
    """Descendants of every node, by nested-set ranges."""
    return hierarchy.range_pairs(_tree(spark, d))


def p3_ancestors(spark, d):
    """Ancestors of every node."""
    return hierarchy.ancestors(_tree(spark, d))


def p5_found(spark, d):
    return skew.dominant_keys(table(spark, d, "edge_occurrences")).select("kind", "dst")


def p5_keys(spark, d):
    return skew.edge_key_results(table(spark, d, "edge_occurrences")).select("kind", "dst", "n_rows", "n_distinct")


def p6_found(spark, d):
    return drift.field_changes(drift.received_layouts(table(spark, d, "bench_results"))).select("result_name", "field", "change")


def p6_changes(spark, d):
    return drift.field_changes(drift.received_layouts(table(spark, d, "bench_results"))).select("series", "ord", "result_name", "field", "change", "was", "type")


def p6_files(spark, d):
    """Per file the fields of each type."""
    t = drift.file_types(drift.received_layouts(table(spark, d, "bench_results")))
    return t.groupBy("series", "result_name").agg(F.count(F.lit(1)).alias("n_fields"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("number", "string", "boolean", "array", "object")], F.count_if(F.col("type").isNull()).alias("n_null"))


def p6_types(spark, d):
    return drift.path_types(drift.received_layouts(table(spark, d, "bench_results")))


def p6_table(spark, d):
    results = table(spark, d, "bench_results")
    return drift.consistent_table(results, drift.received_layouts(results))


def p6_failed(spark, d):
    """Files whose value did not fit the column of a path, counted."""
    return p6_table(spark, d).select(F.explode("failed").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_failed"))


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p1_merged, p1_counts, p2_found, p2_pending, p2_runs, p3_found, p3_tree, p3_descendants, p3_ancestors, p5_found, p5_keys, p6_found, p6_changes, p6_files, p6_types, p6_table, p6_failed)}

_PATH = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/(\.?/)+', '/', 'g'), '^(\./+)+', '')"
_HELD = rf"""named AS (
  SELECT snapshot_no, {_PATH} AS path, right(lower(digest), 64) AS digest, size, delivered_at FROM source_inventory WHERE path IS NOT NULL AND snapshot_no IS NOT NULL),
held AS (
  SELECT split_part(path, '/', 1) AS repo, path, snapshot_no, digest, size
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY delivered_at DESC NULLS LAST, digest DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM named) WHERE rn = 1),
snaps AS (
  SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev_no, lead(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS next_no
  FROM (SELECT DISTINCT repo, snapshot_no FROM held))"""
_CHANGES = f"""{_HELD},
newer AS (SELECT h.* FROM held h JOIN snaps s USING (repo, snapshot_no) WHERE s.prev_no IS NOT NULL),
older AS (SELECT h.repo, h.path, h.digest, h.size, s.next_no AS snapshot_no FROM held h JOIN snaps s USING (repo, snapshot_no) WHERE s.next_no IS NOT NULL),
changes AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
    o.digest AS old_digest, n.digest AS new_digest, o.size AS old_size, n.size AS new_size
  FROM newer n FULL JOIN older o ON n.path = o.path AND n.snapshot_no = o.snapshot_no
  WHERE n.path IS NULL OR o.path IS NULL OR n.digest IS DISTINCT FROM o.digest OR n.size IS DISTINCT FROM o.size)"""
_PENDING = f"""WITH {_HELD},
good AS (SELECT DISTINCT run_id FROM index_runs WHERE outcome = 'succeeded'),
writes AS (SELECT {_PATH} AS path, right(lower(digest), 64) AS digest, status, indexed_at FROM files SEMI JOIN good USING (run_id) WHERE path IS NOT NULL),
state AS (
  SELECT path, digest AS seen, status FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, digest DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM writes) WHERE rn = 1)
SELECT h.repo, h.snapshot_no, h.path, h.digest, h.size
FROM held h JOIN snaps s USING (repo, snapshot_no) LEFT JOIN state t ON t.path = h.path
WHERE s.next_no IS NULL AND h.digest IS NOT NULL AND (t.path IS NULL OR t.seen IS DISTINCT FROM h.digest OR t.status IS NULL OR t.status NOT IN ('indexed', 'skipped'))"""
_LINKS = "links AS (SELECT DISTINCT src, dst FROM edge_occurrences WHERE kind = 'contains' AND src IS NOT NULL AND dst IS NOT NULL)"
_TREE = f"""WITH RECURSIVE {_LINKS},
up AS (SELECT dst AS id, min(src) AS parent FROM links GROUP BY dst),
ids AS (SELECT src AS id FROM links UNION SELECT dst FROM links),
walk AS (
  SELECT id, CAST(NULL AS VARCHAR) AS parent, id AS root, CAST(0 AS BIGINT) AS depth, id AS path FROM ids WHERE id NOT IN (SELECT id FROM up)
  UNION ALL
  SELECT u.id, u.parent, w.root, w.depth + 1, w.path || ' > ' || u.id FROM up u JOIN walk w ON w.id = u.parent)"""
_DISTINCT = "SELECT DISTINCT owner_path, ordinal, src, kind, dst, line, evidence, confidence FROM edge_occurrences"
_FIELDS = """fl AS (
  SELECT result_name, series, recorded_at, body FROM (
    SELECT *, row_number() OVER (PARTITION BY result_name ORDER BY received_at NULLS FIRST, series, recorded_at NULLS FIRST, body) AS rn
    FROM bench_results WHERE result_name IS NOT NULL AND series IS NOT NULL AND CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END) WHERE rn = 1),
od AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY recorded_at NULLS FIRST, result_name) - 1 AS ord FROM fl),
pv AS (
  SELECT series, ord, result_name, replace(substr(j.fullkey, 3), '"', '') AS path, replace(substr(j.path, 3), '"', '') AS parent,
    CASE WHEN j.type = 'OBJECT' THEN 'object' WHEN j.type = 'ARRAY' THEN 'array' WHEN j.type = 'VARCHAR' THEN 'string' WHEN j.type = 'BOOLEAN' THEN 'boolean' WHEN j.type <> 'NULL' THEN 'number' END AS type
  FROM od, json_tree(od.body) j WHERE j.fullkey <> '$' AND NOT contains(j.fullkey, '['))"""
_DRIFT = f"""WITH {_FIELDS},
nb AS (SELECT *, lag(ord) OVER w AS prev, lead(ord) OVER w AS nxt FROM pv WINDOW w AS (PARTITION BY series, path ORDER BY ord)),
st AS (SELECT *, prev IS NULL OR prev <> ord - 1 AS starts, sum(CASE WHEN prev IS NULL OR prev <> ord - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series, path ORDER BY ord) AS run FROM nb),
sd AS (SELECT *, last_value(type IGNORE NULLS) OVER (PARTITION BY series, path, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stood FROM st),
ev AS (
  SELECT series, ord, path, parent, 'added' AS change, type, NULL AS was FROM sd WHERE starts AND ord > 0
  UNION ALL SELECT series, ord, path, parent, 'retyped', type, stood FROM sd WHERE NOT starts AND type <> stood
  UNION ALL SELECT series, ord + 1, path, parent, 'removed', coalesce(type, stood), NULL FROM sd WHERE nxt IS NULL OR nxt <> ord + 1),
ow AS (SELECT e.*, od.result_name FROM ev e JOIN od USING (series, ord) WHERE NOT EXISTS (SELECT 1 FROM ev a WHERE a.series = e.series AND a.ord = e.ord AND a.path = e.parent)),
gr AS (
  SELECT series, ord, result_name, parent, type, count(*) = 2 AND count(DISTINCT change) = 2 AND type IS NOT NULL AS pair, max(path) FILTER (WHERE change = 'added') AS came, max(path) FILTER (WHERE change = 'removed') AS went
  FROM ow WHERE change <> 'retyped' GROUP BY series, ord, result_name, parent, type),
cs AS (
  SELECT series, ord, result_name, path AS field, change, was, type FROM ow WHERE change = 'retyped'
  UNION ALL SELECT series, ord, result_name, came, 'renamed', went, type FROM gr WHERE pair
  UNION ALL SELECT o.series, o.ord, o.result_name, o.path, o.change, NULL, o.type FROM ow o JOIN gr ON gr.series = o.series AND gr.ord = o.ord AND gr.parent = o.parent AND gr.type IS NOT DISTINCT FROM o.type WHERE o.change <> 'retyped' AND NOT gr.pair)"""

SQL = {
    "p6_found": f"{_DRIFT} SELECT result_name, field, change FROM cs",
    "p6_changes": f"{_DRIFT} SELECT * FROM cs",
    "p6_files": f"WITH {_FIELDS} SELECT series, result_name, count(*) AS n_fields, {', '.join(f"count(*) FILTER (WHERE type = '{k}') AS n_{k}" for k in ('number', 'string', 'boolean', 'array', 'object'))}, count(*) FILTER (WHERE type IS NULL) AS n_null FROM pv GROUP BY series, result_name",
    "p6_types": f"""WITH {_FIELDS}, n AS (SELECT path, type, count(*) AS n_files FROM pv GROUP BY path, type)
SELECT path, type, n_files, row_number() OVER (PARTITION BY path ORDER BY type IS NULL, n_files DESC, type) = 1 AND type IS NOT NULL AS main FROM n""",
    "p1_found": f"WITH {_CHANGES} SELECT snapshot_no, path, change FROM changes",
    "p1_changes": f"WITH {_CHANGES} SELECT * FROM changes",
    "p1_merged": f"WITH {_CHANGES} SELECT * FROM changes",
    "p1_counts": f"WITH {_CHANGES} SELECT repo, snapshot_no, change, count(*) AS n FROM changes GROUP BY ALL",
    "p2_found": f"SELECT path FROM ({_PENDING})",
    "p2_pending": _PENDING,
    "p2_runs": f"""WITH r AS (SELECT DISTINCT {_PATH} AS path, right(lower(digest), 64) AS digest, delivered_at FROM source_inventory WHERE path IS NOT NULL AND snapshot_no IS NOT NULL AND digest IS NOT NULL),
v AS (SELECT path, digest, min(coalesce(epoch_us(delivered_at), 0)) AS t FROM r GROUP BY ALL),
e AS (SELECT epoch_us(min(delivered_at)) AS lo, epoch_us(max(delivered_at)) AS hi FROM source_inventory)
SELECT CASE WHEN t < lo + (hi - lo) * 4 // 10 THEN 1 WHEN t < lo + (hi - lo) * 7 // 10 THEN 2 ELSE 3 END::INTEGER AS run, path, digest FROM v CROSS JOIN e""",
    "p3_found": f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reach r JOIN links l ON l.src = r.dst)
SELECT min(b.dst) AS loop_id, a.src AS node_id FROM reach a JOIN reach b ON b.src = a.src JOIN reach c ON c.src = b.dst AND c.dst = a.src WHERE a.src = a.dst GROUP BY a.src""",
    "p3_descendants": f"""{_TREE}, below AS (
  SELECT id, id AS descendant, CAST(0 AS BIGINT) AS distance FROM walk
  UNION ALL SELECT b.id, u.id, b.distance + 1 FROM below b JOIN up u ON u.parent = b.descendant)
SELECT id, descendant, distance FROM below WHERE distance > 0""",
    "p3_ancestors": f"""{_TREE}, below AS (
  SELECT id, id AS ancestor, CAST(0 AS BIGINT) AS distance FROM walk
  UNION ALL SELECT b.id, u.parent, b.distance + 1 FROM below b JOIN up u ON u.id = b.ancestor)
SELECT id, ancestor, distance FROM below WHERE distance > 0""",
    "p3_tree": f"""WITH RECURSIVE {_LINKS},
up AS (SELECT dst AS id, min(src) AS parent FROM links GROUP BY dst),
ids AS (SELECT src AS id FROM links UNION SELECT dst FROM links),
walk AS (
  SELECT id, CAST(NULL AS VARCHAR) AS parent, id AS root, CAST(0 AS BIGINT) AS depth, [id] AS steps FROM ids WHERE id NOT IN (SELECT id FROM up)
  UNION ALL
  SELECT u.id, u.parent, w.root, w.depth + 1, list_append(w.steps, u.id) FROM up u JOIN walk w ON w.id = u.parent),
below AS (SELECT id, count(*) - 1 AS descendants FROM (SELECT unnest(steps) AS id FROM walk) GROUP BY id),
placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY steps) AS lo FROM walk JOIN below USING (id))
SELECT id, parent, root, depth, array_to_string(steps, ' > ') AS path, lo, lo + descendants AS hi, descendants, 'tree' AS state FROM placed
UNION ALL SELECT id, parent, NULL, NULL, NULL, NULL, NULL, NULL, 'unprocessed' FROM ids LEFT JOIN up USING (id) WHERE id NOT IN (SELECT id FROM walk)""",
    "p5_found": f"WITH o AS ({_DISTINCT}) SELECT kind, dst FROM o WHERE dst IS NOT NULL GROUP BY kind, dst HAVING count(*) * 100 >= (SELECT count(*) FROM o)",
    "p5_keys": f"SELECT kind, dst, count(*) AS n_rows, count(DISTINCT src) AS n_distinct FROM ({_DISTINCT}) GROUP BY kind, dst",
}
