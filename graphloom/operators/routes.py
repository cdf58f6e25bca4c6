"""Matching of client URLs with declared routes, and of overlapping scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import route


def match_routes(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """The one route that fits a client's URL best: client, route, score.

    Routes of as many segments compete; a segment equal to the route's counts
    3, a parameter for a parameter 2, a value for a parameter 1, anything else
    rules the route out. URLs whose best score two routes share have no match.
    """
    c = clients.select(F.col("url").alias("client"), F.split(route(F.col("url")), "/").alias("a")).dropna().distinct()
    r = routes.select(route(F.col("route")).alias("route")).dropna().distinct().withColumn("b", F.split("route", "/"))
    c, r = c.withColumn("n", F.size("a")), r.withColumn("n", F.size("b"))
    # the first segment is literal in nearly all routes and keeps the groups of one length apart
    first = lambda x: F.get(x, F.lit(1))
    keys = F.array(F.coalesce(first(F.col("a")), F.lit("")), F.lit("{param}"))
    c = c.withColumn("k", F.explode(F.array_distinct(keys)))
    r = r.withColumn("k", F.coalesce(first(F.col("b")), F.lit("")))
    p = "{param}"
    point = lambda x, y: F.when((x == y) & (y == p), 2).when(x == y, 3).when(y == p, 1)
    scores = F.zip_with("a", "b", point)
    j = c.join(r, ["n", "k"]).withColumn("s", scores).filter(~F.exists("s", lambda x: x.isNull()))
    j = j.select("client", "route", F.aggregate("s", F.lit(0), lambda acc, x: acc + x).alias("score"))
    best = j.groupBy("client").agg(F.max("score").alias("score"))
    top = j.join(best, ["client", "score"]).groupBy("client", "score").agg(F.count(F.lit(1)).alias("n"), F.min("route").alias("route"))
    return top.filter("n = 1").select("client", "route", "score")


def scope_overlaps(scopes: DataFrame) -> DataFrame:
    """Pairs of owners with a scope equal to or below one of the other's: a, b (a < b).

    ``scopes`` has owner and scope (a path, or one ending in /**). Every scope
    meets the scopes above it by equality, so no pairs are compared that do not
    overlap.
    """
    s = scopes.select("owner", F.regexp_replace("scope", "(?:/\\*\\*|/)$", "").alias("scope")).dropna().distinct()
    parts = F.split("scope", "/")
    ups = s.select(F.col("owner").alias("x"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("scope"))
    j = ups.join(s.select(F.col("owner").alias("y"), "scope"), "scope").filter("x <> y")
    return j.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
