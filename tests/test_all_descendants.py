from conftest import rows
from oracle import connect, same

from graphloom.plans import catalogue


def test_descendants_of_nodes_of_any_kind(spark, tmp_path):
    pairs = [("component:a", "module:b"), ("module:b", "function:c"), ("function:c", "function:d"), ("x", "x"), ("x", "y")]
    data = [("o", i, a, "contains", b) for i, (a, b) in enumerate(pairs)]
    spark.createDataFrame(data, "owner_path string, ordinal long, src string, kind string, dst string").coalesce(1).write.parquet(str(tmp_path / "edge_occurrences.parquet"))
    got = catalogue.queries()["p3_descendants"](spark, str(tmp_path))
    chain = ["component:a", "module:b", "function:c", "function:d"]
    up = catalogue.queries()["p3_ancestors"](spark, str(tmp_path))
    assert rows(up, "ancestor", "id", "distance") == rows(got, "id", "descendant", "distance")
    assert rows(got, "id", "descendant", "distance") == sorted((chain[i], chain[j], j - i) for i in range(4) for j in range(i + 1, 4))


def test_every_parent_has_descendants(spark, small):
    got = catalogue.queries()["p3_descendants"](spark, small)
    same(got, connect(small), catalogue.oracle_sql()["p3_descendants"])
    tree = catalogue.queries()["p3_tree"](spark, small).filter("descendants > 0")
    assert rows(got.select("id").distinct()) == rows(tree, "id")
