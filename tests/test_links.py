from conftest import rows

from graphloom.sources import markdown


def test_links_that_climb_any_number_of_levels(spark):
    deep = "/".join("abcdefghijkl")
    links = ["../" * 12 + "x.md", "../" * 9 + "y.md", "../" * 13 + "x.md", "./.././../l.md", "m/../n/./../z.md", "../" * 10 + "none.md"]
    section = spark.createDataFrame([(f"{deep}/d.md", 0, None, links)], "path string, ordinal int, title string, links array<string>")
    paths = spark.createDataFrame([("x.md",), ("a/b/c/y.md",), ("a/b/c/d/e/f/g/h/i/j/l.md",), (f"{deep}/z.md",)], "path string")
    assert rows(markdown.broken_links(section, paths), "link") == sorted([("../" * 13 + "x.md",), ("../" * 10 + "none.md",)])
