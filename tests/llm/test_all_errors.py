import pytest
from conftest import rows

from graphloom.llm import validity

BAD = {"rs": "fn f() { let = ; }\n", "go": "x = 1\n", "ts": "const = 1;\n", "sql": "SELECT 1 2 FROM;\n", "py": "x = = 1\n", "toml": "a =\n"}


@pytest.mark.parametrize("ending", sorted(BAD))
def test_every_bad_line_is_an_error(ending):
    head = "package a\n" if ending == "go" else ""
    got = validity.issues("a." + ending, head + BAD[ending] * 1500)
    lines = {x.line for x in got}
    assert lines >= {i + 1 + bool(head) for i in range(1500)} and len(got) >= 1500
    assert got == sorted(got, key=lambda x: x.line)


def test_files_count_and_keep_all_errors(spark, monkeypatch):
    monkeypatch.setattr(validity, "HELD", 2000)
    data = [("r/a.py", "x = = 1\n" * 1200), ("r/a.py", "y\n" + "x = = 1\n" * 1500), ("r/b.py", "x = 1"), ("r/c.py", "x = = 1\n" * 2500), ("r/d.py", None)]
    df = spark.createDataFrame(data, "path string, content string")
    assert rows(validity.invalid_files(df), "path", "n_errors", "first_line") == [("r/a.py", 1500, 2), ("r/c.py", 2500, 1)]
    assert rows(validity.parsed(df, 1).selectExpr("path", "n_errors", "size(errors) AS n")) == sorted([("r/a.py", 1200, 1200), ("r/a.py", 1500, 1500), ("r/b.py", 0, 0), ("r/c.py", 2500, 2500), ("r/d.py", 0, 0)])
