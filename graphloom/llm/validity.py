"""Source files that do not parse (problem 4).

Each file goes through a recursive-descent parser of the language that its
ending names; expressions are parsed by precedence climbing, and after an error
panic mode skips to where a statement may start, so that all errors of a file
are found. The parsers judge syntax only, not names or imports.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.parsing import go, json_, python_, rust, sql, toml_, typescript
from graphloom.llm.parsing.base import SyntaxIssue

CHECKS = {"py": python_.check, "rs": rust.check, "ts": typescript.check, "go": go.check, "json": json_.check, "toml": toml_.check, "sql": sql.check, "md": lambda source: []}
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "go": "go", "json": "json", "toml": "toml", "sql": "sql", "md": "markdown"}
DEPTH = 4_000_000  # Python frames a parser may nest; about 100 bytes each, 10 to 15 a bracket
HELD = 100_000  # errors after which a worker hands over its rows, as a file may have any number


def issues(path: str, content: str | None) -> list[SyntaxIssue] | None:
    """The errors of a file; None where the content is null, the ending names no language, or a text nests too deeply to be judged.

    Too deep are more than some 250,000 brackets within each other; JSON may
    nest to any depth.
    """
    check = CHECKS.get(path.rpartition(".")[2].lower())
    if check is None or content is None:
        return None
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    try:
        return check(content)
    except RecursionError:
        return None


def parsed(texts: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per row with a path: path, language, valid, n_errors, first_line, first_cause, errors.

    ``valid`` is null for null contents, endings of no known language and texts
    that nest too deeply to be judged (:func:`issues`). As
    parsing costs far more than reading, rows are dealt out over ``partitions``
    tasks first (by default by their number and Spark's parallelism).
    """
    rows = texts.select("path", "content").filter(F.col("path").isNotNull())
    if partitions is None:
        partitions = max(texts.sparkSession.sparkContext.defaultParallelism * 3, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "path string, language string, valid boolean, n_errors long, first_line long, first_cause string, errors array<struct<line:bigint,cause:string>>"
    error = pa.list_(pa.struct([("line", pa.int64()), ("cause", pa.string())]))

    def part(paths: list[str], found: list[list[SyntaxIssue] | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(paths, pa.string()),
                pa.array([LANGUAGES.get(p.rpartition(".")[2].lower()) for p in paths], pa.string()),
                pa.array([None if x is None else not x for x in found], pa.bool_()),
                pa.array([0 if x is None else len(x) for x in found], pa.int64()),
                pa.array([x[0].line if x else None for x in found], pa.int64()),
                pa.array([x[0].cause if x else None for x in found], pa.string()),
                pa.array([[{"line": y.line, "cause": y.cause} for y in x or []] for x in found], error),
            ],
            names=["path", "language", "valid", "n_errors", "first_line", "first_cause", "errors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                paths, contents = (batch.column(i).slice(at, 500).to_pylist() for i in (0, 1))
                found, start, held = [], 0, 0
                for k, (p, c) in enumerate(zip(paths, contents)):
                    found.append(issues(p, c))
                    held += len(found[-1] or ())
                    if held >= HELD or k + 1 == len(paths):
                        yield part(paths[start : k + 1], found)
                        found, start, held = [], k + 1, 0

    return rows.repartition(partitions).mapInArrow(run, schema)


def invalid_files(texts: DataFrame) -> DataFrame:
    """Files that do not parse, one row per path: path, language, n_errors, first_line, first_cause.

    Repeats count once; of different contents of a path the one with most errors is reported.
    """
    bad = parsed(texts).filter("NOT valid")
    row = F.struct("n_errors", "first_line", "first_cause", "language")
    return bad.groupBy("path").agg(F.max(row).alias("r")).select("path", "r.language", "r.n_errors", "r.first_line", "r.first_cause")


def rates(texts: DataFrame) -> DataFrame:
    """Per repository and language: repo, language, n_files, n_judged, n_invalid, rate (of those judged).

    Files with null contents are not judged; the rate is null where none is.
    """
    per_file = parsed(texts).groupBy("path", "language").agg(F.min("valid").alias("valid"))
    by = per_file.groupBy(F.substring_index("path", "/", 1).alias("repo"), "language")
    n = by.agg(F.count(F.lit(1)).alias("n_files"), F.count("valid").alias("n_judged"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return n.withColumn("rate", F.try_divide(F.col("n_invalid").cast("double"), F.col("n_judged").cast("double")))


def causes(texts: DataFrame) -> DataFrame:
    """Invalid files per language and first cause: language, first_cause, n_files."""
    return invalid_files(texts).groupBy("language", "first_cause").agg(F.count(F.lit(1)).alias("n_files"))
