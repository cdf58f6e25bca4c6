"""Session helpers: table access and materialisation into the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application that every executor can read and write.

    It lies in the one that ``spark.checkpoint.dir`` names. Where that is unset
    a local master gets a temporary folder; a cluster gets an error, as a
    machine-local folder would lose data there. The folder is removed when the
    driver ends.
    """
    named, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if named:
        at = f"{named.rstrip('/')}/graphloom-{app}"
    elif spark.sparkContext.master.startswith("local"):
        own = os.path.join(tempfile.gettempdir(), f"graphloom-{os.getuid()}", app)
        os.makedirs(own, exist_ok=True)
        at = "file://" + own
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if at not in _folders:
        _folders.add(at)
        atexit.register(_quietly, *_located(spark.sparkContext, at))
    return at


_folders: set[str] = set()
_scopes: list[list[str]] = []


def _located(sc, at: str):
    """The file system of a path, and the path, as the JVM has them."""
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def delete(sc, at: str) -> None:
    """Delete a folder on any file system that Spark can reach."""
    fs, path = _located(sc, at)
    fs.delete(path, True)


def exists(spark: SparkSession, at: str) -> bool:
    """Whether a path is there on any file system that Spark can reach."""
    fs, path = _located(spark.sparkContext, at)
    return fs.exists(path)


def _quietly(fs, path) -> None:
    """Delete at the end of the driver; the session may have been stopped before, and the JVM may be gone."""
    try:
        fs.delete(path, True)
    except Exception:
        pass


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has; an open :func:`scratch` deletes what is written there."""
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(at)
    return at


def cut(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    Unlike a block-manager checkpoint the copy survives lost executors, and as
    Parquet it is compressed and can be read by column. ``n_rows`` of the
    result is the number of rows, and ``n_where`` that of the rows that meet
    the condition, both counted while writing.
    """
    at, seen = fresh(df.sparkSession), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.lit(True) if where is None else where).alias("w")).write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.cut_at, out.n_rows, out.n_where = at, seen.get.get("n", 0), seen.get.get("w", 0)
    return out


SMALL = 100_000  # rows of short columns that are sent to every task


def small(df: DataFrame) -> DataFrame:
    """What :func:`cut` returned, to be broadcast if it was counted to be small; else Spark's own choice."""
    return F.broadcast(df) if df.n_rows <= SMALL else df


def drop(df: DataFrame) -> None:
    """Delete the table behind what :func:`cut` returned; for rounds whose successor is written."""
    at = getattr(df, "cut_at", None)
    if at is not None:
        delete(df.sparkSession.sparkContext, at)
        for scope in _scopes:
            if at in scope:
                scope.remove(at)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that were cut inside; ``keep`` of what it gives hands one on to the scope around it."""
    own: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df.cut_at)
        if len(_scopes) > 1:
            _scopes[-2].append(df.cut_at)
        return df

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
        for at in own:
            delete(spark.sparkContext, at)


class Folder:
    """Small text files of a folder on any file system that Spark can reach, published by atomic rename."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.path.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.gateway = spark.sparkContext._gateway

    def _at(self, name: str):
        return self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(self.path, name))

    def names(self) -> list[str]:
        """Names of the published files, sorted."""
        if not self.fs.exists(self.path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self.path)) if not n.startswith("."))

    def read(self, name: str) -> str | None:
        """The text of a file; None if there is none of that name."""
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str, replace: bool = False) -> None:
        """Makes a file visible as a whole; FileExistsError if its name is taken and ``replace`` is false."""
        staged = self._at(f".staged-{uuid.uuid4().hex}")
        stream = self.fs.create(staged, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            self.context.rename(staged, self._at(name), how)
        except Py4JJavaError as e:
            self.fs.delete(staged, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise FileExistsError(name) from None
            raise
