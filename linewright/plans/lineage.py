"""Cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: dict[str, str] = {}
_written: dict[str, list[str]] = {}
#: Rows of a file, where a table's rows are known; parts for each core at least.
FILE_ROWS, CORE_PARTS = 50_000, 2


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset in a session of one process, a local one, set for checkpoint() too.

    On a cluster a local folder would be another one for each executor, so the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            found = existing.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = os.path.join(tempfile.gettempdir(), "linewright-checkpoints")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of a query go when it ends, as its result is on shared disk; otherwise they stay until a collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def in_few_files(df: DataFrame, rows: int | None, each: int = FILE_ROWS) -> DataFrame:
    """df in a part for each so many rows, and no fewer than keep all cores busy, however many partitions its shuffles have.

    rows: about how many there are at most (None: unknown, df as it is). All rows stay; a local file system starts two
    processes for each file that is written, and a store asks for as many requests.
    """
    if rows is None:
        return df
    return df.coalesce(max(CORE_PARTS * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


class Table:
    """A DataFrame written as Parquet in the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/linewright-{name}-{uuid.uuid4().hex}"
        with _shuffles_removed(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        app = self.spark.sparkContext.applicationId
        if app not in _written:
            _written[app] = []
            atexit.register(_sweep, self.spark, app)
        _written[app].append(self.path)

    def drop(self) -> None:
        """Delete the files; call it only once nothing lazy reads them any more."""
        _delete(self.spark, self.path)
        _written[self.spark.sparkContext.applicationId].remove(self.path)


def _sweep(spark: SparkSession, app: str) -> None:
    for path in _written.pop(app, []):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit; files then stay until the folder is cleaned
            return


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables of this application that are still there; call it between queries, once their results are no longer read."""
    app = spark.sparkContext.applicationId
    for path in _written.get(app, [])[:]:
        _delete(spark, path)
        _written[app].remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="linewright-")
    path = os.path.join(folder, "linewright_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(_ROOT):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path
    atexit.register(shutil.rmtree, folder, True)
