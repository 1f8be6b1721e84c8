"""Tables in the folder that driver and executors share: results that several steps read, and indexes kept for a session.

A table that kept() writes belongs to the innermost scope() of its thread, and goes when that scope ends; outside of any scope
it stays until release()."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

KEPT: dict[str, list[str]] = {}
BUILT: dict[tuple[str, str, str], str] = {}
SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, whose executors are the driver itself, gets a folder of its own where that
    is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lumenbase-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, paths: Iterable[str]) -> int:
    count = 0
    for each in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(each)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        count += 1
    return count


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What kept() writes within goes at the end; results have to be used within."""
    mine: list[str] = []
    before = SCOPE.set(mine)
    try:
        yield
    finally:
        SCOPE.reset(before)
        delete(spark, mine)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there goes with the scope, or with release()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    mine = SCOPE.get()
    (KEPT.setdefault(spark.sparkContext.applicationId, []) if mine is None else mine).append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, so that the steps after it don't compute it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, paths: Iterable[str]) -> Iterator:
    """The status of each file at the paths."""
    for each in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(each)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while files.hasNext():
            yield files.next()


def bytes_of(spark: SparkSession, paths: Iterable[str]) -> int:
    return sum(f.getLen() for f in files_of(spark, paths))


def state_of(spark: SparkSession, paths: Iterable[str]) -> str:
    """Names, lengths and times of the files at the paths: another state is another table."""
    return "\n".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files_of(spark, paths)))


def built_once(spark: SparkSession, name: str, sources: Iterable[str], build: Callable[[str], None]) -> str:
    """The path of what build(path) writes, written at the first call of this application, and again when the files of the
    sources have changed. No scope deletes it."""
    key = spark.sparkContext.applicationId, name, state_of(spark, sources)
    if key not in BUILT:
        path = f"{shared_dir(spark)}/built-{uuid.uuid4().hex}"
        outer = SCOPE.set(None)
        try:
            build(path)
        finally:
            SCOPE.reset(outer)
        BUILT[key] = path
    return BUILT[key]


def release(spark: SparkSession, built: bool = False) -> int:
    """Delete what kept() wrote for this application outside of scopes, and with `built` the tables of built_once() too; how
    many."""
    app = spark.sparkContext.applicationId
    paths = KEPT.pop(app, [])
    for key in [k for k in BUILT if built and k[0] == app]:
        paths.append(BUILT.pop(key))
    return delete(spark, paths)
