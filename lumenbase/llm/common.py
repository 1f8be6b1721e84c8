"""What the training-data operators share: the shared folder, tables that cut lineage, row identity, readers of Arrow
batches, word hashes and where texts are cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = tuple(np.uint64(x) for x in (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31))
GRAM = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose driver and executors are
    one process, gets a folder of its own where that is unset; a cluster without it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lumenbase-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str, **options: str) -> None:
    """Write df as Parquet; the shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from the files, not from df's lineage."""
    path = fresh_path(df.sparkSession, name)
    write_once(df, path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


LEFT: dict[str, list[str]] = {}


def release_later(spark: SparkSession, path: str) -> None:
    """Note a path that a returned, lazy plan still reads; release() deletes it."""
    LEFT.setdefault(spark.sparkContext.applicationId, []).append(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that results of this application's operators read, once those results have been used; how many."""
    paths = LEFT.pop(spark.sparkContext.applicationId, [])
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """materialize() for a table that the returned result reads."""
    stored = materialize(df, name)
    release_later(df.sparkSession, stored.stored_at)
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in stored:
        jvm, at = df.sparkSession._jvm, df.stored_at
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mixed(h):
    """64-bit numbers of a numpy array, well mixed."""
    h = (h ^ (h >> MIX[0])) * MIX[1]
    h = (h ^ (h >> MIX[2])) * MIX[3]
    return h ^ (h >> MIX[4])


def word_hashes(text: bytes | None, seed: int = 0):
    """A 64-bit hash of each word, words being what stands between ASCII white space."""
    words = (text or b"").split()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words) if seed else map(digest, words), np.uint64, len(words))


def gram_hashes(h, n: int):
    """Of each n consecutive numbers, a hash."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mixed(out * GRAM + h[j : j + len(out)])
    return out


WORKER: dict[str, object] = {}


def worker_cache(name: str, make):
    """What a Python worker keeps from task to task, one thing at a time: asking for another drops it."""
    if name not in WORKER:
        WORKER.clear()
        WORKER[name] = make()
    return WORKER[name]


def forget_caches() -> None:
    """For tasks of operators that keep nothing."""
    WORKER.clear()


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads files, filters and projects: then each of its partitions comes out the same every time."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().split()[0] not in ("Project", "Filter", "LogicalRelation", "Relation"):
            return False
        below = node.children()
        nodes += [below.apply(k) for k in range(below.length())]
    return True


def input_bytes(df: DataFrame) -> int:
    """The estimated size of the files that df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [leaves.apply(k) for k in range(leaves.length())]
    return sum(int(str(x.stats().sizeInBytes())) for x in read if x.nodeName().split()[0] in ("LogicalRelation", "Relation"))


def partitions_for(df: DataFrame, each: int = 128 << 20) -> int:
    """How many partitions a shuffle of df should have: spark.sql.shuffle.partitions, or more where the size of the files that
    df reads, in whatever plan, asks for it, so that tasks stay alike as tables grow."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-input_bytes(df) // each), 200_000))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def each_id_once(rows: DataFrame, id_name: str, value_name: str) -> DataFrame:
    """Of repeated ids the smallest non-null value. A scan of the ids tells which are repeated; only their rows are grouped,
    all others stay in their partitions (unless more ids are repeated than can be broadcast)."""
    repeated = rows.groupBy(id_name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_name)
    if repeated.isEmpty():
        return rows
    ids = lasting(repeated, "repeated-ids")
    grouped = rows.join(ids, id_name, "left_semi").groupBy(id_name).agg(F.min(value_name).alias(value_name))
    return rows.join(ids, id_name, "left_anti").unionByName(grouped)


def keyed(df: DataFrame, id_col: str, value_col: str | Column, id_name: str = "doc_id", value_name: str = "text") -> DataFrame:
    """(id, value) with one row per non-null id (see each_id_once). Rows whose id is null have no identity and are left out."""
    bound_batches(df.sparkSession)
    value = F.col(value_col) if isinstance(value_col, str) else value_col
    return each_id_once(df.select(F.col(id_col).cast("long").alias(id_name), value.alias(value_name)).where(F.col(id_name).isNotNull()), id_name, value_name)


def utf8(df: DataFrame, value_name: str = "text") -> DataFrame:
    """The value as its UTF-8 bytes, null as null, so that Python reads bytes without decoding."""
    return df.withColumn(value_name, F.col(value_name).cast("binary"))


def pairs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of the first two columns."""
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")
OTHER_SPACE = re.compile(r"[^\S\x20\x09-\x0D]")
SPACE_BEFORE = re.compile(r"\s ")
SPACED = re.compile(r"(?<=\S) ")


def cut_spaced(text: str) -> list[str]:
    """Pieces that begin at a space after a non-space; they join to the text again. No token of a pattern that takes a
    leading space, or white space alone, reaches over such a place."""
    parts = SPACED.split(text) if SPACE_BEFORE.search(text) else text.split(" ")
    return [p for p in (parts[0], *[f" {p}" for p in parts[1:]]) if p]
