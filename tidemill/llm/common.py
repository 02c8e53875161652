"""Shared helpers: tables, unused column names, and tables written to the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these characters only (space and tab to carriage return).
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Bytes of an Arrow batch that goes to a Python worker; the row count alone would not bound batches of long texts.
BATCH_BYTES = 4 << 20
#: Rows that a Parquet reader decodes at once; texts are wide.
READ_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


#: What this process remembers to save time; forgotten at the end of every task.
CACHES: list[dict] = []


def release() -> None:
    """Empty this process's caches and give freed memory back to the system."""
    for c in CACHES:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which the worker forgets what it kept to save time: Spark keeps idle workers."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()  # a function of the module, so that it is the worker's caches that go

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows; one that is smaller than its readers could take at once, and lies in fewer files, is dealt out to them."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plan, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    small_enough = int(str(plan.optimizedPlan().stats().sizeInBytes())) < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if small_enough and len(df.inputFiles()) < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, whatever extra columns it brings."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session within one process gets a temporary one (tests); on a
    cluster there is no folder that all machines share, which is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of the tables written by this process that are still there.
_WRITTEN: dict[str, None] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: later reads don't depend on the executors that made it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    bound_batches(spark)
    _WRITTEN[path] = None
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    _WRITTEN.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written() -> list[str]:
    """The tables still there; what a result reads is among them until the result itself is written."""
    return list(_WRITTEN)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that no result reads any more."""
    for path in paths:
        discard(spark, path)


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint where the row count is within limit; df itself beyond it, for a shuffled join."""
    return F.broadcast(df) if small(df, limit) else df
