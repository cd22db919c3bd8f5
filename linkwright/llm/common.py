"""Shared helpers of the training-data operators: scratch tables, Python path, small row utilities."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time by the Arrow kernels, in bytes: bounds a worker's memory whatever the row size.
CHUNK_BYTES = 4 << 20
#: Bytes of one Arrow batch between the JVM and Python.
ARROW_BYTES = str(8 << 20)
_LOCAL_SCRATCH: list[str] = []
_DROPPED_AT_EXIT: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and bounds the bytes of an Arrow batch."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in (env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if p]
    if root not in os.pathsep.join(known).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [env.get("PYTHONPATH")])])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder and a cluster the warehouse,
    which is shared as well.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if not _LOCAL_SCRATCH:
            folder = tempfile.mkdtemp(prefix="linkwright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL_SCRATCH.append(Path(folder).as_uri())
        root = _LOCAL_SCRATCH[0]
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_folder(spark: SparkSession) -> str:
    """Where all scratch tables and archives of this application are; they go when its driver ends."""
    folder = f"{scratch_root(spark)}/linkwright-{spark.sparkContext.applicationId}"
    if folder not in _DROPPED_AT_EXIT:
        _DROPPED_AT_EXIT.add(folder)
        atexit.register(_drop_at_exit, spark, folder)
    return folder


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session hasn't been stopped
        with contextlib.suppress(Py4JError, OSError):
            delete_path(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what the operators of this application stored; their results must have been written before."""
    delete_path(spark, scratch_folder(spark))


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a table of ``materialise`` that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Returns what the driver's Python has freed to the system; fits and collected tables leave much of it behind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows evenly to at least as many tasks as there are cores, where the scan made fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Index ranges of at most ``limit`` bytes of text each, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
