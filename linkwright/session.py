"""Sessions: settings for tests and benches, and what Python workers need."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
_LOCAL: list[str] = []


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8, name: str = "linkwright") -> SparkSession:
    """A local session; on a cluster the submitter sets master, memory and partitions."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return workers_can_import(spark)


def workers_can_import(spark: SparkSession) -> SparkSession:
    """Puts this repository on the Python path of workers that share its folder; elsewhere the submitter ships it."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH") or ""
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a stage table where driver and executors both write: under ``spark.checkpoint.dir``, or else the warehouse.

    A local master that has neither set gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and master.startswith("local") and not master.startswith("local-cluster"):
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="linkwright-stages-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        root = Path(_LOCAL[0]).as_uri()
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/linkwright-stages/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, *by: str) -> str:
    """Writes ``df`` as a scratch table, with a folder for each value of ``by``; its path."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table: its lineage is cut, and what reads it several times computes it once."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected what made them; else they stay until it happens to."""
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def stored_files(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    """The Parquet files of a folder for tasks that read a scratch table themselves; none if it isn't there."""
    uri = re.sub(r"^file:/+", "file:///", path)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs, sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet"))
