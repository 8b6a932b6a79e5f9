"""Tables of a folder, and the folder that executors and driver share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and its path there; one of a scheme that Arrow doesn't know is an error."""
    plain = re.sub(r"^file:(//)?(?=/)", "", folder)
    return pafs.FileSystem.from_uri(plain) if "://" in plain else (pafs.LocalFileSystem(), os.path.abspath(plain))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, a temporary folder is set.

    Elsewhere it must be set: a machine's own folder isn't seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/") + "/kindred"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: used many times, computed once, and its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote for these tables, which nothing may read any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system: workers wait between tasks with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
