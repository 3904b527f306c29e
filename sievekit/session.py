"""Session settings for local runs, and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", name: str = "sievekit") -> SparkSession:
    """A local session for tests, benches and the command line."""
    parts = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder path below ``spark.checkpoint.dir``, which all executors share; removed when the driver's Python ends.

    Where the session names none and runs locally (tests), a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    _made.append(f"{root.rstrip('/')}/sievekit-{uuid.uuid4().hex}")
    return _made[-1]


_OWNER = os.getpid()
_made: list[str] = []
_root: list[str] = []


def _local_root() -> str:
    if not _root:
        _root.append(tempfile.mkdtemp(prefix="sievekit-"))
        atexit.register(shutil.rmtree, _root[0], ignore_errors=True)
    return _root[0]


def file_system(uri: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if re.match("[a-z0-9]+:/", uri):
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/(?!/)", "file:///", uri)))
    return fs.LocalFileSystem(), uri


@atexit.register
def remove_written() -> None:
    """Removes the tables written so far; nothing that reads them may follow.  A forked process leaves those of its parent alone."""
    while _made and os.getpid() == _OWNER:
        try:
            system, path = file_system(_made.pop())
            system.delete_dir(path)
        except Exception:  # there is none, or Arrow doesn't know the file system
            continue


def written(df, by: str | None = None):
    """``df`` as a table written once to the shared folder and read back: cuts the lineage, so that a lost executor costs no
    recomputation of what led to it.  ``by``: a column whose values get folders of their own, for reading one alone."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df):
    """``df``, which must come right from a scan, over all cores where its few files would keep only some of them busy.

    For work in Python that costs far more than moving the rows; inputs of more partitions stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
