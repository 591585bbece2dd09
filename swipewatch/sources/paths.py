"""Paths every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session on one machine (a test) gets a temporary folder as its
    checkpoint folder. On a cluster that is an error: no folder of one machine would do.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="swipewatch-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; what is there goes when the session ends."""
    root = f"{shared_folder(spark)}/swipewatch-{spark.sparkContext.applicationId}"
    folder, fs = _hadoop(spark, root)
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or glob matches, on whatever file system the path names."""
    hadoop, fs = _hadoop(spark, path)
    found = fs.globStatus(hadoop)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package has written; nothing happens if it is not there."""
    hadoop, fs = _hadoop(spark, path)
    fs.delete(hadoop, True)


def folders(spark: SparkSession, path: str) -> list:
    """Names of the folders directly under ``path``; none if it does not exist."""
    hadoop, fs = _hadoop(spark, path)
    if not fs.exists(hadoop):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop) if f.isDirectory())
