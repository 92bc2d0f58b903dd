"""Commits on any Hadoop file system: write aside, then rename once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = place(spark, path)
    return fs.exists(p)


def aside(root: str) -> str:
    """A new hidden place below root; readers pass over names that begin with a dot."""
    return f"{root.rstrip('/')}/.aside-{uuid.uuid4().hex}"


def rename_once(spark: SparkSession, source: str, path: str) -> bool:
    """Move a folder or file to a place that is free. False, and source is deleted, where the place is taken: it is neither replaced nor moved into."""
    (a, fs), b = place(spark, source), place(spark, path)[0]
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:  # py4j wraps the file system's own error
        if not fs.exists(b) or not fs.exists(a):
            raise
        fs.delete(a, True)
        return False
    return True
