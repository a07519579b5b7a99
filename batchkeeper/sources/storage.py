"""The few file-system questions Spark's readers and writers leave open."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return handle.getFileSystem(conf), handle


def exists(spark: SparkSession, path: str) -> bool:
    fs, handle = _path(spark, path)
    return fs.exists(handle)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths that match a glob, sorted; empty when nothing does."""
    fs, handle = _path(spark, pattern)
    found = fs.globStatus(handle)
    return sorted(str(status.getPath().toString()) for status in found) if found else []


def drop_directory(spark: SparkSession, path: str) -> bool:
    fs, handle = _path(spark, path)
    return fs.delete(handle, True)
