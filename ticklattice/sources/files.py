"""Small steps on the file system that a path names, whichever it is: what Spark reads and writes lies there too."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _of(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, p = _of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def moved(spark: SparkSession, old: str, new: str) -> bool:
    """Renames old to new, unless new is there."""
    fs, p = _of(spark, new)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    return fs.rename(spark._jvm.org.apache.hadoop.fs.Path(old), p)


def created(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if it was there."""
    fs, p = _of(spark, path)
    return fs.createNewFile(p)


def removed(spark: SparkSession, path: str) -> None:
    fs, p = _of(spark, path)
    fs.delete(p, True)
