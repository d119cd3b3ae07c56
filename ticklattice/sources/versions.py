"""Tables whose partitions are replaced as a whole, read as they were before or after a write and never in between.

    path/data/<partition columns>/_version=n/   rows of a partition as the n-th write left them
    path/manifests/n/                           for each partition the version that counts after n writes

A write puts new versions of the partitions it touches beside the old ones, then a new
manifest under another name, and renames that: from then on readers take it. A reader that
began before goes on with the files of its own manifest, which stay until vacuum().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import settled
from ..operators.quality import keep_last
from . import files


class Conflict(RuntimeError):
    """Another write has published this version first; the write can be tried again."""


def version(spark: SparkSession, path: str) -> int:
    """The number of the last write; 0 before any."""
    return max((int(n) for n in files.names(spark, f"{path}/manifests") if n.isdigit()), default=0)


def _same(left: DataFrame, right: DataFrame, parts: list[str]):
    test = F.lit(True)
    for c in parts:
        test = test & left[c].cast("string").eqNullSafe(right[c].cast("string"))
    return test


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of its last write, or of the one numbered (which vacuum() may have removed)."""
    n = version(spark, path) if number is None else number
    manifest = spark.read.parquet(f"{path}/manifests/{n}")
    data = spark.read.option("mergeSchema", True).parquet(f"{path}/data")
    parts = [c for c in manifest.columns if c != "_version"]
    # a row a partition: the join prunes folders, and Spark broadcasts it if it is small
    m = manifest.where("_version > 0")
    return data.join(m, _same(data, m, [*parts, "_version"]), "left_semi").drop("_version")


def upsert(rows: DataFrame, path: str, key: list[str], parts: list[str], order: str = "seq") -> int:
    """Puts rows in: of rows with equal key the last by `order` stays, in the table and among the new. `parts` are the columns
    that partition the table; a row's key never moves to another partition. Returns the version written."""
    spark = rows.sparkSession
    n = version(spark, path)
    new = settled(rows)
    touched = settled(new.select(*parts).distinct())
    both = new
    if n:
        old = read_version(spark, path)
        both = old.join(touched, _same(old, touched, parts), "left_semi").select(*[old[c] for c in old.columns]).unionByName(new, allowMissingColumns=True)
    keep_last(both, key, order).withColumn("_version", F.lit(n + 1)).write.mode("append").partitionBy(*parts, "_version").parquet(f"{path}/data")
    own = touched.withColumn("_version", F.lit(n + 1))
    if n:
        before = spark.read.parquet(f"{path}/manifests/{n}")
        own = before.join(touched, _same(before, touched, parts), "left_anti").unionByName(own)
    draft = f"{path}/manifests/draft-{uuid.uuid4().hex}"
    own.write.parquet(draft)
    if not files.moved(spark, draft, f"{path}/manifests/{n + 1}"):
        files.removed(spark, draft)
        raise Conflict(f"version {n + 1} of {path} is there already")
    return n + 1


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes manifests before the last. (Their data goes with the partitions' folders, by whoever owns the storage's lifetime
    rules; nothing reads it any more.)"""
    last = version(spark, path)
    for name in files.names(spark, f"{path}/manifests"):
        if name != str(last):
            files.removed(spark, f"{path}/manifests/{name}")
