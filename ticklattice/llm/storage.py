"""Shared-folder tables and small Arrow helpers used by the operators.

A table that several later jobs read is written once to the cluster's shared
checkpoint folder and read back, so that a lost executor costs only a re-read.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of our own, but only in a Spark of one machine:
    on a cluster no machine's own folder will do, and an error says so."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ticklattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave, once nothing that is still to be computed reads them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Cuts a batch into runs of rows whose texts in column have about `most` bytes together, one row at least."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(size):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(size):
        yield batch.slice(begin)
