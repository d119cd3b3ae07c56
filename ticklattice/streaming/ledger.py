"""A stream into several sinks, each batch once in each: foreachBatch with a ledger of what is done.

Spark may run a batch again after a failure. Each sink's work on a batch is recorded when
it has ended, and skipped from then on; work that broke off before is done again, so a
sink writes a batch where doing it twice leaves it once (batch_folder() does).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import files


def batch_folder(path: str, kind: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch as a folder of its own, anew if it is there: path/batch=n."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(kind).save(f"{path}/batch={number}")

    return write


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]], ledger: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch takes: the batch is computed once and handed to each sink (by name) that the ledger (a folder of the
    query's own) does not have for it yet."""

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        left = [name for name in sinks if not files.exists(spark, f"{ledger}/{name}/{number}")]
        if not left:
            return
        kept = batch.persist()
        try:
            for name in left:
                sinks[name](kept, number)
                files.created(spark, f"{ledger}/{name}/{number}")
        finally:
            kept.unpersist()

    return each
