"""Writers: partitioned Parquet behind a quality gate, JSON lines, reports. Spark's commit protocol makes each write whole."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import settled
from ..operators.quality import cleaned, gate, keep_last
from ..operators.reports import markdown
from . import files


def partitioned(rows: DataFrame, kind: str) -> DataFrame:
    """Adds date, hour and kind; symbol is there."""
    at = F.timestamp_millis("ts_ms")
    return rows.withColumn("date", F.date_format(at, "yyyy-MM-dd")).withColumn("hour", F.date_format(at, "HH")).withColumn("kind", F.lit(kind))


def write_checked(rows: DataFrame, path: str, kind: str, required: list[str], rules: list[tuple[Column, str]], numbers: list[str], row_id: str = "row_id", most_rows: int = 50_000) -> DataFrame:
    """Keeps the last row of each id, cleans numbers, writes good rows under path/ready and bad ones (with reasons) under
    path/deadletter, both by date, hour, symbol and kind; rows are computed once for both. Gives the manifest of this write's
    files: file, rows, first and last ts_ms."""
    spark = rows.sparkSession
    ok, bad, _ = gate(cleaned(keep_last(settled(rows), [row_id]), numbers), required, [row_id], ["seq"], rules)
    folders = ("date", "hour", "symbol", "kind")
    ready = f"{path}/ready"
    before = set(spark.read.parquet(ready).inputFiles()) if any(not n.startswith("_") for n in files.names(spark, ready)) else set()
    partitioned(ok, kind).write.partitionBy(*folders).option("maxRecordsPerFile", most_rows).mode("append").parquet(ready)
    partitioned(bad, kind).write.partitionBy(*folders).mode("append").json(f"{path}/deadletter")
    written = spark.read.schema(partitioned(ok, kind).schema).option("basePath", ready)
    own = [f for f in spark.read.parquet(ready).inputFiles() if f not in before] if any(not n.startswith("_") for n in files.names(spark, ready)) else []
    table = written.parquet(*own) if own else written.parquet(ready).limit(0)
    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def write_signals(signals: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines by symbol and UTC hour, columns in the order of signals."""
    signals.withColumn("hour", F.date_format(F.timestamp_millis("ts_ms"), "yyyyMMdd-HH")).write.partitionBy("symbol", "hour").mode(mode).json(path)


def fan_out(rows: DataFrame, *sinks) -> None:
    """Hands the same rows to every sink in turn, computed once."""
    kept = rows.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()


def write_confirmed(signals: DataFrame, path: str) -> None:
    """Confirmed signals only, by symbol."""
    signals.where("confirm").write.partitionBy("symbol").mode("overwrite").json(path)


def write_backtest(path: str, signals: DataFrame, trades: DataFrame, days: DataFrame, settings: dict) -> dict:
    """signals, trades and pnl_daily as JSON, and a manifest of their counts with a hash of the settings."""
    counts = {}
    for name, df in (("signals", signals), ("trades", trades), ("pnl_daily", days)):
        df.write.mode("overwrite").json(f"{path}/{name}")
        counts[name] = df.sparkSession.read.json(f"{path}/{name}").count()
    text = json.dumps(settings, sort_keys=True)
    manifest = signals.sparkSession.range(1).select(F.lit(text).alias("settings"), F.substring(F.sha1(F.lit(text)), 1, 12).alias("config_hash"), *(F.lit(n).alias(c) for c, n in counts.items()))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest.first().asDict()


def write_report(path: str, tables: dict[str, DataFrame]) -> str:
    """Each table (of a report's size: see markdown) as one CSV and one JSON file under path/<name>; the text of all as Markdown."""
    parts = []
    for name, df in tables.items():
        parts.append(markdown(df, name))
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}/csv")
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}/json")
    return "\n".join(parts)


def write_trace(trades: DataFrame, signals: DataFrame, path: str) -> None:
    """CSV of trades with the signal (symbol, ts_ms) that they followed."""
    trades.join(signals, ["symbol", "ts_ms"], "left").write.mode("overwrite").option("header", True).csv(path)


def logged(rows: DataFrame, rejected: Column, key: Column, share: float) -> DataFrame:
    """All rejected rows and a share of the others, by a hash of the key."""
    from ..functions.rules import uniform

    return rows.where(rejected | (uniform(key) < share))
