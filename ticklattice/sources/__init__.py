"""Readers, and the views that bring the driver's tables into event-time shapes."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under path and its folders; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def read_range(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None, symbols: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Rows from start_ms to end_ms (which is in the range unless inclusive is false) of the symbols asked for."""
    if start_ms is not None:
        df = df.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("ts_ms") <= end_ms if inclusive else F.col("ts_ms") < end_ms)
    return df.where(F.col("symbol").isin(symbols)) if symbols else df


def with_priority(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of sources in order of priority; of rows with equal keys the first source's stays."""
    ranked = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)]
    both = ranked[0]
    for p in ranked[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_rank"))).where("_n = 1").drop("_rank", "_n")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    k = F.get_json_object("props", "$.k").cast("long")
    src = F.when(F.col("event_type").isin("view", "click"), "book").otherwise("trade")
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "sell")
    rows = table(spark, sf_dir, "events").withColumn("ms", ms)
    return rows.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
        F.expr("1704067200000 + (ms - 1704067200000) div 100").alias("ts_ms"), src.alias("src"), (F.lit(100.0) + F.col("value") / 10.0).alias("price"), k.alias("k"), (k + 1).cast("double").alias("qty"), side.alias("side"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).where("src = 'trade'").select("seq", "symbol", "ts_ms", "price", "qty", "side")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, the last of each (symbol, ts_ms)."""
    k, px = F.col("k"), F.col("price")
    b = tape(spark, sf_dir).where("src = 'book'").select(
        "seq", "symbol", "ts_ms", (px - (k % 7 + 1) * 0.01).alias("best_bid"), (px + (k % 5 + 1) * 0.01).alias("best_ask"),
        *((k % m + 1).cast("double").alias(n) for m, n in ((11, "bid1_q"), (13, "ask1_q"), (3, "bid2_q"), (4, "ask2_q"))),
    )
    last = Window.partitionBy("symbol", "ts_ms").orderBy(F.desc("seq"))
    return b.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").cast("string")
    day = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000")
    key = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), cents, day.cast("string")))
    side = F.when(F.col("l_returnflag") == "R", "sell").when(F.col("l_returnflag") == "A", "buy").when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("fill_id"), F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string")).alias("symbol"),
        (day + (F.col("l_orderkey") * 10 + F.col("l_linenumber")) % 86400000).alias("ts_ms"), side.alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").cast("double").alias("qty"),
        (F.col("l_tax") * 100.0).alias("fee_bps"), (F.col("l_discount") * 100.0).alias("slippage_bps"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.concat(F.lit("C"), (F.col("o_custkey") % 6).cast("string")).alias("symbol"),
        (F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000") + (key % 86400) * 1000).alias("ts_ms"),
        (((key * 37) % 200 - 100) / F.lit(50.0)).alias("score"), (((key * 53) % 600 - 300) / F.lit(100.0)).alias("z_ofi"), (((key * 71) % 500 - 250) / F.lit(100.0)).alias("z_cvd"),
        ((key * 13) % 30).cast("double").alias("spread_bps"), (((key * 17) % 50) / F.lit(10.0)).alias("lag_sec"), (key % 50 == 0).alias("warmup"),
    )
