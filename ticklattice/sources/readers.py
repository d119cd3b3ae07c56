"""Readers of partitioned trees, signals, features, prices and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clip
from . import read_json_lines, read_range, with_priority

FEATURES = "ts_ms long, symbol string, z_ofi double, z_cvd double, spread_bps double, lag_sec double, consistency double, warmup boolean, fusion_score double, mid double"


def read_tree(spark: SparkSession, root: str, kinds: list[str] | None = None, symbols: list[str] | None = None, dates: list[str] | None = None, tolerant: bool = False) -> DataFrame:
    """Parquet under date=/hour=/symbol=/kind= (any of these levels, in any order). Filters on partition columns prune folders;
    files of different schemas are merged; with `tolerant`, damaged files are left out."""
    r = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", tolerant).parquet(root)
    for c, values in (("kind", kinds), ("symbol", symbols), ("date", dates)):
        if values and c in r.columns:
            r = r.where(F.col(c).cast("string").isin(values))
    return r


def read_layouts(spark: SparkSession, roots: list[str], key: list[str], start_ms: int | None = None, end_ms: int | None = None, minutes: int | None = None, **pruned) -> DataFrame:
    """Several trees in order of priority (ready before preview) as one: of rows with equal key the first tree's stays. Times
    from start_ms to end_ms, or `minutes` from start_ms on (of each tree's own rows)."""
    if minutes is not None and start_ms is not None:
        end_ms = start_ms + minutes * 60_000
    # times are those of the rows, so what is outside is left out of each tree before rows are ranked, in the scan itself
    return with_priority([read_range(read_tree(spark, r, **pruned), start_ms, end_ms) for r in roots], key)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Feature files (a folder or a pattern) with the columns asked for only; start and end as in read_range, end exclusive."""
    f = spark.read.option("recursiveFileLookup", True).parquet(path)
    f = read_range(f, start_ms, end_ms, inclusive=False)
    return f.select(*columns) if columns else f


def read_signals(spark: SparkSession, uri: str, schema: str, symbols: list[str] | None = None, after_ms: int | None = None) -> DataFrame:
    """Signals from jsonl://folder (files signals*.jsonl in it and below) or sqlite://file (table signals, by JDBC, filters
    pushed; the driver's jar must be there); after_ms leaves out what an earlier run has seen. Of rows with equal (ts_ms,
    symbol, signal_type, score) one stays."""
    scheme, _, path = uri.partition("://")
    if scheme == "jsonl":
        s = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "signals*.jsonl").json(path)
    elif scheme == "sqlite":
        s = spark.read.format("jdbc").option("url", f"jdbc:sqlite:{path}").option("dbtable", "signals").load()
    else:
        raise ValueError(f"no reader for {uri}")
    if after_ms is not None:
        s = s.where(F.col("ts_ms") > after_ms)
    s = s.where(F.col("symbol").isin(symbols)) if symbols else s
    same = [c for c in ("ts_ms", "symbol", "signal_type", "score") if c in s.columns]
    if scheme == "jsonl":  # of equal rows the first by file and line stays
        s = s.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
        return s.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("_file", "_at"))).where("_n = 1").drop("_file", "_at", "_n")
    return s.dropDuplicates(same)


def read_prices(spark: SparkSession, path: str, layout: str = "preview") -> DataFrame:
    """symbol, ts_ms, price: from preview (Parquet) or ready (JSON lines) files, the first price column that is not null."""
    if layout == "preview":
        p = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    else:
        p = read_json_lines(spark, path, "ts_ms long, symbol string, mid_px double, mid double, price double")
    return p.select("symbol", "ts_ms", F.coalesce(*(F.col(c) for c in ("mid_px", "mid", "price") if c in p.columns)).alias("price")).where("price is not null")


def feature_rows(rows: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """Feature rows under one set of names: ofi_z, cvd_z and the like renamed, lag_sec from lag_ms columns, consistency (if it is
    missing) from the sum of both z, warmup where a z is missing, spread from the quotes over the bid."""
    names = {"ofi_z": "z_ofi", "cvd_z": "z_cvd", "score": "fusion_score", "second_ts": "second"} | (renamed or {})
    for a, b in names.items():
        if a in rows.columns and b not in rows.columns:
            rows = rows.withColumnRenamed(a, b)
    has = rows.columns
    if "lag_sec" not in has:
        lags = [F.col(c) for c in ("lag_ms_price", "lag_ms_orderbook") if c in has]
        rows = rows.withColumn("lag_sec", (F.greatest(*lags) if len(lags) > 1 else lags[0] if lags else F.lit(0.0)) / 1000)
    if "consistency" not in has:
        rows = rows.withColumn("consistency", F.least(F.lit(0.6), F.greatest(F.lit(0.0), (F.abs("z_ofi") + F.abs("z_cvd")) * 0.15)))
    if "warmup" not in has:
        rows = rows.withColumn("warmup", F.col("z_ofi").isNull() | F.col("z_cvd").isNull())
    if "spread_bps" not in has and {"best_bid", "best_ask"} <= set(has):
        rows = rows.withColumn("spread_bps", F.when(F.col("best_bid") > 0, (F.col("best_ask") - F.col("best_bid")) / F.col("best_bid") * 1e4))
    return rows


def parsed_books(messages: DataFrame, levels: int = 5) -> DataFrame:
    """Order-book messages (column text: JSON with s, E, b and a, lists of [price, qty] as texts) as symbol, ts_ms, bids and asks:
    sorted, numbers that are none or below 0 count as 0, padded with (0, 0) to `levels`. bad: a price or quantity was amended."""
    m = messages.select(F.from_json("text", "s string, E long, b array<array<string>>, a array<array<string>>").alias("m")).where("m.s is not null").select("m.*")
    number = lambda x: F.coalesce(F.when(F.isnan(x.try_cast("double")) | (F.abs(x.try_cast("double")) == float("inf")), None).otherwise(x.try_cast("double")), F.lit(0.0))

    def side(c: str, down: bool) -> Column:
        pairs = F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda x: F.struct(F.greatest(number(F.get(x, 0)), F.lit(0.0)).alias("price"), F.greatest(number(F.get(x, 1)), F.lit(0.0)).alias("qty")))
        pairs = F.reverse(F.array_sort(pairs)) if down else F.array_sort(pairs)
        return F.slice(F.concat(pairs, F.array_repeat(F.struct(F.lit(0.0).alias("price"), F.lit(0.0).alias("qty")), levels)), 1, levels)

    wrong = lambda c: F.exists(F.coalesce(c, F.array().cast("array<array<string>>")), lambda x: ~F.coalesce((F.get(x, 0).try_cast("double") > 0) & (F.get(x, 1).try_cast("double") >= 0), F.lit(False)))
    return m.select(F.col("s").alias("symbol"), F.col("E").alias("ts_ms"), side("b", True).alias("bids"), side("a", False).alias("asks"), (wrong("b") | wrong("a")).alias("bad"))


def parsed_trades(messages: DataFrame) -> DataFrame:
    """Exchange trade messages (column text) as symbol, ts_ms (trade time, else event time), recv delay, price, qty, side: the
    buyer being the maker means a sell."""
    m = messages.select(F.from_json("text", "s string, E long, T long, a long, p string, q string, m boolean").alias("m")).where("m.s is not null").select("m.*")
    at = F.coalesce("T", "E")
    return m.select(F.col("s").alias("symbol"), at.alias("ts_ms"), F.col("a").alias("seq"), F.col("p").try_cast("double").alias("price"), F.col("q").try_cast("double").alias("qty"), F.when(F.col("m"), "sell").otherwise("buy").alias("side"), F.greatest(F.lit(0).cast("long"), F.col("E") - at).alias("latency_ms"))


def preview_features(rows: DataFrame) -> DataFrame:
    """Preview rows as feature rows: missing lag, consistency and scores are 0, z clipped to 5, names as in feature_rows."""
    out = feature_rows(rows)
    for c in ("lag_sec", "consistency", "fusion_score"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)) if c in out.columns else F.lit(0.0))
    return out.withColumns({c: clip(F.col(c), 5.0) for c in ("z_ofi", "z_cvd")})


def read_times(spark: SparkSession, path: str, column: str = "ts_ms") -> DataFrame:
    """ts_ms of CSV files with a header; what is no number goes."""
    t = spark.read.option("header", True).csv(path)
    return t.select(F.col(column).try_cast("long").alias("ts_ms")).where("ts_ms is not null")


def with_warm_up(rows: DataFrame, start_ms: int, minutes: int, compute) -> DataFrame:
    """compute(rows from `minutes` before start_ms on), and of its result the rows from start_ms on."""
    return compute(rows.where(F.col("ts_ms") >= start_ms - minutes * 60_000)).where(F.col("ts_ms") >= start_ms)


def required_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, present (the column exists) and missing (its nulls)."""
    n = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) if c in rows.columns else F.lit(None).cast("long").alias(c) for c in fields))
    return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(c in rows.columns).alias("present"), F.col(c).alias("missing")) for c in fields))).alias("x")).select("x.*")


def log_metrics(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """metric, most (largest number that its pattern's first group finds) and hits, over all lines (column value)."""
    parts = [lines.select(F.lit(name).alias("metric"), F.explode(F.regexp_extract_all("value", F.lit(p))).alias("x")) for name, p in patterns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("metric").agg(F.max(F.col("x").try_cast("double")).alias("most"), F.count("*").alias("hits"))


def changed_parameters(old: DataFrame, new: DataFrame, allowed: list[str], most: int = 10) -> DataFrame:
    """The first `most` parameters (name, value) in both tables, by name, that are allowed and differ."""
    j = old.select("name", F.col("value").alias("old")).join(new.select("name", F.col("value").alias("new")), "name")
    return j.where(F.col("name").isin(allowed) & ~F.col("old").eqNullSafe(F.col("new"))).orderBy("name").limit(most)


def counted(rows: DataFrame, name: str, fields: list[str], symbols: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> tuple[DataFrame, Observation]:
    """The rows of the symbols and times asked for (end included), and what is seen on the way, in the same pass: total, kept,
    expected (kept ones with all fields), missing_<field>, first_ms, last_ms of kept rows. The numbers are there once an action
    has read the rows: observation.get."""
    keep = F.lit(True)
    if symbols:
        keep = keep & F.col("symbol").isin(symbols)
    if start_ms is not None:
        keep = keep & (F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        keep = keep & (F.col("ts_ms") <= end_ms)
    keep = F.coalesce(keep, F.lit(False))
    has = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    whole = reduce(lambda a, b: a & b, map(has, fields), F.lit(True))
    seen = Observation(name)
    at = F.when(keep, F.col("ts_ms"))
    out = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("kept"), F.count_if(keep & whole).alias("expected"), *(F.count_if(keep & ~has(c)).alias(f"missing_{c}") for c in fields), F.min(at).alias("first_ms"), F.max(at).alias("last_ms"))
    return out.where(keep), seen
