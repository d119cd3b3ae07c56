"""Joins in event time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_MS, around, chunk_of, latest, over_range, own_order


def as_of(left: DataFrame, right: DataFrame, take: list[str], tolerance_ms: int | None = None, prefix: str = "") -> DataFrame:
    """The latest row of right at or before each row of left, by symbol; with a tolerance, else null. right has one row for
    each (symbol, ts_ms). With a tolerance one shuffle, in chunks as long as it at least: rows of right near the end of a chunk of
    time are in the next one too. The last row so far is taken and dropped if it is too old, as Spark goes through all rows of a
    frame that moves at both ends."""
    row = F.struct("ts_ms", *take)
    if tolerance_ms is None:
        out = latest(left, right, row, "_q")
        return out.select(*left.columns, F.col("_q.ts_ms").alias(f"{prefix}ts"), *(F.col(f"_q.{c}").alias(f"{prefix}{c}") for c in take))
    width = max(CHUNK_MS, tolerance_ms)
    parts = F.sequence(chunk_of(width=width), F.expr(f"(ts_ms + {tolerance_ms}) div {width}"))
    r = right.where("ts_ms is not null").select("symbol", "ts_ms", F.explode(parts).alias("_chunk"), F.lit(0).alias("_s"), row.alias("_r"))
    both = left.select("symbol", "ts_ms", chunk_of(width=width).alias("_chunk"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l")).unionByName(r, allowMissingColumns=True)
    # at equal times rows of right come first
    last = F.last("_r", True).over(own_order("_s", "_r").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_q", last).where("_l is not null").withColumn("_q", F.when(F.col("ts_ms") - F.col("_q.ts_ms") <= tolerance_ms, F.col("_q")))
    return out.select("_l.*", F.col("_q.ts_ms").alias(f"{prefix}ts"), *(F.col(f"_q.{c}").alias(f"{prefix}{c}") for c in take))


def as_of_or_newest(left: DataFrame, right: DataFrame, take: list[str], tolerance_ms: int, prefix: str = "") -> DataFrame:
    """as_of without a tolerance, and alignment: strict within it, fallback beyond, none if there is no row yet."""
    out = as_of(left, right, take, None, prefix)
    at = F.col(f"{prefix}ts")
    return out.withColumn("alignment", F.when(at.isNull(), "none").when(F.col("ts_ms") - at <= tolerance_ms, "strict").otherwise("fallback"))


def nearest(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """The row of right nearest in time to each row of left, by symbol; ties go to the earlier one."""
    row = F.struct(F.col("ts_ms").alias("t"), F.col(value).cast("double").alias("v"))
    out = around(left.select("seq", "symbol", "ts_ms"), right, row, "_b", "_f")
    early = F.col("_f").isNull() | (F.col("ts_ms") - F.col("_b.t") <= F.col("_f.t") - F.col("ts_ms"))
    return out.select("seq", "symbol", "ts_ms", F.when(early, F.col("_b.v")).otherwise(F.col("_f.v")).alias(value))


def latest_states(events: DataFrame, first: Column, other: Column, values: list[str], max_lag_ms: int) -> DataFrame:
    """At each event the last row so far that meets `first`, and the last that meets `other` (structs _a, _b of ts_ms, seq and
    values), where both exist and their times are max_lag_ms apart at most. Events are ordered by (ts_ms, seq) and meet one
    of the two, so nothing older than max_lag_ms is needed."""
    row = F.struct("ts_ms", "seq", *values)
    both = events.withColumn("_x", F.when(first, row)).withColumn("_y", F.when(other, row))
    out = over_range(both, max_lag_ms, {"_a": lambda w: F.last("_x", True).over(w), "_b": lambda w: F.last("_y", True).over(w)}, order=("seq",))
    return out.where(F.abs(F.col("_a.ts_ms") - F.col("_b.ts_ms")) <= max_lag_ms).drop("_x", "_y")


def per_second(rows: DataFrame, values: list[str]) -> DataFrame:
    """The last row of each (symbol, second)."""
    last = F.max_by(F.struct(*values), F.struct("ts_ms", "seq")).alias("_v")
    return rows.groupBy("symbol", F.expr("ts_ms div 1000").alias("second")).agg(last).select("symbol", "second", "_v.*")


def filled_seconds(left: DataFrame, right: DataFrame, look_back: int) -> DataFrame:
    """Full outer join by (symbol, second); a missing side is filled from the last `look_back` seconds, else the row goes."""
    values = [c for c in (*left.columns, *right.columns) if c not in ("symbol", "second")]
    both = left.join(right, ["symbol", "second"], "full_outer").withColumn("ts_ms", F.col("second") * 1000)
    filled = over_range(both, look_back * 1000, {f"_{c}": (lambda w, c=c: F.last(c, True).over(w)) for c in values})
    return filled.select("symbol", "second", *(F.col(f"_{c}").alias(c) for c in values)).dropna(subset=values)


def joined_seconds(prices: DataFrame, *others: DataFrame) -> DataFrame:
    """Seconds that have a price, with the last values of the other streams in that second (null if none)."""
    for o in others:
        prices = prices.join(o, ["symbol", "second"], "left")
    return prices
