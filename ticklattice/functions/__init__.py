"""Column functions: formulas of prices, scores and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    m = mid(bid, ask)
    return F.when(m > 0, (ask - bid) / m * 1e4).otherwise(0.0)


def return_bps(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before * 1e4)


def clip(x: Column, limit: float) -> Column:
    """x between -limit and limit; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def squash(x: Column) -> Column:
    return F.tanh(x / 3) * 5


def consistency(a: Column, b: Column) -> Column:
    """Ratio of the smaller to the larger magnitude; 0 if either is next to 0 or the signs differ."""
    small, large = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    return F.when((small < 1e-9) | (F.signum(a) != F.signum(b)), 0.0).otherwise(small / large)


def session_label(hour: Column) -> Column:
    return F.when(hour < 8, "Tokyo").when(hour < 16, "London").otherwise("NY")


def regime(tps: Column) -> Column:
    return F.when(tps.isNull(), "normal").when(tps >= 3, "active").when(tps >= 1, "normal").otherwise("quiet")


def rounded(x: Column) -> Column:
    return F.round(x, 6)


def nearest_rank(values: Column, q: float) -> Column:
    """Element int(n * q) of the sorted values."""
    at = F.least(F.floor(F.size(values) * F.lit(q)), F.size(values) - 1)
    return F.element_at(F.array_sort(values), (at + 1).cast("int"))


def business_date(ts_ms: Column, zone: str = "UTC", rollover_hours: int = 0) -> Column:
    """The date in a time zone of days that begin rollover_hours after midnight, as yyyy-MM-dd."""
    local = F.from_utc_timestamp(F.timestamp_millis(ts_ms - rollover_hours * 3_600_000), zone)
    return F.date_format(local, "yyyy-MM-dd")


def nearest_rank_of(values, value: str, q: float, *keys: str):
    """keys and the element int(n * q) of their sorted values, from counts of equal values: no list of a key's values."""
    from pyspark.sql import Window

    by = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    up = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    s = by.withColumn("_to", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(w))
    at = F.least(F.floor(F.col("_all") * F.lit(q)), F.col("_all") - 1)
    return s.where(F.col("_to") > at).groupBy(*keys).agg(F.min(value).alias(value))
