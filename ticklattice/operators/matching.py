"""Pairing and reconciling: entries with exits, tables with tables, events with signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import BLOCK, numbered, with_previous

#: Kinds of events that linked() takes; each is a copy of the signals.
KINDS = 64


def paired(trades: DataFrame, entry: Column) -> DataFrame:
    """Each exit with the last entry of its symbol and side that no exit before it took: entry_ms, hold_s. trades: symbol, side
    (of the position), ts_ms, seq. An entry is open until the next entry or exit of the symbol and side."""
    key = F.concat_ws("\x00", F.coalesce("side", F.lit("")), "symbol")
    t = trades.withColumn("_entry", entry).withColumn("_of", F.col("symbol")).withColumn("symbol", key)
    t = with_previous(t, ["_entry", "ts_ms"]).withColumn("symbol", F.col("_of")).where(~F.col("_entry") & F.col("_prev._entry"))
    return t.withColumn("entry_ms", F.col("_prev.ts_ms")).withColumn("hold_s", (F.col("ts_ms") - F.col("_prev.ts_ms")) / 1000).select(*trades.columns, "entry_ms", "hold_s")


def reconciled(left: DataFrame, right: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Full outer join by key: status (both, left_only, right_only) and differs (the names of compared columns that are unequal)."""
    a = left.select(*key, F.struct(*compare).alias("_a"))
    b = right.select(*key, F.struct(*compare).alias("_b"))
    j = a.join(b, key, "full_outer")
    status = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in compare)))
    return j.select(*key, status.alias("status"), F.when(status == "both", differs).otherwise(F.array().cast("array<string>")).alias("differs"))


def parity(reconciled_rows: DataFrame) -> DataFrame:
    """Counts by status, their share, and an overall label: full, partial, no_overlap or empty."""
    n = reconciled_rows.agg(F.count_if(F.col("status") == "both").alias("both"), F.count_if(F.col("status") == "left_only").alias("left_only"), F.count_if(F.col("status") == "right_only").alias("right_only"), F.count_if(F.size("differs") > 0).alias("different"))
    total = F.col("both") + F.col("left_only") + F.col("right_only")
    label = F.when(total == 0, "empty").when(F.col("both") == 0, "no_overlap").when(F.col("both") == total, "full").otherwise("partial")
    return n.withColumn("parity", F.try_divide("both", total)).withColumn("overlap", label)


def not_yet_done(requests: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Requests whose key has not been executed."""
    return requests.join(done.select(*key).distinct(), key, "left_anti")


def compared_fills(left: DataFrame, right: DataFrame, order: list[str], values: list[str], eps: float) -> DataFrame:
    """The i-th fill of each symbol in both lists, in that order: missing (left, right or null) and the largest difference, and
    whether it is at most eps. The first column of the order is a whole number (a time, a sequence)."""
    at = lambda x: numbered(x.withColumn("ts_ms", F.col(order[0]).cast("long")), "i", tuple(order[1:]), BLOCK)
    a, b = (at(x).select("symbol", "i", F.struct(*values).alias(n)) for x, n in ((left, "_a"), (right, "_b")))
    j = a.join(b, ["symbol", "i"], "full_outer")
    diff = F.greatest(*(F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) for c in values), F.lit(0.0))
    missing = F.when(F.col("_a").isNull(), "left").when(F.col("_b").isNull(), "right")
    return j.select("symbol", "i", missing.alias("missing"), F.when(missing.isNull(), diff).alias("difference"), (missing.isNull() & (diff <= eps)).alias("equal"))


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], defaults: dict[str, object], most_rows: int = 100_000) -> DataFrame:
    """rows with a small dimension table's columns; defaults where it has no row. The table is broadcast if a count shows that
    it has most_rows at most, else joined by key."""
    small = table.limit(most_rows + 1).count() <= most_rows
    j = rows.join(F.broadcast(table) if small else table, key, "left")
    for c, v in defaults.items():
        j = j.withColumn(c, F.coalesce(c, F.lit(v)))
    return j


def linked(events: DataFrame, signals: DataFrame, after_ms: int) -> DataFrame:
    """For each event kind: signals that come within after_ms after an event of their symbol (or with it), the confirmed ones
    of all, and the confirm rate inside and outside. Events: symbol, ts_ms, kind (KINDS at most: names of rules); signals:
    symbol, ts_ms, seq, confirm. No events, no rows."""
    from .alignment import as_of

    none = signals.sparkSession.createDataFrame([], "kind string, inside boolean, signals long, confirmed long, rate double")
    kinds = [r["kind"] for r in events.select("kind").distinct().orderBy("kind").limit(KINDS + 1).collect()]
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of events")
    if not kinds:
        return none
    # one as-of for all kinds: each signal stands there once a kind, and the kind is a part of the key
    name = F.concat_ws("\x00", F.col("kind"), F.coalesce("symbol", F.lit("")))
    each = signals.select("symbol", "ts_ms", "confirm", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).withColumn("symbol", name)
    j = as_of(each, events.withColumn("symbol", name).select("symbol", "ts_ms").distinct(), [], after_ms, "_e_").withColumn("inside", F.col("_e_ts").isNotNull())
    return j.groupBy("kind", "inside").agg(F.count("*").alias("signals"), F.count_if("confirm").alias("confirmed"), F.avg(F.col("confirm").cast("int")).alias("rate"))
