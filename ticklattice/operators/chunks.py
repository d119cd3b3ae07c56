"""Windows over event time that spread one symbol over many tasks.

A symbol's rows are cut into chunks of time, or into blocks of rows, and a window runs
inside a chunk. What it needs from before is brought along: rows near the edge are
repeated in the next chunk, or the last row or the total of earlier chunks is carried
over by a window over the table of chunks, which has a row for each symbol and chunk.

Rows without a symbol are those of one more symbol; rows without a time are a chunk of
their own, before all others. Both stay.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_MS = 3_600_000
BLOCK = 65_536


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept in the folder that spark.checkpoint.dir names (shared by all executors; on a single machine
    without that setting a folder of its own). For tables that later steps read several times: windows that carry totals read
    their input twice, scans three times, and steps on top of each other would multiply that."""
    spark = rows.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="ticklattice-"))
    return rows.checkpoint()


def chunk_of(at: str = "ts_ms", width: int = CHUNK_MS) -> Column:
    return F.expr(f"{at} div {width}")


def own_order(*more: str):
    """A chunk's rows in order of time."""
    return Window.partitionBy("symbol", "_chunk").orderBy("ts_ms", *more)


def over_range(rows: DataFrame, before_ms: int, add: dict[str, Callable], width: int = CHUNK_MS, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns that look back before_ms at most: add has name -> function of a range window; with `order`, of the window
    of all rows so far in order of (ts_ms, *order), which may reach back further. One shuffle."""
    parts = F.sequence(chunk_of(width=width), F.expr(f"(ts_ms + {before_ms}) div {width}"))
    dealt = rows.select("*", F.explode_outer(parts).alias("_chunk"))
    w = own_order(*order).rowsBetween(Window.unboundedPreceding, 0) if order else own_order().rangeBetween(-before_ms, 0)
    out = dealt.select("*", *(f(w).alias(c) for c, f in add.items()))
    return out.where(F.col("_chunk").eqNullSafe(chunk_of(width=width))).drop("_chunk")


def in_span(rows: DataFrame, counts: dict[str, Column], span_ms: int, order: tuple[str, ...] = ("seq",), width: int = CHUNK_MS // 6) -> DataFrame:
    """Adds, for each name -> whole number of a row, its sum over the symbol's rows of the last span_ms so far, in order of (ts_ms,
    *order), the row itself included. Each row enters at its time and leaves with the opposite number once the span is over, so
    a running sum is enough: a frame that moves at both ends would be gone through at every row. A row that leaves in a later
    chunk enters there, and in those between, before all others. One shuffle, of whole rows and of marks."""
    r = rows.select("*", *(v.cast("long").alias(f"_x_{c}") for c, v in counts.items()), F.struct(*rows.columns).alias("_row"))
    none = F.lit(None).cast(r.schema["_row"].dataType)
    gone = F.col("ts_ms") + span_ms + 1
    first, last = F.expr(f"ts_ms div {width}"), F.expr(f"(ts_ms + {span_ms} + 1) div {width}")

    def mark(chunk: Column, at: Column, way: int, row: Column) -> Column:
        return F.struct(chunk.alias("_chunk"), at.alias("ts_ms"), F.lit(way).alias("_way"), *((F.col(f"_x_{c}") * way).alias(f"_x_{c}") for c in counts), *(F.col(c) for c in order), row.alias("_row"))

    later = F.transform(F.filter(F.sequence(first, last), lambda c: c > first), lambda c: mark(c, F.col("ts_ms"), 1, none))
    marks = F.when(F.col("ts_ms").isNull(), F.array(mark(first, F.col("ts_ms"), 1, F.col("_row")))).otherwise(F.concat(F.array(mark(first, F.col("ts_ms"), 1, F.col("_row")), mark(last, gone, -1, none)), later))
    here = own_order("_way", *order).rowsBetween(Window.unboundedPreceding, 0)  # at one time rows leave before others enter
    out = r.select("symbol", F.inline(marks)).select("_row", *(F.sum(f"_x_{c}").over(here).alias(c) for c in counts)).where("_row is not null")
    return out.select("_row.*", *counts)


def by_chunk(inside: DataFrame, carried: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with what is carried into their chunk: a join by symbol and chunk in which null equals null."""
    c = carried.withColumnsRenamed({"symbol": "_symbol_carried", "_chunk": "_chunk_carried"})
    j = inside.join(c, inside["symbol"].eqNullSafe(c["_symbol_carried"]) & inside["_chunk"].eqNullSafe(c["_chunk_carried"]), how)
    return j.drop("_symbol_carried", "_chunk_carried")


def last_known(rows: DataFrame, values: dict[str, Column], order: tuple[str, ...] = ("seq",), width: int = CHUNK_MS) -> DataFrame:
    """Adds, for each name -> value, the symbol's last value so far that is not null, the row's own included."""
    dealt = rows.select("*", *(v.alias(f"_x_{c}") for c, v in values.items()), chunk_of(width=width).alias("_chunk"))
    at = F.struct("ts_ms", *order)
    last = dealt.groupBy("symbol", "_chunk").agg(*(F.max_by(f"_x_{c}", F.when(F.col(f"_x_{c}").isNotNull(), at)).alias(f"_l_{c}") for c in values))
    before = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("symbol", "_chunk", *(F.last(f"_l_{c}", True).over(before).alias(f"_b_{c}") for c in values))
    here = own_order(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("*", *(F.last(f"_x_{c}", True).over(here).alias(f"_i_{c}") for c in values))
    return by_chunk(inside, carried).select(*rows.columns, *(F.coalesce(f"_i_{c}", f"_b_{c}").alias(c) for c in values))


def with_previous(rows: DataFrame, columns: list[str], to: str = "_prev", order: tuple[str, ...] = ("seq",), width: int = CHUNK_MS) -> DataFrame:
    """Adds `to`: a struct of the columns of the symbol's row before (null for the first)."""
    value = F.struct(*columns)
    dealt = rows.withColumn("_chunk", chunk_of(width=width))
    last = dealt.groupBy("symbol", "_chunk").agg(F.max_by(value, F.struct("ts_ms", *order)).alias("_v"))
    carried = last.select("symbol", "_chunk", F.lag("_v").over(Window.partitionBy("symbol").orderBy("_chunk")).alias("_carried"))
    inside = dealt.withColumn(to, F.lag(value).over(own_order(*order)))
    return by_chunk(inside, carried).withColumn(to, F.coalesce(to, "_carried")).drop("_carried", "_chunk").select(*rows.columns, to)


def running(rows: DataFrame, sums: dict[str, Column], order: tuple[str, ...] = ("seq",), width: int = CHUNK_MS) -> DataFrame:
    """Adds running sums over each symbol's rows."""
    dealt = rows.select("*", *(v.alias(f"_x_{c}") for c, v in sums.items()), chunk_of(width=width).alias("_chunk"))
    totals = dealt.groupBy("symbol", "_chunk").agg(*(F.sum(f"_x_{c}").alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("symbol", "_chunk", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    here = own_order(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("*", *(F.sum(f"_x_{c}").over(here).alias(f"_i_{c}") for c in sums))
    return by_chunk(inside, totals).select(*rows.columns, *((F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(c) for c in sums))


def numbered(rows: DataFrame, to: str = "_n", order: tuple[str, ...] = ("seq",), width: int = CHUNK_MS) -> DataFrame:
    """Adds the number of each row within its symbol, from 1."""
    return running(rows, {to: F.lit(1)}, order, width).withColumn(to, F.col(to).cast("long"))


def over_rows(rows: DataFrame, before: int, after: int, add: dict[str, Callable], order: tuple[str, ...] = ("seq",), block: int = BLOCK, number: str | None = None) -> DataFrame:
    """Adds columns that look at `before` rows back and `after` rows ahead at most: add has name -> function of the symbol's
    ordered window, which sets its own frame. `number` names a column that numbers a symbol's rows already; else that is a
    shuffle more, and a second read of rows."""
    n = rows.withColumn("_n", F.col(number)) if number else numbered(rows, "_n", order)
    dealt = n.withColumn("_chunk", F.explode(F.sequence(F.expr(f"greatest(0, _n - {after}) div {block}"), F.expr(f"(_n + {before}) div {block}"))))
    w = Window.partitionBy("symbol", "_chunk").orderBy("_n")
    out = dealt.select("*", *(f(w).alias(c) for c, f in add.items()))
    return out.where(F.col("_chunk") == F.expr(f"_n div {block}")).drop("_chunk", "_n")


def latest(left: DataFrame, right: DataFrame, value: Column, to: str, width: int = CHUNK_MS) -> DataFrame:
    """Adds `to`: value of the symbol's latest row of right at or before each row of left. right has one row for each (symbol,
    ts_ms); those without a time are never found. A chunk gets the last row of the chunks before it as well."""
    r = right.where("ts_ms is not null").select("symbol", "ts_ms", chunk_of(width=width).alias("_chunk"), F.lit(0).alias("_s"), value.alias("_r"))
    touched = left.select("symbol", chunk_of(width=width).alias("_chunk")).distinct().withColumn("_v", F.lit(None).cast(r.schema["_r"].dataType))
    ends = r.groupBy("symbol", "_chunk").agg(F.max_by("_r", "ts_ms").alias("_v")).unionByName(touched).groupBy("symbol", "_chunk").agg(F.first("_v", True).alias("_v"))
    order = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("symbol", "_chunk", F.last("_v", True).over(order).alias("_carried"))
    both = left.select("symbol", "ts_ms", chunk_of(width=width).alias("_chunk"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"))
    # at equal times rows of right come first
    both = both.unionByName(r, allowMissingColumns=True).withColumn("_q", F.last("_r", True).over(own_order("_s").rowsBetween(Window.unboundedPreceding, 0)))
    out = by_chunk(both.where("_l is not null"), carried, "left")
    return out.select("_l.*", F.coalesce("_q", "_carried").alias(to))


def around(left: DataFrame, right: DataFrame, value: Column, before: str, after: str, width: int = CHUNK_MS) -> DataFrame:
    """Adds `before` and `after`: value of the symbol's latest row of right at or before each row of left, and of the first after
    it, in one shuffle of both; as latest() otherwise. Rows of left without a time find nothing."""
    r = right.where("ts_ms is not null").select("symbol", "ts_ms", chunk_of(width=width).alias("_chunk"), F.lit(0).alias("_s"), value.alias("_r"))
    none = F.lit(None).cast(r.schema["_r"].dataType)
    touched = left.select("symbol", chunk_of(width=width).alias("_chunk")).distinct().select("symbol", "_chunk", none.alias("_x"), none.alias("_y"))
    ends = r.groupBy("symbol", "_chunk").agg(F.max_by("_r", "ts_ms").alias("_x"), F.min_by("_r", "ts_ms").alias("_y"))
    ends = ends.unionByName(touched).groupBy("symbol", "_chunk").agg(F.first("_x", True).alias("_x"), F.first("_y", True).alias("_y"))
    # a frame that ends at the row costs a step a row, one that begins there a pass over all that follow: so the way back is a window of its own
    up, down = (Window.partitionBy("symbol").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_chunk"), F.desc("_chunk")))
    carried = ends.select("symbol", "_chunk", F.last("_x", True).over(up).alias("_from"), F.last("_y", True).over(down).alias("_to"))
    both = left.select("symbol", "ts_ms", chunk_of(width=width).alias("_chunk"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l")).unionByName(r, allowMissingColumns=True)
    # at equal times rows of right come first, so they are before a row of left and never after it
    so_far = own_order("_s").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("symbol", "_chunk").orderBy(F.desc("ts_ms"), F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", F.last("_r", True).over(so_far).alias("_b"), F.last("_r", True).over(back).alias("_a"))
    out = by_chunk(both.where("_l is not null"), carried, "left")
    timed = lambda x: F.when(F.col("ts_ms").isNotNull(), x)
    return out.select("_l.*", timed(F.coalesce("_b", "_from")).alias(before), timed(F.coalesce("_a", "_to")).alias(after))
