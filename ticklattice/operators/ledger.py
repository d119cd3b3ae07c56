"""Fills, costs, lots, daily results and the figures over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trials import skyline

from ..functions import business_date, rounded

#: Quantities are counted in these units while lots are matched.
UNIT = 100_000_000
#: Units of cumulative quantity in a chunk of lots: 50,000 whole ones.
CHUNK = 50_000 * UNIT
#: Chunks of a symbol's lots, at most.
MOST = 65_536


def costs(fills: DataFrame) -> DataFrame:
    """notional, fee and exec_px of each fill: slippage moves the price against the side, the fee is on the notional."""
    way = F.when(F.col("side") == "buy", 1).otherwise(-1)
    out = fills.withColumn("exec_px", F.col("px") * (1 + way * F.col("slippage_bps") / 1e4)).withColumn("notional", F.col("px") * F.col("qty"))
    return out.withColumn("fee", F.col("notional") * F.col("fee_bps") / 1e4)


def slippage_bps(model: str, base: float, spread: Column, vol: Column, scenario: Column, factors: dict[str, float] | None = None) -> Column:
    """static: base; linear: the larger of base and .5 spread + .3 vol; piecewise: base times the scenario's factor."""
    if model == "static":
        return F.lit(base)
    if model == "linear":
        return F.greatest(F.lit(base), 0.5 * spread + 0.3 * vol)
    if model == "piecewise":
        return base * _pick(scenario, factors or {"A_H": 2.0, "A_L": 1.5, "Q_H": 1.2, "Q_L": 1.0}, 1.0)
    raise ValueError(f"no slippage model {model}")


def fee_bps(model: str, notional: Column, maker: Column, taker_bps: float = 5.0, maker_bps: float = 2.0, tiers: tuple[tuple[float, float], ...] = ((0.0, 5.0), (20_000.0, 4.0), (50_000.0, 3.0))) -> Column:
    """taker_static: taker_bps; tiered: that of the highest tier whose floor the notional reaches; maker_taker: the mean by the
    probability `maker`."""
    if model == "taker_static":
        return F.lit(taker_bps)
    if model == "tiered":
        out = F.lit(tiers[0][1])
        for floor, bps in tiers[1:]:
            out = F.when(notional >= floor, bps).otherwise(out)
        return out
    if model == "maker_taker":
        return maker * maker_bps + (1 - maker) * taker_bps
    raise ValueError(f"no fee model {model}")


def maker_probability(scenario: Column, spread: Column, side: Column) -> Column:
    """A scenario's probability, less where the spread is tight, with a bias by side, from 0 to 1."""
    base = _pick(scenario, {"Q_L": 0.8, "Q_H": 0.6, "A_L": 0.5, "A_H": 0.3}, 0.5)
    near = F.when(spread < 1, 0.8).when(spread > 5, 1.2).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * near * F.when(side == "buy", 1.05).otherwise(0.95)))


def _pick(key: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def fifo_lots(fills: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Closed legs of lots matched oldest first: the n-th unit bought of a symbol goes with the n-th sold, whichever came first.

    A row for each leg: symbol, q, buy_px, sell_px, pnl (before fees), fee (both fills' shares by quantity), open_ms, close_ms,
    way (long if bought first). fills: fill_id, symbol, ts_ms, side, px, qty, fee; a quantity that is null or not above 0 is
    left out. A leg is where the cumulative quantities of a buy and a sell overlap; it begins where the later of both does.
    Cumulative quantities come from totals of hours and then sums within them. Fills then go to chunks of cumulative quantity
    (of `chunk` units, or a MOST-th of the symbol's quantity if that is more), to all that they reach into, so a symbol
    spreads over tasks, each start meets what is open there in its own chunk, and fills of a side reach into MOST more chunks at most.
    Two shuffles of fills; what can be computed after one is not sent through it."""
    size = F.round(F.col("qty") * UNIT).cast("decimal(38,0)")
    f = fills.where("qty > 0 and side in ('buy', 'sell')").select("symbol", "side", F.expr("ts_ms div 3600000").alias("_hour"), "ts_ms", "fill_id", "px", "fee", "qty")
    totals = f.groupBy("symbol", "side", "_hour").agg(F.sum(size).alias("_t"))
    before = Window.partitionBy("symbol", "side").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    width = F.greatest(F.lit(chunk).cast("decimal(38,0)"), (F.floor(F.sum("_t").over(Window.partitionBy("symbol")) / MOST) + 1).cast("decimal(38,0)"))
    totals = totals.select("symbol", "side", "_hour", F.coalesce(F.sum("_t").over(before), F.lit(0)).cast("decimal(38,0)").alias("_b"), width.alias("_width"))
    own = Window.partitionBy("symbol", "side", "_hour").orderBy("ts_ms", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    f = f.repartition("symbol", "side", "_hour").withColumn("_q", size).where("_q > 0").withColumn("_e", F.sum("_q").over(own)).join(totals, ["symbol", "side", "_hour"])
    f = f.withColumn("end", (F.col("_b") + F.col("_e")).cast("decimal(38,0)")).withColumn("start", (F.col("end") - F.col("_q")).cast("decimal(38,0)"))
    part = lambda x: F.floor(x / F.col("_width")).cast("long")
    f = f.withColumn("_first", part(F.col("start")))
    row = F.struct("end", "px", "qty", "fee", "ts_ms", "fill_id").alias("_row")
    f = f.select("symbol", "side", "start", row, "_first", F.explode(F.sequence("_first", part(F.col("end") - 1))).alias("_chunk")).withColumn("_own", F.col("_chunk") == F.col("_first")).drop("_first")
    w = Window.partitionBy("symbol", "_chunk").orderBy("start")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sides = ("buy", "sell")
    # a buy and a sell may start at one place: the last row there has both
    legs = f.repartition("symbol", "_chunk").select("symbol", "start", "_own", *(F.last(F.when(F.col("side") == s, F.col("_row")), True).over(so_far).alias(s) for s in sides), F.lead("start").over(w).alias("_next"))
    legs = legs.where("_own and buy is not null and sell is not null and (_next is null or _next > start)")
    legs = legs.withColumn("_q", F.least(F.col("buy.end"), F.col("sell.end")) - F.col("start")).where("_q > 0")
    q = (F.col("_q") / UNIT).cast("double")
    share = lambda s: F.coalesce(F.col(f"{s}.fee"), F.lit(0.0)) * q / F.col(f"{s}.qty")
    first = (F.col("buy.ts_ms") < F.col("sell.ts_ms")) | ((F.col("buy.ts_ms") == F.col("sell.ts_ms")) & (F.col("buy.fill_id") <= F.col("sell.fill_id")))
    return legs.select(
        "symbol", q.alias("q"), F.col("buy.px").alias("buy_px"), F.col("sell.px").alias("sell_px"), ((F.col("sell.px") - F.col("buy.px")) * q).alias("pnl"), (share("buy") + share("sell")).alias("fee"),
        F.least("buy.ts_ms", "sell.ts_ms").alias("open_ms"), F.greatest("buy.ts_ms", "sell.ts_ms").alias("close_ms"), F.when(first, "long").otherwise("short").alias("way"), F.col("buy.fill_id").alias("buy_id"), F.col("sell.fill_id").alias("sell_id"),
    )


def daily(fills: DataFrame) -> DataFrame:
    """day, symbol: cash (sold less bought), fee, turnover, trades."""
    c = costs(fills)
    cash = F.when(F.col("side") == "sell", F.col("notional")).otherwise(-F.col("notional"))
    return c.groupBy(F.expr("ts_ms div 86400000").alias("day"), "symbol").agg(F.sum(cash - F.col("fee")).alias("net"), F.sum("fee").alias("fee"), F.sum("notional").alias("turnover"), F.count("*").alias("trades"))


def daily_legs(legs: DataFrame, zone: str = "UTC", rollover_hours: int = 0) -> DataFrame:
    """Realised results of each business date (of the close, in a time zone, days beginning rollover_hours after midnight) and
    symbol: gross, fee, net, turnover, legs, wins, losses, win_rate, rr (mean win over mean loss; null without both), hold_s."""
    net = F.col("pnl") - F.col("fee")
    d = legs.withColumn("net", net).withColumn("day", business_date(F.col("close_ms"), zone, rollover_hours))
    win, loss = F.avg(F.when(F.col("net") > 0, F.col("net"))), F.avg(F.when(F.col("net") < 0, -F.col("net")))
    return d.groupBy("day", "symbol").agg(
        F.sum("pnl").alias("gross"), F.sum("fee").alias("fee"), F.sum("net").alias("net"), F.sum(F.col("q") * (F.col("buy_px") + F.col("sell_px"))).alias("turnover"), F.count("*").alias("legs"),
        F.count_if(F.col("net") > 0).alias("wins"), F.count_if(F.col("net") < 0).alias("losses"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"), (win / loss).alias("rr"), F.avg((F.col("close_ms") - F.col("open_ms")) / 1000).alias("hold_s"),
    )


def performance(days: DataFrame) -> DataFrame:
    """A row for each symbol of days (day, symbol, net): total, Sharpe, Sortino (252 days), largest drawdown, MAR (mean daily
    result x 252 over the drawdown), share of winning days. Null where undefined."""
    by_day = Window.partitionBy("symbol").orderBy("day")  # a row for each day
    run = by_day.rowsBetween(Window.unboundedPreceding, 0)
    d = days.withColumn("equity", F.sum("net").over(run)).withColumn("peak", F.max("equity").over(run))
    loss = F.stddev_samp(F.when(F.col("net") < 0, F.col("net")))
    year = F.sqrt(F.lit(252.0))
    drawdown = F.max(F.col("peak") - F.col("equity"))
    return d.groupBy("symbol").agg(
        F.round(F.sum("net"), 2).alias("total"), rounded(F.try_divide(F.avg("net"), F.stddev_samp("net")) * year).alias("sharpe"), rounded(F.try_divide(F.avg("net"), loss) * year).alias("sortino"),
        F.round(drawdown, 2).alias("drawdown"), rounded(F.try_divide(F.avg("net") * 252, drawdown)).alias("mar"), rounded(F.avg((F.col("net") > 0).cast("int"))).alias("win_rate"), F.count("*").alias("days"),
    )


def equity_curve(days: DataFrame) -> DataFrame:
    """day, net of all symbols, equity so far and the drawdown from its peak."""
    d = days.groupBy("day").agg(F.sum("net").alias("net"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # over days, one row each
    d = d.withColumn("equity", F.sum("net").over(run))
    return d.withColumn("drawdown", F.max("equity").over(run) - F.col("equity"))


def pareto(rows: DataFrame, up: list[str], down: list[str], key: str) -> DataFrame:
    """Rows that no other row equals or betters in every objective and betters in one. Nulls are no objectives: such rows go.

    With two objectives: sorted by the first, a row stays if its second is better than that of all rows with a better first
    and the best of those with an equal one; rows are summed up by their first objective, and then by ranges of it, before a
    window runs. With more, skylines of tasks are merged in rounds (trials.skyline)."""
    goals = [F.col(c).cast("double").alias(c) for c in up] + [(-F.col(c).cast("double")).alias(c) for c in down]
    names = [*up, *down]
    points = rows.select(*goals).dropna().distinct()
    if len(names) == 2:
        x, y = names
        best = points.groupBy(x).agg(F.max(y).alias(y))
        best = best.withColumn("_range", F.floor(F.log2(F.abs(x) + 1) * 8) * F.signum(x))  # in the order of x
        tops = best.groupBy("_range").agg(F.max(y).alias("_top"))
        above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # some thousand ranges at most
        tops = tops.select("_range", F.max("_top").over(above).alias("_above"))
        inside = Window.partitionBy("_range").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
        best = best.withColumn("_in", F.max(y).over(inside)).join(tops, "_range")
        front = best.where((F.col(y) > F.coalesce(F.greatest("_in", "_above"), F.lit(float("-inf"))))).select(*names)
    else:
        front = skyline(points, names)
    same = [(F.col(c).cast("double") * (1 if c in up else -1)) == F.col(f"_f{i}") for i, c in enumerate(names)]
    return rows.join(front.toDF(*(f"_f{i}" for i in range(len(names)))), reduce(lambda a, b: a & b, same), "left_semi")
