"""Checks of orders before they are sent: what is wrong with them, and what would be right.

Orders are rows: symbol, side, order_type, qty, price (null for none), account_mode,
max_slippage_bps, and the guards spread_bps, event_lag_sec and activity_tpm (null where
unknown). Rules of a symbol come as a table of one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import price_cap
from .matching import looked_up

# What fields may hold.
SIDES, ORDER_TYPES, ACCOUNT_MODES = ("buy", "sell"), ("market", "limit"), ("isolated", "cross")
GUARDS = ("spread_bps", "event_lag_sec", "activity_tpm")
RULES = {"min_notional": None, "step_size": None, "tick_size": None, "max_qty": None}


def _listed(*rules: tuple[Column, tuple]) -> Column:
    """The names of all rules that hold, in order; a rule that is null does not."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.when(test, F.array(*(x if isinstance(x, Column) else F.lit(x) for x in names))).otherwise(none) for test, names in rules))


def schema_errors(orders: DataFrame) -> Column:
    """What a request's fields break, as pairs of reason and field after invalid_schema; none if nothing. A request that lacks
    one of the required fields gets the list of those it lacks alone."""
    c = F.col
    lacks = _listed(*((c(f).isNull(), (f,)) for f in ("symbol", "side", "order_type", "qty")))
    empty = lambda f: c(f) == ""
    named = lambda f: F.concat(F.lit(f"{f}="), c(f))
    mode = c("account_mode") if "account_mode" in orders.columns else F.lit(None).cast("string")
    broken = _listed(
        *((empty(f), ("missing_required_field", f)) for f in ("symbol", "side", "order_type")), (c("qty") <= 0, ("invalid_field_type", "qty")),
        (~c("side").isin(*SIDES), ("invalid_enum_value", named("side"))), (~c("order_type").isin(*ORDER_TYPES), ("invalid_enum_value", named("order_type"))),
        ((mode != "") & ~mode.isin(*ACCOUNT_MODES), ("invalid_enum_value", F.concat(F.lit("account_mode="), mode))),
        ((c("order_type") == "limit") & c("price").isNull(), ("missing_required_field", "price (required for limit orders)")), (c("price") <= 0, ("invalid_field_type", "price")),
        *((c(g) < 0, ("invalid_field_type", f"guards.{g}")) for g in GUARDS),
    )
    first = lambda name, rest: F.concat(F.array(F.lit(name)), rest)
    return F.when(F.size(lacks) > 0, first("missing_required_field", lacks)).when(F.size(broken) > 0, first("invalid_schema", broken)).otherwise(broken)


def _nearest(x: Column, step: Column) -> Column:
    """The nearest multiple, halves to the even one; null without a step."""
    return F.when(step > 0, F.bround(x / step, 0) * step)


def checked_orders(orders: DataFrame, rules: DataFrame, most_spread: float = 8.0, most_lag: float = 1.5, least_tpm: float = 10.0, most_notional: float = 20_000.0, tick: float | None = None) -> DataFrame:
    """reasons (none: it may go), and what is suggested: min_qty, aligned_qty, aligned_price, max_qty, final_qty (the aligned
    quantity within max_qty) and, for limit orders, price_cap (the worst price within max_slippage_bps on the tick, not beyond
    the aligned price). Orders whose fields are wrong get these reasons alone. A missing guard counts as 0. rules: symbol and
    any of RULES' columns, a row a symbol; it may be large."""
    c = F.col
    own = rules.select("symbol", *(c(r).cast("double").alias(r) if r in rules.columns else F.lit(None).cast("double").alias(r) for r in RULES))
    o = looked_up(orders, own, ["symbol"], {}).withColumn("_wrong", schema_errors(orders))
    guard = lambda g: F.coalesce(g, F.lit(0.0))
    priced, notional = c("price").isNotNull(), c("qty") * c("price")
    o = o.withColumns({"aligned_qty": _nearest(c("qty"), c("step_size")), "aligned_price": _nearest(c("price"), c("tick_size"))})
    off_step, off_tick = priced & (F.abs(c("qty") - c("aligned_qty")) > 1e-10), F.abs(c("price") - c("aligned_price")) > 1e-10
    small, large, over = notional < c("min_notional"), notional > most_notional, priced & (c("qty") > c("max_qty"))
    why = _listed(
        (guard("spread_bps") > most_spread, ("spread_too_wide",)), (guard("event_lag_sec") > most_lag, ("lag_exceeds_cap",)), (guard("activity_tpm") < least_tpm, ("market_inactive",)),
        (small, ("notional_below_min",)), (off_step, ("qty_not_aligned_to_step_size",)), (off_tick, ("price_not_aligned_to_tick_size",)), (large, ("notional_exceeds_limit",)), (over, ("symbol_qty_exceeds_limit",)),
    )
    fine = F.size("_wrong") == 0
    o = o.withColumn("reasons", F.when(fine, why).otherwise(c("_wrong")))
    o = o.withColumns({"min_qty": F.when(fine & small, c("min_notional") / c("price")), "_most": F.when(fine, F.least(F.when(large, most_notional / c("price")), F.when(over, c("max_qty"))))})
    o = o.withColumns({"aligned_qty": F.when(fine & off_step, c("aligned_qty")), "aligned_price": F.when(fine & off_tick, c("aligned_price"))})
    cap = F.when(fine & priced & (c("order_type") == "limit"), price_cap(c("price"), c("side"), c("max_slippage_bps"), tick))
    within = F.when(c("side") == "buy", F.least(cap, "aligned_price")).otherwise(F.greatest(cap, "aligned_price"))
    o = o.withColumn("final_qty", F.when(c("aligned_qty").isNotNull(), F.least("aligned_qty", "_most"))).withColumn("price_cap", F.when(cap.isNotNull(), within))
    return o.drop(*RULES, "_wrong").withColumnRenamed("_most", "max_qty")
