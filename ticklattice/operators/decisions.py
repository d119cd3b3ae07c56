"""Signal decisions with their reasons, from scores to orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import consistency
from ..functions.rules import aligned_qty, any_of, decided_side
from .chunks import numbered, over_range
from .scans import Bounded, Cooldown, scan
from .states import streaks


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, in order; a rule that is null does not."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in rules)))


def confirmed(signals: DataFrame, spread: float = 20.0, lag: float = 3.0, weak: float = 0.5, floor: float = 0.1) -> DataFrame:
    """consistency, reasons, confirm and signal_type of each signal."""
    s = signals.withColumn("consistency", consistency(F.col("z_ofi"), F.col("z_cvd")))
    why = reasons((F.col("warmup"), "warmup"), (F.col("spread_bps") > spread, "spread_bps_exceeded"), (F.col("lag_sec") > lag, "lag_sec_exceeded"), (F.col("consistency") < floor, "low_consistency"), (F.abs("score") < weak, "weak_signal"))
    s = s.withColumn("reasons", why).withColumn("confirm", (F.size("reasons") == 0) & (F.col("score") != 0))
    return s.withColumn("signal_type", signal_type(F.col("score"), F.col("confirm")))


def signal_type(score: Column, confirm: Column, strong: float = 1.5) -> Column:
    side = F.when(score > 0, "buy").otherwise("sell")
    return F.when(score == 0, "neutral").when(~confirm, "pending").when(F.abs(score) >= strong, F.concat(F.lit("strong_"), side)).otherwise(side)


#: What a scenario adds to the thresholds: (weak, consistency, streak).
OVERRIDES = {"A_H": (0.2, 0.05, 1), "Q_L": (-0.1, 0.0, 0)}


def decided(signals: DataFrame, spread: float = 20.0, lag: float = 3.0, weak: float = 0.5, least: float = 0.1, strong: float = 1.5, streak: int = 1, overrides: dict[str, tuple[float, float, int]] | None = None, tiers: bool = False) -> DataFrame:
    """The whole decision on signals (symbol, ts_ms, seq, score, z_ofi, z_cvd, spread_bps, lag_sec, warmup, scenario, and if
    there, cooling and div_type): consistency (raised to 0.10 from a score of 0.4 on, or to 0.12 at a divergence, if it is 0),
    quality_tier, reasons, confirm, streak (of confirmed rows with one direction), signal_type.

    Scenarios shift the thresholds. Without tiers a row is confirmed if it has a direction and no reason. With tiers hard
    reasons block always; a strong score passes soft ones, a normal one does not, a weak one never is confirmed. A confirmed
    row whose direction has lasted fewer rows than asked for is not confirmed after all (reason short_streak)."""
    has = lambda c: F.col(c) if c in signals.columns else F.lit(None)
    table = OVERRIDES if overrides is None else overrides
    shift = lambda i, base: _shifted(F.col("scenario"), {k: base + v[i] for k, v in table.items()}, base)
    raw, size = consistency(F.col("z_ofi"), F.col("z_cvd")), F.abs("score")
    raised = F.when((raw <= 0) & (size >= 0.4), 0.10).when((raw <= 0) & has("div_type").isNotNull(), 0.12).otherwise(raw)
    s = signals.withColumn("consistency", raised)
    low, soft = F.col("consistency") < shift(1, least), size < shift(0, weak)
    why = reasons((has("cooling").cast("boolean"), "cooldown_after_exit"), (F.col("warmup"), "warmup"), (F.col("spread_bps") > spread, "spread_bps_exceeded"), (F.col("lag_sec") > lag, "lag_sec_exceeded"), (low, "low_consistency"), (soft, "weak_signal"))
    s = s.withColumn("quality_tier", F.when(size >= strong, "strong").when(~soft, "normal").otherwise("weak")).withColumn("reasons", why)
    hard = F.size(F.array_except("reasons", any_of("low_consistency", "weak_signal"))) > 0
    free = F.size("reasons") == 0
    go = ~hard & ((F.col("quality_tier") == "strong") | ((F.col("quality_tier") == "normal") & free)) if tiers else free
    s = s.withColumn("_go", go & (F.col("score") != 0))
    runs = streaks(s.where("_go").select("symbol", "ts_ms", "seq", "score"), F.col("score")).select("symbol", "seq", "streak")
    s = s.join(runs, ["symbol", "seq"], "left").withColumn("streak", F.coalesce("streak", F.lit(0)).cast("long"))
    short = F.col("_go") & (F.col("streak") < shift(2, streak))
    s = s.withColumn("reasons", F.when(short, F.array_append("reasons", "short_streak")).otherwise(F.col("reasons"))).withColumn("confirm", F.col("_go") & ~short).drop("_go")
    return s.withColumn("signal_type", signal_type(F.col("score"), F.col("confirm"), strong))


def _shifted(key: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def regime_of(z_ofi: Column, z_cvd: Column, quiet: float = 0.5) -> Column:
    """quiet if both are small, trend if they point the same way (0 counts as down), else revert."""
    return F.when((F.abs(z_ofi) < quiet) & (F.abs(z_cvd) < quiet), "quiet").when((z_ofi > 0) == (z_cvd > 0), "trend").otherwise("revert")


def imputed_activity(tps: Column, trade_rate: Column, quote_rate: Column, volume_usd: Column) -> Column:
    """Trades a second: given, else from the trades a minute, else a tenth of the quotes a minute, else from the volume, else 0."""
    return F.coalesce(tps, trade_rate / 60, quote_rate / 600, volume_usd / 1e6, F.lit(0.0))


def decision_code(regime: Column) -> Column:
    """First test that fails: gating, regime, score."""
    gate = (F.abs("z_ofi") >= 1.5) & (F.abs("z_cvd") >= 1.2)
    least = F.when(regime == "active", 1.8).when(regime == "normal", 2.2).otherwise(2.8)
    return F.when(~gate, "FAIL_GATING").when(regime == "quiet", "BAD_REGIME").when(F.abs("score") < least, "LOW_SCORE").otherwise("OK")


def decisions(signals: DataFrame, now_ms: Column, expiry_ms: int, cooldown_ms: int = 30_000) -> DataFrame:
    """code of signals with a regime (active, normal, quiet) and, if there, div_type: EXPIRE if older than expiry_ms, COOLDOWN
    within cooldown_ms of the last OK of the symbol and side, then decision_code (a divergence passes the gate). Only OK
    starts a cooldown."""
    div = F.col("div_type").isin("bull", "bear") if "div_type" in signals.columns else F.lit(False)
    plain = decision_code(F.col("regime"))
    least = F.when(F.col("regime") == "active", 1.8).otherwise(2.2)
    passed = F.when(F.col("regime") == "quiet", "BAD_REGIME").when(F.abs("score") < least, "LOW_SCORE").otherwise("OK")
    s = signals.withColumn("_plain", F.when(F.coalesce(div, F.lit(False)), passed).otherwise(plain)).withColumn("_old", F.coalesce(now_ms - F.col("ts_ms") > expiry_ms, F.lit(False)))
    s = s.withColumn("_side", F.when(F.col("score") > 0, "buy").otherwise("sell")).withColumn("_free", ((F.col("_plain") == "OK") & ~F.col("_old")).cast("double"))
    s = scan(s, ["symbol", "_side"], ["ts_ms", "seq"], ["ts_ms", "_free"], Cooldown(cooldown_ms), "_wait long")
    code = F.when(F.col("_old"), "EXPIRE").when(F.col("_wait") == 1, "COOLDOWN").otherwise(F.col("_plain"))
    return s.withColumn("code", code).drop("_plain", "_old", "_side", "_free", "_wait")


def orders(signals: DataFrame, usd: float, mid: Column, step: str = "0.001") -> DataFrame:
    """One order for each confirmed signal without a gate: side, qty (usd at the mid, in steps) and a client id of up to 36 letters."""
    s = signals.where(F.col("confirm"))
    side = decided_side(F.col("signal_type"), F.lit(None).cast("string"), F.col("score"))
    client = F.substring(F.concat_ws("-", F.lit("c"), "symbol", F.col("ts_ms").cast("string"), F.col("seq").cast("string")), 1, 36)
    return s.withColumn("side", side).withColumn("qty", aligned_qty(F.lit(usd) / mid, step)).withColumn("client_id", client)


def upgraded(signals: DataFrame, expiry_ms: int = 60_000) -> DataFrame:
    """Signals of the first schema as those of the second: columns that are missing, or null in a row, get their defaults, from
    the row where they follow from it (signal_id, side_hint by the score's sign, gating and decision_code by confirm)."""
    have = signals.columns
    has = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    text = lambda c, other: F.coalesce(has(c).cast("string"), F.lit(other))
    score, confirm = F.coalesce(has("score", "double"), F.lit(0.0)), F.coalesce(has("confirm", "boolean"), F.lit(False))
    made = F.concat_ws("-", text("run_id", "unknown"), text("symbol", "UNKNOWN"), text("ts_ms", "0"), text("seq", "0"))
    s = signals.withColumns({
        "schema_version": text("schema_version", "signal/v2"), "signal_id": F.coalesce(has("signal_id"), made),
        "side_hint": F.coalesce(has("side_hint"), F.when(score > 0, "buy").when(score < 0, "sell").otherwise("flat")), "regime": text("regime", "unknown"),
        "gating": F.coalesce(has("gating", "int"), confirm.cast("int")), "cooldown_ms": F.coalesce(has("cooldown_ms", "long"), F.lit(0).cast("long")),
        "expiry_ms": F.coalesce(has("expiry_ms", "long"), F.lit(expiry_ms).cast("long")), "config_hash": text("config_hash", "unknown"), "meta": text("meta", "{}"),
    })
    none, ok, shut = has("decision_code").isNull(), confirm & (F.col("gating") == 1), F.col("gating") == 0
    why = F.when(ok, "score>=entry").when(shut, text("gate_reason", "gating failed")).otherwise("score<entry")
    code = F.when(ok, "OK").when(shut, "FAIL_GATING").otherwise("LOW_SCORE")
    return s.withColumn("decision_reason", F.when(none, why).otherwise(has("decision_reason"))).withColumn("decision_code", F.when(none, code).otherwise(has("decision_code")))


def requested(score: Column, long: float = 1.0, short: float = -1.0) -> Column:
    return F.when(score >= long, "long").when(score <= short, "short").otherwise("skip")


def prechecked(warmup: Column, critical: Column, same: Column, weak: Column) -> Column:
    """The executor's first objection: warmup, critical_reason, inconsistent (below .15), throttled (below .20), weak; else pass."""
    return F.when(warmup, "warmup").when(critical, "critical_reason").when(same < 0.15, "inconsistent").when(same < 0.20, "throttled").when(weak, "weak").otherwise("pass")


def order_faults(orders: DataFrame, sides: tuple[str, ...] = ("buy", "sell")) -> DataFrame:
    """faults of orders (symbol, side, qty, price, ts_ms): what a broker would refuse."""
    c = F.col
    return orders.withColumn("faults", reasons((c("symbol").isNull() | (c("symbol") == ""), "symbol"), (~F.coalesce(c("side").isin(*sides), F.lit(False)), "side"), (~F.coalesce(c("qty") > 0, F.lit(False)), "qty"), (~F.coalesce(c("price") > 0, F.lit(False)), "price"), (~F.coalesce(c("ts_ms") > 0, F.lit(False)), "ts_ms")))


def risk_faults(orders: DataFrame, positions: DataFrame, least_notional: float, symbol_limit: float) -> DataFrame:
    """faults of orders with spread_bps, lag_sec, tpm, price and qty: guards (8 bps, 1.5 s, 10 trades a minute), notional, and
    the symbol's position (symbol, position) with the order against symbol_limit."""
    o = orders.join(positions.select("symbol", "position"), "symbol", "left")
    after = F.coalesce("position", F.lit(0.0)) + F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    why = reasons((F.col("spread_bps") > 8, "spread_bps"), (F.col("lag_sec") > 1.5, "lag_sec"), (F.col("tpm") > 10, "tpm"), (F.col("price") * F.col("qty") < least_notional, "notional"), (F.abs(after) > symbol_limit, "position"))
    return o.withColumn("faults", why).drop("position")


def adaptive_limit(rows: DataFrame, base: float = 10.0, least: float = 1.0, most: float = 100.0, span_ms: int = 60_000) -> DataFrame:
    """limit (orders a second) and throttled of rows with denied (refusals so far reported with the request, null: none) and
    regime. Each row moves the limit first: x .8 (`least` at least) where refusals are more than half of them and the requests
    of the span_ms before, x 1.1 (`most` at most) where they are less than a tenth; then x .5 in quiet, x 1.2 in active regimes,
    between the same bounds. throttled: the requests of the span before reach limit x span. All requests before count, throttled
    ones too. Each row's moves are one bounded linear step, and such steps compose."""
    r = over_range(numbered(rows), span_ms, {"_first": lambda w: F.min("_n").over(w)}).withColumn("_count", (F.col("_n") - F.col("_first")).cast("double"))
    denied = F.coalesce(F.col("denied").cast("double"), F.lit(0.0))
    rate = F.when(denied > 0, denied / (F.col("_count") + denied))
    big = 1e300
    a = F.when(rate > 0.5, 0.8).when(rate < 0.1, 1.1).otherwise(1.0)
    lo, hi = F.when(rate > 0.5, least).otherwise(-big), F.when(rate < 0.1, most).otherwise(big)
    b = F.when(F.col("regime") == "quiet", 0.5).when(F.col("regime") == "active", 1.2).otherwise(1.0)
    lo2, hi2 = F.when(F.col("regime") == "quiet", least).otherwise(-big), F.when(F.col("regime") == "active", most).otherwise(big)
    held = lambda x: F.least(hi2, F.greatest(lo2, b * x))
    r = r.withColumns({"_a": a * b, "_b": F.lit(0.0), "_lo": held(lo), "_hi": held(hi)})
    r = scan(r, ["symbol"], ["ts_ms", "seq"], ["_a", "_b", "_lo", "_hi"], Bounded(base), "limit double")
    now = F.least("_hi", F.greatest("_lo", F.col("_a") * F.col("limit")))
    return r.withColumn("limit", now).withColumn("throttled", F.col("_count") >= F.col("limit") * (span_ms / 1000)).select(*rows.columns, "limit", "throttled")


def funnel(signals: DataFrame) -> DataFrame:
    c = confirmed(signals)
    counts = c.groupBy("symbol").agg(
        F.count("*").alias("signals"), F.count_if(~F.array_contains("reasons", "weak_signal")).alias("not_weak"),
        F.count_if(F.size(F.array_intersect("reasons", any_of("weak_signal", "low_consistency"))) == 0).alias("consistent"), F.count_if("confirm").alias("confirmed"),
    )
    return counts.withColumn("confirm_rate", F.col("confirmed") / F.col("signals"))
