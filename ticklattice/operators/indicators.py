"""Order-flow indicators over each symbol's rows, in chunks of time or blocks of rows."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip
from .chunks import in_span, numbered, over_range, over_rows, running, with_previous
from .folds import ordered_fold
from .scans import Cooldown, Decay, DeltaScale, Ema, scan
from .sliding import sliding

DAY_MS = 86_400_000


def flow_change(was, weights: tuple[float, ...] = (0.4, 0.25)) -> Column:
    """Weighted changes of bid less ask quantities by level; was gives the column of the row before (null: none, zeros)."""
    ofi, total = F.lit(0.0), sum(weights)
    old = lambda c: F.coalesce(was(c), F.lit(0.0))
    for i, w in enumerate(weights, 1):
        ofi = ofi + F.lit(w / total) * ((F.col(f"bid{i}_q") - old(f"bid{i}_q")) - (F.col(f"ask{i}_q") - old(f"ask{i}_q")))
    return ofi


#: A session ends with a gap of more than this, or with the UTC day.
SESSION_GAP_MS = 2000


def order_flow(book: DataFrame, weights: tuple[float, ...] = (0.4, 0.25)) -> DataFrame:
    """ofi: weighted changes of bid less ask quantities by level (the first row against zeros), and session_id: sessions end
    after a gap of more than 2 s or with the UTC day."""
    names = [f"{side}{i}_q" for i in range(1, len(weights) + 1) for side in ("bid", "ask")]
    rows = with_previous(book, ["ts_ms", *names])
    before = F.col("_prev.ts_ms")
    new = before.isNull() | (F.col("ts_ms") - before > SESSION_GAP_MS) | (F.expr(f"ts_ms div {DAY_MS}") != F.expr(f"_prev.ts_ms div {DAY_MS}"))
    rows = rows.withColumn("ofi", flow_change(lambda c: F.col(f"_prev.{c}"), weights)).withColumn("_new", new.cast("int")).drop("_prev")
    return running(rows, {"session_id": F.col("_new")}).drop("_new")


def price_jumps(book: DataFrame) -> DataFrame:
    """Running counts of rises and falls of the best bid and their summed sizes (bps)."""
    rows = with_previous(book, ["best_bid"])
    step = (F.col("best_bid") - F.col("_prev.best_bid")) / F.col("_prev.best_bid") * 1e4
    up, down = F.coalesce(step > 0, F.lit(False)), F.coalesce(step < 0, F.lit(False))
    return running(rows.withColumn("_step", F.abs(step)), {"ups": up.cast("int"), "downs": down.cast("int"), "impact_bps": F.coalesce("_step", F.lit(0.0))}).drop("_prev", "_step")


def prior_z(rows: DataFrame, value: str, window: int, least: int, population: bool = False, floor: float = 1e-4) -> DataFrame:
    """z of value against the mean and deviation of the `window` rows before; null until `least` of them."""
    w = lambda f: lambda o: f(value).over(o.rowsBetween(-window, -1))
    out = over_rows(rows, window, 0, {"_n1": w(F.count), "_m": w(F.avg), "_s": w(F.stddev_pop if population else F.stddev_samp)})
    z = F.when(F.col("_s") <= 1e-9, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s")) if population else (F.col(value) - F.col("_m")) / F.greatest("_s", F.lit(floor))
    return out.withColumn("z", F.when(F.col("_n1") >= least, z)).drop("_n1", "_m", "_s")


def tail_counts(rows: DataFrame, z: str, limit: float = 3.0) -> DataFrame:
    """z clipped, and running counts of |z| above 2 and 3 and of all z."""
    far = lambda x: F.coalesce((F.abs(z) > x).cast("int"), F.lit(0))
    out = running(rows, {"over_2": far(2), "over_3": far(3), "n_z": F.col(z).isNotNull().cast("int")})
    return out.withColumn(z, clip(F.col(z), limit))


def signed_volume(trades: DataFrame) -> DataFrame:
    """cvd: running sum of quantities, bought less sold; a missing side follows the price's direction."""
    rows = with_previous(trades.where("qty > 0"), ["price"])
    rows = rows.withColumn("side", F.coalesce("side", F.when(F.col("price") >= F.col("_prev.price"), "buy").otherwise("sell"))).drop("_prev")
    rows = rows.withColumn("delta", F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty")))
    return running(rows, {"cvd": F.col("delta")})


def tick_rule(trades: DataFrame, most: int = 5, age_ms: int = 2000) -> DataFrame:
    """tick_side fills a missing side: up buys, down sells; an equal price takes the last side, `most` times in a row (a move
    starts the count again) and age_ms after the trade before at most, else none, which starts the count again too. Trades
    that get no side leave no trace: the price, side and time before are those of the last trade with one. A fold."""

    def start():
        state = {"price": None, "side": None, "n": 0, "at": None}

        def step(ts, price, side):
            last = state["price"]
            if side is None and price is not None:
                if last is None:
                    state["n"] = 0
                elif price != last:
                    side, state["n"] = "buy" if price > last else "sell", 0
                else:
                    state["n"] += 1
                    if state["n"] <= most and (ts is None or state["at"] is None or ts - state["at"] <= age_ms):
                        side = state["side"]
                    else:
                        state["n"] = 0
            if side is not None:
                state.update(side=side, at=state["at"] if ts is None else ts, price=last if price is None else price)
            return (side,)

        return step

    return ordered_fold(trades, ["symbol"], ["ts_ms", "seq"], ["ts_ms", "price", "side"], start, "tick_side string")


def rolling_rates(rows: DataFrame, span_ms: int = 60_000) -> DataFrame:
    return over_range(rows, span_ms, {"n_60s": lambda w: F.count("*").over(w), "usd_60s": lambda w: F.sum(F.col("price") * F.col("qty")).over(w)})


def activity_rates(events: DataFrame, trade: Column, quote: Column, span_ms: int = 60_000, most_trades: int = 3000, most_quotes: int = 6000) -> DataFrame:
    """trade_rate (trades a minute) and quote_rate (quotes a second) of each event: those of the last span_ms so far, up to the
    latest most_trades and most_quotes; a rate that the event has itself stays. Events without a time get no rate of their own."""
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("double")
    flag = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    r = in_span(events, {"_nt": flag(trade), "_nq": flag(quote)}, span_ms)
    trades, quotes = F.least(F.lit(most_trades), F.col("_nt")), F.least(F.lit(most_quotes), F.col("_nq"))
    known = F.col("ts_ms").isNotNull()
    rates = {"trade_rate": F.coalesce(has("trade_rate"), F.when(known, trades.cast("double"))), "quote_rate": F.coalesce(has("quote_rate"), F.when(known, quotes / (span_ms / 1000)))}
    return r.withColumns(rates).drop("_nt", "_nq")


def filled_forward(seconds: DataFrame, price: str, most: int = 3600) -> DataFrame:
    """Per-second rows (symbol, second and others) and, between two of a symbol, the seconds without one: these have the price
    of the last row and filled true, null in other columns; of a gap of more than `most` seconds the last `most`. return_bps
    from the second before, and gap_second: a row after a gap of more than 1.5 s. Rows whose price is not above 0 go."""
    r = with_previous(seconds.where(F.col(price) > 0).withColumn("ts_ms", F.col("second") * 1000), ["second", price], order=())
    gap = F.col("second") - F.col("_prev.second")
    own = r.withColumn("filled", F.lit(False)).withColumn("gap_second", F.coalesce(gap > 1.5, F.lit(False))).withColumn("return_bps", (F.col(price) - F.col(f"_prev.{price}")) / F.col(f"_prev.{price}") * 1e4)
    missing = r.where(gap > 1).select("symbol", F.explode(F.sequence(F.greatest(F.col("_prev.second") + 1, F.col("second") - most), F.col("second") - 1)).alias("second"), F.col(f"_prev.{price}").alias(price))
    missing = missing.withColumns({"filled": F.lit(True), "gap_second": F.lit(False), "return_bps": F.lit(0.0)})
    return own.drop("_prev", "ts_ms").unionByName(missing, allowMissingColumns=True)


def trade_rate(rows: DataFrame, span_ms: int = 60_000) -> DataFrame:
    """tps: trades of the last span_ms a second, the span counted as 60 s at least."""
    return over_range(rows, span_ms, {"tps": lambda w: F.count("*").over(w) / F.greatest(F.lit(60.0), (F.col("ts_ms") - F.min("ts_ms").over(w)) / 1000)})


def activity_rate(rows: DataFrame, last: int = 100) -> DataFrame:
    """activity: (n - 1) / span in seconds over the last rows, null where they have one time."""
    w = lambda f: lambda o: f.over(o.rowsBetween(-(last - 1), 0))
    out = over_rows(rows, last - 1, 0, {"_k": w(F.count("*")), "_t": w(F.min("ts_ms"))})
    span = (F.col("ts_ms") - F.col("_t")) / 1000
    return out.withColumn("activity", F.when(span > 0, (F.col("_k") - 1) / span)).drop("_k", "_t")


def log_returns(rows: DataFrame) -> DataFrame:
    return with_previous(rows, ["price"]).withColumn("r", F.log(F.col("price") / F.col("_prev.price"))).drop("_prev")


def realised_vol(rows: DataFrame, last: int = 600) -> DataFrame:
    """Population deviation of the last log returns in bps, from running sums of them and their squares `last` rows apart."""
    r = F.coalesce("r", F.lit(0.0))
    has = F.col("r").isNotNull().cast("int")
    sums = running(log_returns(rows), {"_n0": has, "_s": r, "_q": r * r})
    back = lambda c: lambda o: F.col(c) - F.coalesce(F.lag(c, last).over(o), F.lit(0))
    out = over_rows(sums, last, 0, {"_a": back("_n0"), "_b": back("_s"), "_c": back("_q")})
    var = F.col("_c") / F.col("_a") - (F.col("_b") / F.col("_a")) ** 2
    return out.withColumn("vol_bps", F.when(F.col("_a") > 0, F.sqrt(F.greatest(var, F.lit(0.0))) * 1e4)).drop("r", "_n0", "_s", "_q", "_a", "_b", "_c")


def ema(rows: DataFrame, value: str, alpha: float, reset: str | None = None) -> DataFrame:
    """ema: exponentially weighted mean of each row's value and those before it, seeded by the symbol's first value (and anew
    where the number in `reset` changes); a null value leaves it as it is."""
    r = rows.withColumn("_reset", F.col(reset).cast("double") if reset else F.lit(0.0))
    return scan(r, ["symbol"], ["ts_ms", "seq"], [value, "_reset"], Ema(alpha), "ema double").drop("_reset")


def decayed_means(rows: DataFrame, value: str, halves_ms: tuple[int, ...] = (60_000, 600_000)) -> DataFrame:
    """Means of |value| that decay with time: a row weighs 1 - 2^(-dt / half), dt 1 ms at least; seeded by the first. A null
    value or time leaves them as they are."""
    names = ", ".join(f"decayed_{h // 1000}s double" for h in halves_ms)
    return scan(rows.withColumn("_size", F.abs(value)), ["symbol"], ["ts_ms", "seq"], ["ts_ms", "_size"], Decay(halves_ms), names).drop("_size")


def rolling_mad(rows: DataFrame, value: str, window: int = 200, least: int = 50, multiplier: float = 1.0) -> DataFrame:
    """mad: 1.4826 x multiplier x the median distance from the median (middle) of the last values; null with fewer than `least`."""
    out = sliding(rows, value, {"middle": "middle", "mad": "mad", "_n1": "count"}, last=window)
    return out.withColumn("mad", F.when(F.col("_n1") >= least, F.col("mad") * (1.4826 * multiplier))).drop("_n1")


def after_gaps(rows: DataFrame) -> DataFrame:
    """frozen: the row comes more than 5 s after the one before, or is one of the next two; or more than 4 s, or the next one."""
    r = with_previous(rows, ["ts_ms"]).withColumn("_gap", F.col("ts_ms") - F.col("_prev.ts_ms")).drop("_prev")
    w = lambda n: lambda o: F.max("_gap").over(o.rowsBetween(-n, 0))
    out = over_rows(r, 2, 0, {"_g2": w(2), "_g1": w(1)})
    return out.withColumn("frozen", F.coalesce(F.col("_g2") > 5000, F.lit(False)) | F.coalesce(F.col("_g1") > 4000, F.lit(False))).drop("_gap", "_g1", "_g2")


#: winsor limit and MAD multiplier by the symbol's currency (fixed values); others get the last pair.
CVD_LIMITS = {"BTC": (1.9, 1.75), "ETH": (2.3, 1.70), "": (2.0, 1.70)}


def cvd_delta_z(trades: DataFrame, freeze_min: int = 20, window: int = 200, fast_weight: float = 0.3, frozen_rows: bool = True) -> DataFrame:
    """Each trade's signed quantity (delta) over a scale: the decayed means of quantities mixed by the trade rate (the fast one
    weighs fast_weight, less when trades are rare), or the floor if that is larger: MAD of the last `window` deltas x 1.4826 x
    the symbol's multiplier, raised when trades are rare; winsorised. Null for a symbol's trades before the freeze_min-th and
    after gaps (over 5 s: this trade and two more; over 4 s: this and one more). tps and mode (ACTIVE above 2) go along.
    Without frozen_rows gaps leave no nulls: the estimate between updates. Trades without a price, a time or a quantity above
    0 go."""
    name = F.upper(F.coalesce("symbol", F.lit("")))
    by = lambda i: F.when(name.startswith("BTC"), CVD_LIMITS["BTC"][i]).when(name.startswith("ETH"), CVD_LIMITS["ETH"][i]).otherwise(CVD_LIMITS[""][i])
    rows = trades.where("qty > 0 and price is not null and ts_ms is not null")
    rows = rows.withColumns({"_side": F.when(F.col("side") == "buy", 1.0).when(F.col("side") == "sell", -1.0), "_limit": by(0), "_factor": by(1)})
    rule = DeltaScale(fast_weight, freeze_min, window, 4000, 5000, 2.0, frozen_rows)
    out = scan(rows, ["symbol"], ["ts_ms", "seq"], ["ts_ms", "price", "qty", "_side", "_limit", "_factor"], rule, "delta double, tps double, _busy double, z_cvd double")
    return out.withColumn("mode", F.when(F.col("_busy") > 0, "ACTIVE").otherwise("QUIET")).drop("_side", "_limit", "_factor", "_busy")


def winsorised_history_z(rows: DataFrame, value: str, window: int = 80, least: int = 16, k: float = 0.9) -> DataFrame:
    """z of value against earlier values that were themselves drawn in to k x MAD around their median (from 11 on) before they
    entered the history: recursive, so a fold."""

    def start():
        past: deque[float] = deque(maxlen=window)

        def step(v):
            if v is None:
                return (None, None)
            kept = v
            if len(past) > 10:
                s = sorted(past)
                middle = _median(s)
                mad = _median(sorted(abs(x - middle) for x in s))
                if mad > 0:
                    kept = min(max(v, middle - k * mad), middle + k * mad)
            z = None
            if len(past) >= least:
                mean = sum(past) / len(past)
                sd = math.sqrt(sum((x - mean) ** 2 for x in past) / (len(past) - 1))
                z = (v - mean) / max(sd, 1e-4)
            past.append(kept)
            return (kept, z)

        return step

    return ordered_fold(rows, ["symbol"], ["ts_ms", "seq"], [value], start, "kept double, z double")


def _median(s: list[float]) -> float:
    n = len(s)
    return (s[(n - 1) // 2] + s[n // 2]) / 2


def timed_z(rows: DataFrame, value: str, span_ms: int = 300_000, least: int = 10, floor: float = 0.3, limit: float = 2.5, most: int = 4096) -> DataFrame:
    """z of value against mean and population deviation of the last span_ms (and `most` rows), itself included; the deviation is
    at least floor x the robust scale (1.4826 x MAD, 1 if that is 0); clipped. With fewer than `least` values a hundredth of it."""
    out = sliding(rows, value, {"_c": "count", "_m": "mean", "_s": "deviation", "_d": "mad"}, last=most, span_ms=span_ms)
    robust = F.when(F.col("_d") > 0, F.col("_d") * 1.4826).otherwise(1.0)
    z = clip((F.col(value) - F.col("_m")) / F.greatest("_s", robust * floor), limit)
    return out.withColumn("z", F.when(F.col("_c") >= least, z).otherwise(F.col(value) / 100)).drop("_c", "_m", "_s", "_d")


def robust_z(rows: DataFrame, value: str, window: int = 4096, least: int = 10) -> DataFrame:
    """(value - median) / (1.4826 MAD) over the last rows, the scale 1 if the MAD is 0; a thousandth of the value with fewer than
    `least` values."""
    out = sliding(rows, value, {"_m": "middle", "_d": "mad", "_c": "count"}, last=window)
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_d") > 0, F.greatest(F.col("_d") * 1.4826, F.lit(1e-9))).otherwise(1.0)
    return out.withColumn("z", F.when(F.col("_c") >= least, z).otherwise(F.col(value) / 1000)).drop("_m", "_d", "_c")


def throttled(rows: DataFrame, gap_ms: int, *keys: str, order: tuple[str, ...] = ("ts_ms", "seq")) -> DataFrame:
    """The rows of each key that come gap_ms or more after the last row kept; the first is kept. Rows without a time go."""
    r = rows.withColumn("_one", F.lit(1.0))
    return scan(r, list(keys), list(order), [order[0], "_one"], Cooldown(gap_ms, only=True), "_kept long").drop("_one", "_kept")


def pivots(rows: DataFrame, value: str, reach: int, ahead: tuple[str, ...] = (), number: str | None = None) -> DataFrame:
    """Rows whose value is at least (kind high) or at most (low) all values of `reach` rows on either side; a row that is both
    stands there twice. Of a symbol's pivots of one kind and time the first counts. The columns `ahead` are those of the row
    `reach` rows on, at which the pivot is known."""
    over = lambda f, a, b: lambda o: f.over(o.rowsBetween(a, b))
    add = {}
    for name, a, b in (("b", -reach, -1), ("a", 1, reach)):
        add |= {f"_c{name}": over(F.count("*"), a, b), f"_x{name}": over(F.max(value), a, b), f"_m{name}": over(F.min(value), a, b)}
    add |= {f"known_{c}": (lambda o, c=c: F.lead(c, reach).over(o)) for c in ahead}
    out = over_rows(rows, reach, reach, add, number=number)
    v = F.col(value)
    full = (F.col("_cb") == reach) & (F.col("_ca") == reach)
    high, low = (v >= F.col("_xb")) & (v >= F.col("_xa")), (v <= F.col("_mb")) & (v <= F.col("_ma"))
    kinds = F.array_compact(F.array(F.when(full & high, F.lit("high")), F.when(full & low, F.lit("low"))))
    out = out.select(*rows.columns, *(f"known_{c}" for c in ahead), F.explode(kinds).alias("kind"))
    same = Window.partitionBy("symbol", "kind", "ts_ms").orderBy("seq")  # rows of one time
    return out.withColumn("_r", F.row_number().over(same)).where("_r = 1").drop("_r")


def divergence_score(before: Column, now: Column, was: Column, indicator: Column, apart: Column, reach: int, consistency: Column | None = None) -> Column:
    """0 to 100 for two pivots, from prices before and now, indicators was and now, and the rows between: .35 for the larger
    |indicator| (1 from 1.5 on, .7 from .7 on, else .3), .25 for distance (up to 2 reach) and size of the moves, .25, and .15 for
    consistency (from 0.3 on: .05 to .15)."""
    top = F.greatest(F.abs(was), F.abs(indicator))
    size = F.when(top >= 1.5, 1.0).when(top >= 0.7, 0.7).otherwise(0.3)
    moves = F.least(F.lit(1.0), (F.abs(now - before) / before + F.abs(indicator - was)) / 2)
    valid = (F.least(F.lit(1.0), apart / (2.0 * reach)) + moves) / 2
    c = F.lit(None).cast("double") if consistency is None else consistency
    bonus = F.when(c >= 0.3, 0.05 + (c - 0.3) / 0.7 * 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (0.35 * size + 0.25 * valid + 0.25 + 0.15 * bonus)))


def divergence_kind(low: Column, price: Column, indicator: Column) -> Column:
    """The name of a pair of pivots by the changes of price and indicator; null if they agree."""
    return F.when(low & (price < 0) & (indicator > 0), "bull_div").when(low & (price > 0) & (indicator < 0), "hidden_bull").when(~low & (price > 0) & (indicator < 0), "bear_div").when(~low & (price < 0) & (indicator > 0), "hidden_bear")


def divergences(rows: DataFrame, price: str, indicator: str, reach: int = 3, apart: int = 6, consistency: str | None = None) -> DataFrame:
    """Pairs of a symbol's successive price pivots of one kind, at least `apart` rows apart, whose price and indicator disagree:
    bull_div (lower low, higher indicator), hidden_bull, bear_div (higher high, lower indicator), hidden_bear; with
    divergence_score, and known_ms, known_seq of the row at which the pair is known. at_row numbers a symbol's rows; rows may
    have it already."""
    p = pivot_pairs(rows, price, [indicator], reach, apart, consistency)
    divergence, score = disagreement(0, reach, consistency)
    out = p.withColumn("divergence", divergence).withColumn("score", score)
    return out.where("divergence is not null").drop("_prev", "_now", "_own", *([f"known_{consistency}"] if consistency else []))


def pivot_pairs(rows: DataFrame, price: str, indicators: list[str], reach: int, apart: int, consistency: str | None = None) -> DataFrame:
    """A symbol's price pivots that are at least `apart` rows after the one of their kind before: _prev._now and _now have at_row, the
    price p and the indicators i0, i1, ... of both; known_ms, known_seq (and known_<consistency>) as in divergences()."""
    n = rows if "at_row" in rows.columns else numbered(rows, "at_row")
    ahead = ("ts_ms", "seq", *([consistency] if consistency else []))
    p = pivots(n, price, reach, ahead, "at_row").withColumnRenamed("known_ts_ms", "known_ms")
    p = p.withColumn("_now", F.struct("at_row", F.col(price).cast("double").alias("p"), *(F.col(c).cast("double").alias(f"i{k}") for k, c in enumerate(indicators))))
    p = with_previous(p.withColumn("_own", F.col("symbol")).withColumn("symbol", F.concat_ws("\x00", "kind", "symbol")), ["_now"]).withColumn("symbol", F.col("_own"))
    return p.where(F.col("at_row") - F.col("_prev._now.at_row") >= apart)


def disagreement(k: int, reach: int, consistency: str | None = None) -> tuple[Column, Column]:
    """divergence_kind and divergence_score of the k-th indicator of pivot_pairs()."""
    a, b = F.col("_prev._now"), F.col("_now")
    score = divergence_score(a["p"], b["p"], a[f"i{k}"], b[f"i{k}"], b["at_row"] - a["at_row"], reach, F.col(f"known_{consistency}") if consistency else None)
    return divergence_kind(F.col("kind") == "low", b["p"] - a["p"], b[f"i{k}"] - a[f"i{k}"]), score


def fusion(rows: DataFrame, w_ofi: float = 0.6, w_cvd: float = 0.4, limit: float = 4.0) -> Column:
    return clip(F.col("z_ofi") * w_ofi + F.col("z_cvd") * w_cvd, limit)
