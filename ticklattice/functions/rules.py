"""Column functions of trading rules: reasons, sides, prices, quantities, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mean the same reason, in the order in which prefixes are tried.
GUARD_NAMES = {"weak_signal": "weak_signal", "weak_signal_throttle": "weak_signal", "warmup": "warmup", "component_warmup": "warmup", "low_consistency": "low_consistency", "spread": "spread", "lag": "lag", "activity": "activity", "other": "other"}
SOFT_REASONS = ("weak_signal", "low_consistency")
HARD_REASONS = ("fallback", "price_cache_failed", "no_price", "spread_bps_exceeded", "lag_sec_exceeded", "kill_switch", "guarded")
SCENARIOS = ("A_H", "A_L", "Q_H", "Q_L")


def any_of(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def gate_list(x: Column) -> Column:
    """Reasons from a text that holds a JSON list, a truth value, a number or a reason: no text, false and 0 give none, true
    and other numbers the reason `gated`."""
    t = F.trim(F.coalesce(x, F.lit("")))
    parsed = F.from_json(t, "array<string>")
    return F.when(F.lower(t).isin("", "false", "null", "0"), F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).when(F.lower(t).isin("true") | t.rlike("^-?[0-9.]+$"), any_of("gated")).otherwise(F.array(t))


def probability(score: Column, k: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-k * score))


def five_way(p: Column) -> Column:
    return F.when(p >= 0.7, "strong_buy").when(p >= 0.6, "buy").when(p <= 0.3, "strong_sell").when(p <= 0.4, "sell").otherwise("neutral")


def dispersion(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def sign_agree(a: Column, b: Column) -> Column:
    """1 if both are at least 0 or both below, else -1."""
    return F.when((a >= 0) == (b >= 0), 1).otherwise(-1)


def scenario_of(name: Column) -> Column:
    """The first two parts of a scenario's name, or unknown."""
    two = F.concat_ws("_", F.slice(F.split(F.upper(name), "_"), 1, 2))
    return F.when(two.isin(*SCENARIOS), two).otherwise("unknown")


def guard_reason(reason: Column) -> Column:
    """One name for a reason: an exact name, else the first that it begins with, else itself in lower case."""
    r = F.lower(F.trim(reason))
    out = r
    for k, v in reversed(GUARD_NAMES.items()):
        out = F.when(r.startswith(k), v).otherwise(out)
    for k, v in GUARD_NAMES.items():
        out = F.when(r == k, v).otherwise(out)
    return out


# What reasons of the fusion are called as gates.
FUSION_REASONS = {"low_consistency_throttle": "low_consistency", "lag_exceeded": "lag_sec_exceeded", "warmup": "component_warmup", "degraded_ofi_only": "degraded_ofi_only", "degraded_cvd_only": "degraded_cvd_only"}


def gate_reason(reason: Column) -> Column:
    """One name for a reason of a gate: limits of spread and lag become *_exceeded, `reason:code` the code's name as a gate or
    reason_code, all reverse cooldowns one; others stay. No reason is unknown."""
    r = F.trim(F.coalesce(reason, F.lit("")))
    code = F.trim(F.regexp_replace(r, "reason:", ""))
    named = F.concat(F.lit("reason_"), code)
    for k, v in FUSION_REASONS.items():
        named = F.when(code == k, v).otherwise(named)
    exceeded = F.when(r.startswith("spread_bps>"), "spread_bps_exceeded").when(r.startswith("lag_sec>"), "lag_sec_exceeded")
    return exceeded.when(r.startswith("reason:"), named).when(r.startswith("reverse_cooldown"), "reverse_cooldown").when(r == "", "unknown").otherwise(r)


def gate_reasons(listed: Column) -> Column:
    """The names of a comma-separated list; of an empty one, unknown."""
    parts = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, any_of("unknown")).otherwise(F.transform(parts, gate_reason))


def reason_key(reason: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(reason), "[^a-z0-9]+", "_"), "^_|_$", "")


def decided_side(signal_type: Column, side_hint: Column, score: Column) -> Column:
    """The side that the type names, else the hint, else the score's sign if beyond 0.1."""
    named = F.when(signal_type.contains("buy"), "buy").when(signal_type.contains("sell"), "sell")
    hint = F.when(F.lower(side_hint).isin("buy", "sell"), F.lower(side_hint))
    return F.coalesce(named, hint, F.when(score > 0.1, "buy").when(score < -0.1, "sell"))


def untradeable(gating: Column, confirm: Column, mode: str = "strict") -> Column:
    """Why a signal can't be traded, or null. Hard reasons block in every mode; ignore_soft leaves out soft ones, ignore_all all
    others."""
    hard = F.array_intersect(gating, any_of(*HARD_REASONS))
    rest = {"strict": gating, "ignore_soft": F.array_except(gating, any_of(*SOFT_REASONS)), "ignore_all": F.array().cast("array<string>")}[mode]
    return F.when(F.size(hard) > 0, F.concat(F.lit("gating_hard_"), F.array_join(hard, ","))).when(F.size(rest) > 0, F.concat(F.lit("gating_"), F.array_join(rest, ","))).when(~F.coalesce(confirm, F.lit(False)), "confirm_false")


def in_quality(tier: Column, mode: str) -> Column:
    return {"conservative": tier == "strong", "balanced": tier.isin("strong", "normal"), "aggressive": tier.isin("strong", "normal", "weak"), "all": F.lit(True)}[mode]


def aligned_price(price: Column, tick: str, down: bool = False) -> Column:
    """The nearest multiple of the tick (halves up), or the one below."""
    t = F.lit(tick).cast("decimal(18,8)")
    n = price.cast("decimal(28,8)") / t
    return ((F.floor(n) if down else F.round(n, 0)).cast("decimal(20,0)") * t).cast("double")


def aligned_qty(qty: Column, step: str, least_one: bool = True) -> Column:
    """The multiple of the step below, one step at least if asked for."""
    s = F.lit(step).cast("decimal(18,8)")
    n = F.floor(qty.cast("decimal(28,8)") / s).cast("decimal(20,0)")
    return ((F.greatest(n, F.lit(1).cast("decimal(20,0)")) if least_one else n) * s).cast("double")


def suggested_qty(price: Column, qty: Column, least_notional: float, step: str) -> Column:
    """Null if the notional suffices, else the smallest multiple of the step that does."""
    s = F.lit(step).cast("decimal(18,8)")
    need = F.ceil((F.lit(least_notional) / price).cast("decimal(28,8)") / s).cast("decimal(20,0)") * s
    return F.when(price * qty < least_notional, need.cast("double"))


def price_cap(price: Column, side: Column, bps: float | Column, tick: float | None = None) -> Column:
    """The worst price for a slippage of bps; with a tick its nearest multiple (halves to the even one)."""
    cap = price * (1 + F.when(side == "buy", 1).otherwise(-1) * bps / 1e4)
    return F.bround(cap / tick, 0) * tick if tick else cap


def uniform(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


# Error codes by HTTP status, by the venue's code, and by words of the message (the first that is found).
HTTP_ERRORS = {
    "E_PARAMS": (400, 404), "E_BROKER_REJECT": (401, 403), "E_RATE_LIMIT": (418, 429), "E_NETWORK": (500, 502, 503, 504),
}
VENUE_ERRORS = {
    "E_PARAMS": (-1100, -1101, -1102, -1103, -1104, -1105, -1106, -1111, -1112, -1114, -1121, -1125, -1130),
    "E_BROKER_REJECT": (-2010, -2011, -2013, -2014, -2015, -2019, -2021), "E_RATE_LIMIT": (-1003, -1006, -1007),
    "E_STATE_CONFLICT": (-2012, -2022), "E_NETWORK": (-1021, -1022),
}
MESSAGE_ERRORS = (
    ("E_NETWORK", ("timeout", "timed out", "connection")), ("E_RATE_LIMIT", ("rate limit", "too many requests", "429", "418")),
    ("E_BROKER_REJECT", ("insufficient", "balance", "margin")), ("E_PARAMS", ("invalid", "bad request", "400")), ("E_PARAMS", ("not found", "404")),
    ("E_STATE_CONFLICT", ("conflict", "already exists", "duplicate")),
)


def _coded(code: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for name, codes in table.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def message_error(text: Column) -> Column:
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("E_UNKNOWN")
    for name, words in reversed(MESSAGE_ERRORS):
        found = F.lit(False)
        for w in words:
            found = found | t.contains(w)
        out = F.when(found, name).otherwise(out)
    return out


def error_code(text: Column, status: Column | None = None, venue: Column | None = None) -> Column:
    """The code of a failed request: by its HTTP status, else by the venue's code, else by words of its message, else E_UNKNOWN."""
    known = [_coded(c, t) for c, t in ((status, HTTP_ERRORS), (venue, VENUE_ERRORS)) if c is not None]
    return F.coalesce(*known, message_error(text))


def order_state(status: Column) -> Column:
    s = F.upper(status)
    return F.when(s.isin("NEW", "ACK", "ACCEPTED"), "open").when(s == "PARTIALLY_FILLED", "partial").when(s == "FILLED", "filled").when(s.isin("CANCELED", "EXPIRED", "PENDING_CANCEL"), "canceled").when(s == "REJECTED", "rejected").otherwise("unknown")


def minute_of(text: str) -> int:
    """Minutes after midnight of HH:MM."""
    h, m = text.split(":")
    return int(h) * 60 + int(m)


def in_windows(ts_ms: Column, windows: list[str], weekdays: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7), holidays: tuple[str, ...] = ()) -> Column:
    """Whether the UTC time is in one of the windows (HH:MM-HH:MM, end exclusive, past midnight if the end comes first), on a
    weekday (1 Monday) and no holiday (yyyy-MM-dd)."""
    at = F.timestamp_millis(ts_ms)
    minute = F.hour(at) * 60 + F.minute(at)
    inside = F.lit(False)
    for w in windows:
        a, b = map(minute_of, w.split("-"))
        inside = inside | (((minute >= a) & (minute < b)) if a <= b else ((minute >= a) | (minute < b)))
    day = F.weekday(at) + 1
    return inside & day.isin(*weekdays) & ~F.date_format(at, "yyyy-MM-dd").isin(*(holidays or ("",)))
