"""Labels, streaks, latches, cooldowns and alerts along a symbol's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, consistency
from .chunks import last_known, numbered, over_range, over_rows, running, settled, with_previous
from .folds import ordered_fold
from .indicators import disagreement, pivot_pairs, throttled
from .scans import Cooldown, scan
from .sliding import sliding


def fusion_parts(w_ofi: float = 0.6, w_cvd: float = 0.4, limit: float = 4.0, most_lag: float = 0.25) -> tuple[Column, Column]:
    """Score and consistency of z_ofi and z_cvd: weights are normalised, the sum is clipped. With a lag above most_lag one factor
    counts (the larger) and consistency is 1."""
    total = w_ofi + w_cvd
    a, b = F.col("z_ofi"), F.col("z_cvd")
    late = F.coalesce(F.col("lag_sec") > most_lag, F.lit(False))
    both = a * (w_ofi / total) + b * (w_cvd / total)
    single = F.when(F.abs(a) >= F.abs(b), a).otherwise(b)
    return clip(F.when(late, single).otherwise(both), limit), F.when(late, 1.0).otherwise(consistency(a, b))


def fusion_label() -> Column:
    """Five ways from fusion and consistency, by strict thresholds."""
    s, c = F.col("fusion"), F.col("consistency")
    side = F.when(s > 0, "buy").otherwise("sell")
    return F.when((F.abs(s) > 2.0) & (c > 0.5), F.concat(F.lit("strong_"), side)).when((F.abs(s) > 1.0) & (c > 0.2), side).otherwise("neutral")


def fused(rows: DataFrame, w_ofi: float = 0.6, w_cvd: float = 0.4, limit: float = 4.0, most_lag: float = 0.25, warm_up: int = 10) -> DataFrame:
    """fusion and consistency of rows with both z (fusion_parts); a symbol's first warm_up rows score 0. And fusion_label."""
    score, same = fusion_parts(w_ofi, w_cvd, limit, most_lag)
    out = numbered(rows.where(F.col("z_ofi").isNotNull() & F.col("z_cvd").isNotNull())).withColumn("consistency", same)
    out = out.withColumn("fusion", F.when(F.col("_n") <= warm_up, 0.0).otherwise(score)).drop("_n")
    return out.withColumn("fusion_label", fusion_label())


class Denoiser:
    """The state machine of denoised(): step(ts, score, consistency) gives -1, 0 or 1; state is (way, run, at, last)."""

    def __init__(self, least: float, drop_to: float, streak: int, cooldown_ms: int, boost: float, throttle: float, state: tuple = (0, 0, None, 0)):
        self.least, self.drop_to, self.streak, self.cooldown_ms, self.boost, self.throttle = least, drop_to, streak, cooldown_ms, boost, throttle
        self.way, self.run, self.at, self.last = state

    @property
    def state(self) -> tuple:
        return self.way, self.run, self.at, self.last

    def step(self, ts, score, same) -> int:
        score, same = score or 0.0, same or 0.0
        way = (score > 0) - (score < 0)
        if abs(score) < (self.drop_to if way == self.way else self.least):
            way = 0
        self.run = self.run + 1 if way and way == self.way else int(way != 0)
        self.way = way
        wait = self.cooldown_ms / 2 if same > self.boost else self.cooldown_ms
        if not way or same < self.throttle or self.run < (self.streak - 1 if same > self.boost else self.streak):
            return 0
        if self.at is not None and way == self.last and ts - self.at < wait:
            return 0
        self.at, self.last = ts, way
        return way


def denoised(rows: DataFrame, least: float = 1.0, drop_to: float = 0.6, streak: int = 2, cooldown_ms: int = 3000, boost: float = 0.7, throttle: float = 0.3) -> DataFrame:
    """signal (-1, 0, 1) of rows with fusion and consistency. A direction holds from `least` down to drop_to (hysteresis); a
    consistency above `boost` needs one row less in a streak, one below `throttle` gives none; after a signal the same
    direction waits cooldown_ms, half of it above `boost`, while the other direction may follow at once. A fold."""

    def start():
        machine = Denoiser(least, drop_to, streak, cooldown_ms, boost, throttle)
        return lambda *row: (machine.step(*row),)

    return ordered_fold(rows, ["symbol"], ["ts_ms", "seq"], ["ts_ms", "fusion", "consistency"], start, "signal int")


def conflicts(rows: DataFrame, z: float = 1.5, cooldown_ms: int = 60_000) -> DataFrame:
    """Rows where z_ofi and z_cvd are both beyond z and point apart (ofi_up or ofi_down), each kind once in cooldown_ms at
    most: the wait starts with a row that is kept."""
    found = rows.where((F.abs("z_ofi") >= z) & (F.abs("z_cvd") >= z) & (F.signum("z_ofi") != F.signum("z_cvd")))
    found = found.withColumn("conflict", F.when(F.col("z_ofi") > 0, "ofi_up").otherwise("ofi_down"))
    return throttled(found, cooldown_ms, "symbol", "conflict")


def flow_events(rows: DataFrame, reach: int = 12, apart: int = 6, cooldown_ms: int = 1000, warm_up: int = 100, most_lag: float = 0.3, z_hi: float = 1.5, z_mid: float = 0.7) -> DataFrame:
    """Divergence and conflict events of rows with price, z_ofi, z_cvd (clipped to 5), fusion, consistency, warmup and lag_sec: event,
    channel, score, with_conflict, confidence.

    At each row the pairs of price pivots that have just become known are held against the three channels; the best score is
    the row's event (ties: ofi, cvd, fusion, lows first), or none if an event of its type and channel was less than cooldown_ms
    ago. A row with |z_ofi| >= z_hi and |z_cvd| >= z_mid of opposite signs is a conflict: it adds 10 to the row's event, or is
    an event itself (score 60), unless a conflict was an event less than cooldown_ms ago. Rows of a warm-up (so marked, or the
    first warm_up - 1) have confidence 0.3, late ones (lag_sec above most_lag) 0.5: their divergences' scores are multiplied by it.
    Rows without a price, a time or one of both z go."""
    five = lambda c: clip(F.col(c), 5.0)
    r = rows.where("price > 0 and z_ofi is not null and z_cvd is not null and ts_ms is not null").withColumns({c: five(c) for c in ("z_ofi", "z_cvd", "fusion")})
    r = settled(numbered(r, "at_row"))
    # both z have their pivots in the same rows; those of fusion are numbered among themselves
    apart_rows = pivot_pairs(r, "price", ["z_ofi", "z_cvd"], reach, apart)
    fusions = pivot_pairs(r.where("fusion is not null").drop("at_row"), "price", ["fusion"], reach, apart, "consistency")
    found = None
    for pairs, channels, same in ((apart_rows, ("ofi", "cvd"), None), (fusions, ("fusion",), "consistency")):
        each = []
        for k, channel in enumerate(channels):
            divergence, score = disagreement(k, reach, same)
            rank = -2 if channel == "fusion" else -k
            each.append(F.when(divergence.isNotNull(), F.struct(score.alias("score"), F.lit(rank).alias("r"), (F.col("kind") == "low").alias("l"), divergence.alias("event"), F.lit(channel).alias("channel"))))
        d = pairs.where("known_ms is not null").select("symbol", F.col("known_seq").alias("seq"), (F.greatest(*each) if len(each) > 1 else each[0]).alias("_d")).where("_d is not null")
        found = d if found is None else found.unionByName(d)
    best = found.groupBy("symbol", "seq").agg(F.max("_d").alias("_d")).withColumnsRenamed({"symbol": "_s", "seq": "_q"})
    n = settled(r.join(best, r["symbol"].eqNullSafe(best["_s"]) & (r["seq"] == best["_q"]), "left").drop("_s", "_q"))
    own = n.where("_d is not null").withColumns({"_event": F.col("_d.event"), "_channel": F.col("_d.channel"), "_one": F.lit(1.0)})
    own = scan(own, ["symbol", "_event", "_channel"], ["ts_ms", "seq"], ["ts_ms", "_one"], Cooldown(cooldown_ms), "_first long")
    kept = F.col("_first") == 2
    own = own.withColumns({"_event": F.when(kept, F.col("_event")), "_channel": F.when(kept, F.col("_channel"))}).drop("_first", "_one")
    apart_ = (F.abs("z_ofi") >= z_hi) & (F.abs("z_cvd") >= z_mid) & (F.signum("z_ofi") * F.signum("z_cvd") < 0)
    none = F.lit(None).cast("string")
    both = n.where("_d is null").withColumns({"_event": none, "_channel": none}).unionByName(own)
    both = settled(both.where(F.col("_event").isNotNull() | apart_).withColumns({"_alone": (apart_ & F.col("_event").isNull()).cast("double"), "_apart": apart_}))
    both = scan(both, ["symbol"], ["ts_ms", "seq"], ["ts_ms", "_alone"], Cooldown(cooldown_ms), "_wait long")
    both = both.where(F.col("_event").isNotNull() | (F.col("_wait") == 2))
    with_ = F.col("_event").isNotNull() & F.col("_apart") & (F.col("_wait") == 0)
    trust = F.when(F.coalesce(F.col("warmup"), F.lit(False)) | (F.col("at_row") < warm_up), 0.3).when(F.col("lag_sec") > most_lag, 0.5).otherwise(1.0)
    alone = F.col("_event").isNull()
    score = F.when(alone, 60.0).otherwise(F.least(F.lit(100.0), F.col("_d.score") + F.when(with_, 10.0).otherwise(0.0)) * trust)
    out = both.withColumn("event", F.coalesce("_event", F.lit("ofi_cvd_conflict"))).withColumn("channel", F.col("_channel")).withColumn("score", score).withColumn("with_conflict", with_)
    return out.withColumn("confidence", F.when(alone, 1.0).otherwise(trust)).select(*rows.columns, "event", "channel", "score", "with_conflict", "confidence")


def observation_gaps(seconds: DataFrame, limit: int = 2) -> DataFrame:
    """For each symbol of per-second rows: mean and largest gap to the second before, and the share above limit."""
    r = with_previous(seconds.withColumn("ts_ms", F.col("second") * 1000), ["second"], order=())
    gap = F.col("second") - F.col("_prev.second")
    return r.groupBy("symbol").agg(F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.avg((gap > limit).cast("int")).alias("bad_rate"), F.count_if(gap > limit).alias("bad"))


def tape_scenarios(rows: DataFrame, span_ms: int = 300_000, most: int = 300, first_limit: float = 0.1, split: float = 0.5) -> DataFrame:
    """scenario of each trade, over the trades of the last span_ms (and `most`, itself included). A or Q: their number a second
    against the larger of 0.05 and 0.3 x the mean of that rate at the ten trades before (first_limit for the first). H or L:
    the mean of their relative price moves against 0.6 x the moves' quantile `split`, L below ten prices."""
    r = with_previous(rows.where("price is not null and ts_ms is not null"), ["price", "ts_ms"])
    r = r.withColumn("_move", F.abs(F.col("price") - F.col("_prev.price")) / F.col("_prev.price")).withColumn("_from", F.col("_prev.ts_ms")).drop("_prev")
    # a move belongs to the window while the trade before it does
    r = sliding(r, "_move", {"_k": "count", "_m": "mean", "_p": (split,)}, last=most - 1, span_ms=span_ms, at="_from", now="ts_ms")
    r = r.withColumn("_tps", (F.coalesce("_k", F.lit(0.0)) + 1) / (span_ms / 1000))
    r = over_rows(r, 10, 0, {"_t": lambda o: F.avg("_tps").over(o.rowsBetween(-10, -1))})
    active = F.col("_tps") >= F.coalesce(F.greatest(F.lit(0.05), 0.3 * F.col("_t")), F.lit(first_limit))
    high = F.coalesce((F.col("_k") >= 9) & (F.col("_m") >= 0.6 * F.col("_p")), F.lit(False))
    return r.withColumn("scenario", F.concat(F.when(active, "A").otherwise("Q"), F.lit("_"), F.when(high, "H").otherwise("L"))).drop("_t", "_m", "_p", "_k", "_tps", "_move", "_from")


def events(rows: DataFrame) -> DataFrame:
    """One row for each rule that a row meets: conflict, divergence, anomaly, price_jump (more than 5 % from the row before)."""
    r = with_previous(rows, ["price"])
    a, b = F.col("z_ofi"), F.col("z_cvd")
    apart = F.signum(a) != F.signum(b)
    jump = F.abs(F.col("price") - F.col("_prev.price")) / F.col("_prev.price") > 0.05
    rules = [((F.abs(a) > 2) & (F.abs(b) > 1) & apart, "conflict"), ((F.abs(a) > 2.5) & (F.abs(b) > 2.5) & apart, "divergence"), ((F.abs(a) > 3) | (F.abs(b) > 2.5), "anomaly"), (jump, "price_jump")]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in rules)))
    return r.withColumn("event", F.explode(found)).drop("_prev")


def streaks(rows: DataFrame, sign: Column, to: str = "streak") -> DataFrame:
    """Adds how many rows in a row, this one included, have the same sign; 0 where it is 0 or null."""
    r = rows.withColumn("_sign", F.coalesce(F.signum(sign), F.lit(0.0)))
    r = with_previous(r, ["_sign"]).withColumn("_new", F.coalesce(F.col("_prev._sign") != F.col("_sign"), F.lit(True)).cast("int")).drop("_prev")
    r = running(r, {"_island": F.col("_new"), "_k": F.lit(1)})
    w = Window.partitionBy("symbol", "_island")  # an island is a run of equal signs
    n = F.col("_k") - F.min("_k").over(w) + 1
    return r.withColumn(to, F.when(F.col("_sign") == 0, 0).otherwise(n).cast("long")).drop("_sign", "_new", "_island", "_k")


def latched(rows: DataFrame, active: Column, on: int, off: int) -> DataFrame:
    """mode: ACTIVE from the `on`-th active row in a row until the `off`-th inactive one in a row; QUIET before. A null counts as
    inactive. The last run that was long enough decides, so runs are counted and the last such row is carried on."""
    way = F.coalesce(active.cast("boolean"), F.lit(False))
    r = streaks(rows.withColumn("_active", way), F.when(F.col("_active"), 1).otherwise(-1), "_run")
    turn = F.when(F.col("_active") & (F.col("_run") >= on), "ACTIVE").when(~F.col("_active") & (F.col("_run") >= off), "QUIET")
    return last_known(r, {"mode": turn}).withColumn("mode", F.coalesce("mode", F.lit("QUIET"))).drop("_active", "_run")


def mode_times(rows: DataFrame) -> DataFrame:
    """For each symbol and mode: milliseconds until the next row spent in it, rows, and how often it was entered."""
    r = with_previous(rows, ["mode", "ts_ms"])
    spent = r.select("symbol", F.col("_prev.mode").alias("mode"), (F.col("ts_ms") - F.col("_prev.ts_ms")).alias("ms"), F.lit(0).alias("n"), F.lit(0).alias("entered")).where("mode is not null")
    entered = F.coalesce(F.col("_prev.mode") != F.col("mode"), F.lit(True)).cast("int")
    own = r.select("symbol", "mode", F.lit(0).alias("ms"), F.lit(1).alias("n"), entered.alias("entered"))
    return spent.unionByName(own).groupBy("symbol", "mode").agg(*(F.sum(c).cast("long").alias(c) for c in ("ms", "n", "entered")))


def market_active(rows: DataFrame, span_ms: int = 60_000, least_trades: int = 3, most_spread: float = 8.0, share: float = 0.5) -> DataFrame:
    """active: at least least_trades in the last span_ms (first gate), and their median qty, drawn in to its 10th and 90th
    percentiles, reaches share of its mean (second gate). Trades of one time are in each other's span. The window stays sorted,
    with the sums of what lies below both percentiles."""
    r = sliding(rows, "qty", {"_k": "count", "_w": lambda w: w.drawn(0.1, 0.9)[0], "_m": lambda w: w.drawn(0.1, 0.9)[1]}, span_ms=span_ms, peers=True)
    return r.withColumn("active", (F.coalesce("_k", F.lit(0.0)) >= least_trades) & (F.col("_w") >= share * F.col("_m"))).drop("_k", "_w", "_m")


def stale(rows: DataFrame, now_ms: Column, limits_ms: dict[str, int]) -> DataFrame:
    """For each symbol and kind (src): the age of its last row at now_ms, and whether it is above the kind's limit."""
    last = rows.groupBy("symbol", "src").agg(F.max("ts_ms").alias("last_ms")).withColumn("age_ms", now_ms - F.col("last_ms"))
    limit = F.lit(None).cast("long")
    for k, v in limits_ms.items():
        limit = F.when(F.col("src") == k, v).otherwise(limit)
    return last.withColumn("stale", F.coalesce(F.col("age_ms") > limit, F.lit(False)))


def alert_spells(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Spells in which a rule holds, row by row: symbol, alert, triggered_ms, recovered_ms (the first row at which it no longer
    holds; null if it still does) and rows."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("alert"), F.coalesce(test, F.lit(False)).alias("_on")) for name, test in rules.items())))
    r = rows.select("symbol", "ts_ms", "seq", each.alias("_x")).select("symbol", "ts_ms", "seq", "_x.*")
    r = r.withColumn("_of", F.col("symbol")).withColumn("symbol", F.concat_ws("\x00", "alert", "symbol"))  # all rules in one pass
    r = with_previous(r, ["_on"]).withColumn("_edge", (F.coalesce(F.col("_prev._on"), F.lit(False)) != F.col("_on")).cast("int")).drop("_prev")
    r = running(r, {"_spell": F.col("_edge")})
    # odd numbers are spells; the even one after it begins where the spell ends
    pair = F.expr("(_spell + cast(_on as int)) div 2")
    s = r.groupBy("symbol", pair.alias("_pair")).agg(F.first("_of").alias("_of"), F.first("alert").alias("alert"), F.min(F.when(F.col("_on"), F.col("ts_ms"))).alias("triggered_ms"), F.min(F.when(~F.col("_on"), F.col("ts_ms"))).alias("recovered_ms"), F.count_if("_on").alias("rows"))
    return s.where("rows > 0").select(F.col("_of").alias("symbol"), "alert", "triggered_ms", "recovered_ms", "rows")


def in_cooldown(rows: DataFrame, exits: DataFrame, cooldown_ms: int) -> DataFrame:
    """cooling: the symbol's last exit at or before the row is less than cooldown_ms old."""
    from .alignment import as_of

    once = exits.select("symbol", "ts_ms").distinct()
    out = as_of(rows, once, [], cooldown_ms, "_exit_")
    return out.withColumn("cooling", F.coalesce(F.col("ts_ms") - F.col("_exit_ts") < cooldown_ms, F.lit(False))).drop("_exit_ts")
