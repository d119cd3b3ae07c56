"""Settings that hold from a time on: which ones a row finds in force, and rules under them.

A log of changes names a time and the values that change; values that it leaves out go
on. Rows find the last version at or before their time. A log whose count shows that it
is small is broadcast as intervals; a longer one is joined as-of in chunks of time, so
it may grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, consistency
from .chunks import last_known, latest, numbered

#: A log of so many versions at most is broadcast.
SMALL = 10_000

# Parameters of a scenario that a version leaves out, thresholds by regime, and those of the fusion.
SCENARIOS = ("A_H", "A_L", "Q_H", "Q_L")
SCENARIO_DEFAULTS = {"z_hi_long": 2.5, "z_hi_short": 2.5, "z_mid": 0.5, "tp_bps": 12.0, "sl_bps": 9.0}
REGIME_THRESHOLDS = {"base": (0.6, 1.2, -0.6, -1.2), "active": (0.5, 1.0, -0.5, -1.0), "quiet": (0.7, 1.4, -0.7, -1.4)}
FUSION_DEFAULTS = {"w_ofi": 0.6, "w_cvd": 0.4, "fuse_buy": 0.95, "fuse_strong_buy": 1.70, "fuse_sell": -0.95, "fuse_strong_sell": -1.70, "min_consistency": 0.12, "strong_min_consistency": 0.45}


def versions(changes: DataFrame, names: dict[str, float], order: tuple[str, ...] = ("from_ms",)) -> DataFrame:
    """from_ms and all of `names`, a row for each time of change: the last value so far that is not null, else the default. Of
    changes at one time the last in `order` that names a value counts."""
    at = changes.groupBy("from_ms").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in names))
    log = at.where("from_ms is not null").select(F.lit("").alias("symbol"), F.col("from_ms").alias("ts_ms"), *names)
    log = last_known(log, {f"_{c}": F.col(c) for c in names}, order=())
    return log.select(F.col("ts_ms").alias("from_ms"), *(F.coalesce(f"_{c}", F.lit(d)).alias(c) for c, d in names.items()))


def in_force(rows: DataFrame, log: DataFrame, key: str | None = None, small: int = SMALL) -> DataFrame:
    """rows with the columns of the log's last version at or before their ts_ms (with equal `key`, if given): null before the
    first and for rows without a time. The log has one row for each from_ms (and key), which comes back as from_ms."""
    values = [c for c in log.columns if c != key]
    if log.limit(small + 1).count() <= small:
        w = Window.partitionBy(*([key] if key else [])).orderBy("from_ms")  # over a small log
        spans = log.select(*values, *([F.col(key).alias("_key")] if key else []), F.lead("from_ms").over(w).alias("_to"))
        inside = (F.col("ts_ms") >= F.col("from_ms")) & (F.col("_to").isNull() | (F.col("ts_ms") < F.col("_to")))
        if key:
            inside = (rows[key] == F.col("_key")) & inside
        return rows.join(F.broadcast(spans), inside, "left").select(*[rows[c] for c in rows.columns], *values)
    own = F.col(key) if key else F.lit("")
    left = rows.select(F.struct(*rows.columns).alias("_row"), own.alias("symbol"), "ts_ms")
    right = log.select(own.alias("symbol"), F.col("from_ms").alias("ts_ms"), F.struct(*values).alias("_of"))
    return latest(left, right, F.col("_of"), "_v").select("_row.*", *(F.col(f"_v.{c}").alias(c) for c in values))


def weights(log: DataFrame) -> DataFrame:
    """w_ofi and w_cvd of each version scaled to add up to 1; where they do not add up to more than 0, those before hold."""
    total = F.col("w_ofi") + F.col("w_cvd")
    pair = F.when(total > 0, F.struct((F.col("w_ofi") / total).alias("a"), (F.col("w_cvd") / total).alias("b")))
    d = FUSION_DEFAULTS
    kept = last_known(log.withColumn("symbol", F.lit("")).withColumn("ts_ms", F.col("from_ms")), {"_pair": pair}, order=())
    first = F.struct(F.lit(d["w_ofi"]).alias("a"), F.lit(d["w_cvd"]).alias("b"))
    return kept.withColumn("_pair", F.coalesce("_pair", first)).withColumns({"w_ofi": F.col("_pair.a"), "w_cvd": F.col("_pair.b")}).select(*log.columns)


def regime_consistency(rows: DataFrame, by_regime: dict[str, tuple[float, float]]) -> DataFrame:
    """min_consistency and strong_min_consistency of rows with a regime and from_ms (the version they found): a regime named in
    by_regime sets both when a row enters it, and what it set goes on until the next such row or a later version. Rows without a
    time set nothing."""
    pair = F.lit(None).cast("struct<a: double, b: double>")
    for name, (a, b) in by_regime.items():
        pair = F.when(F.col("regime") == name, F.struct(F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"))).otherwise(pair)
    r = last_known(rows, {"_set": F.when(pair.isNotNull() & F.col("ts_ms").isNotNull(), F.struct(F.col("ts_ms").alias("t"), pair.alias("v")))})
    later = F.col("_set").isNotNull() & (F.col("from_ms").isNull() | (F.col("_set.t") >= F.col("from_ms")))
    own = {"min_consistency": "a", "strong_min_consistency": "b"}
    return r.withColumns({c: F.when(later, F.col(f"_set.v.{x}")).otherwise(F.col(c)) for c, x in own.items()}).drop("_set")


def fused_in_force(rows: DataFrame, changes: DataFrame, by_regime: dict[str, tuple[float, float]] | None = None, limit: float = 4.0, warm_up: int = 10, small: int = SMALL) -> DataFrame:
    """fusion and fusion_label of rows (symbol, ts_ms, seq, z_ofi, z_cvd, regime) under the weights and thresholds in force.
    changes: from_ms and any of FUSION_DEFAULTS' names, null where a change leaves one out."""
    names = FUSION_DEFAULTS
    given = changes.select("from_ms", *(F.col(c).cast("double").alias(c) if c in changes.columns else F.lit(None).cast("double").alias(c) for c in names))
    r = in_force(rows.where(F.col("z_ofi").isNotNull() & F.col("z_cvd").isNotNull()), weights(versions(given, names)), small=small)
    r = r.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in names.items()})
    if by_regime:
        r = regime_consistency(r, by_regime)
    r = numbered(r)
    s = F.when(F.col("_n") <= warm_up, 0.0).otherwise(clip(F.col("z_ofi") * F.col("w_ofi") + F.col("z_cvd") * F.col("w_cvd"), limit))
    r = r.withColumn("fusion", s).withColumn("consistency", consistency(F.col("z_ofi"), F.col("z_cvd"))).drop("_n")
    f, c = F.col("fusion"), F.col("consistency")
    firm, same = c > F.col("strong_min_consistency"), c > F.col("min_consistency")
    label = F.when((f > F.col("fuse_strong_buy")) & firm, "strong_buy").when((f < F.col("fuse_strong_sell")) & firm, "strong_sell")
    label = label.when((f > F.col("fuse_buy")) & same, "buy").when((f < F.col("fuse_sell")) & same, "sell").otherwise("neutral")
    return r.withColumn("fusion_label", label)


def filled_scenarios(given: DataFrame) -> DataFrame:
    """Scenario tables by version: from_ms, scenario and the parameters of SCENARIO_DEFAULTS. Of a version (all rows with one
    from_ms) the four known scenarios count; missing ones and missing values get the defaults. A version without a known
    scenario is dropped, so that the one before it goes on."""
    own = F.upper(F.trim("scenario"))
    known = given.where(own.isin(*SCENARIOS)).groupBy("from_ms", own.alias("scenario")).agg(*(F.max(F.col(c).cast("double")).alias(c) for c in SCENARIO_DEFAULTS))
    all_four = known.select("from_ms").distinct().withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIOS))))
    full = all_four.join(known, ["from_ms", "scenario"], "left")
    return full.select("from_ms", "scenario", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in SCENARIO_DEFAULTS.items()))


def scenario_parameters(rows: DataFrame, given: DataFrame, side: Column, small: int = SMALL) -> DataFrame:
    """z_hi (by side: long, else short), z_mid, tp_bps, sl_bps of rows with a scenario, and from_ms of the version (null: none
    yet, or no known scenario; then the defaults)."""
    r = in_force(rows, filled_scenarios(given), "scenario", small)
    d = SCENARIO_DEFAULTS
    z = F.when(side == "long", F.coalesce("z_hi_long", F.lit(d["z_hi_long"]))).otherwise(F.coalesce("z_hi_short", F.lit(d["z_hi_short"])))
    return r.withColumn("z_hi", z).withColumns({c: F.coalesce(c, F.lit(d[c])) for c in ("z_mid", "tp_bps", "sl_bps")}).drop("z_hi_long", "z_hi_short")


def regime_thresholds(regime: Column, table: dict[str, tuple[float, float, float, float]] | None = None) -> dict[str, Column]:
    """buy, strong_buy, sell and strong_sell of a regime; those of `base` where the table has none for it."""
    table = table or REGIME_THRESHOLDS
    pick = lambda i: reduce(lambda out, k: F.when(regime == k, F.lit(table[k][i])).otherwise(out), [k for k in table if k != "base"], F.lit(table["base"][i]))
    return {name: pick(i) for i, name in enumerate(("buy", "strong_buy", "sell", "strong_sell"))}


def least_consistency(regime: Column, scenario: Column, base: float, by_regime: dict[str, float], by_scenario: dict[str, float]) -> Column:
    """The smallest consistency asked for: a scenario with an offset has base + offset, else the regime's own value, else base."""
    out = F.lit(base)
    for k, v in by_regime.items():
        out = F.when(regime == k, F.lit(v)).otherwise(out)
    for k, v in by_scenario.items():
        out = F.when(scenario == k, F.lit(base + v)).otherwise(out)
    return out


def regime_direction(signals: DataFrame, base: float = 0.15, by_regime: dict[str, float] | None = None, by_scenario: dict[str, float] | None = None) -> DataFrame:
    """direction (1, -1, 0: the score at or beyond its regime's thresholds), firm (it reaches the strong one) and consistent (of
    signals with a regime, a scenario and a consistency)."""
    t = regime_thresholds(F.col("regime"))
    s = F.col("score")
    out = signals.withColumn("direction", F.when(s >= t["buy"], 1).when(s <= t["sell"], -1).otherwise(0)).withColumn("firm", (s >= t["strong_buy"]) | (s <= t["strong_sell"]))
    return out.withColumn("consistent", F.col("consistency") >= least_consistency(F.col("regime"), F.col("scenario"), base, by_regime or {}, by_scenario or {}))
