"""Queries of rules, decisions and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import business_date, regime, rounded
from ..functions import rules as R
from ..operators import decisions as D
from ..operators import ledger as L
from ..operators import pretrade as PT
from ..operators import quality as Q
from .base import query


def _signals(spark, d):
    """signals with a scenario, a reason as text and a divergence."""
    s = S.signals(spark, d)
    k = F.col("seq")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    return s.withColumn("scenario", pick("A_H", "A_L", "Q_H", "Q_L", "x")).withColumn("reason", pick("Weak_Signal_x", "spread_bps>8", "reason:kill_switch", "lag_sec>1.5(2.1)", "component_warmup", "odd One!", "lagging")).withColumn("div_type", F.when(k % 11 == 0, "bull").when(k % 13 == 0, "none"))


_S = """, sg as (select *, ['A_H', 'A_L', 'Q_H', 'Q_L', 'x'][seq % 5 + 1] as scenario, ['Weak_Signal_x', 'spread_bps>8', 'reason:kill_switch', 'lag_sec>1.5(2.1)', 'component_warmup', 'odd One!', 'lagging'][seq % 7 + 1] as reason, case when seq % 11 = 0 then 'bull' when seq % 13 = 0 then 'none' end as div_type from signals)
"""


@query(_S + """select reason, count(*) as n, case lower(reason) when 'weak_signal_x' then 'weak_signal' when 'spread_bps>8' then 'spread' when 'component_warmup' then 'warmup' when 'lagging' then 'lag' when 'lag_sec>1.5(2.1)' then 'lag' else lower(reason) end as guard,
  case when reason like 'spread_bps>%' then 'spread_bps_exceeded' when reason like 'lag_sec>%' then 'lag_sec_exceeded' when reason like 'reason:%' then 'reason_' || substr(reason, 8) else reason end as gate, trim(regexp_replace(lower(reason), '[^a-z0-9]+', '_', 'g'), '_') as key from sg group by reason""")
def reason_names(spark, sf_dir):
    g = _signals(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))
    return g.select("reason", "n", R.guard_reason(F.col("reason")).alias("guard"), R.gate_reason(F.col("reason")).alias("gate"), R.reason_key(F.col("reason")).alias("key"))


@query("""select seq, round(1 / (1 + exp(-score)), 6) as p, case when 1 / (1 + exp(-score)) >= 0.7 then 'strong_buy' when 1 / (1 + exp(-score)) >= 0.6 then 'buy' when 1 / (1 + exp(-score)) <= 0.3 then 'strong_sell' when 1 / (1 + exp(-score)) <= 0.4 then 'sell' else 'neutral' end as label,
  round(abs(z_ofi - z_cvd), 6) as dispersion, case when (z_ofi >= 0) = (z_cvd >= 0) then 1 else -1 end as agree, case when score >= 1 then 'long' when score <= -1 then 'short' else 'skip' end as request from signals""")
def score_labels(spark, sf_dir):
    p = R.probability(F.col("score"))
    return S.signals(spark, sf_dir).select("seq", rounded(p).alias("p"), R.five_way(p).alias("label"), rounded(R.dispersion(F.col("z_ofi"), F.col("z_cvd"))).alias("dispersion"), R.sign_agree(F.col("z_ofi"), F.col("z_cvd")).alias("agree"), D.requested(F.col("score")).alias("request"))


@query("""select g, x as names, count(*) as n from (select ['true', 'false', '0', '3', '["a","b"]', 'warmup', null][seq % 7 + 1] as g, [['gated'], [], [], ['gated'], ['a', 'b'], ['warmup'], []][seq % 7 + 1] as l, array_to_string(l, ',') as x from signals) group by all""")
def gate_lists(spark, sf_dir):
    g = F.element_at(F.array(*map(F.lit, ("true", "false", "0", "3", '["a","b"]', "warmup", None))), (F.col("seq") % 7 + 1).cast("int"))
    return S.signals(spark, sf_dir).select(g.alias("g")).withColumn("names", F.array_join(R.gate_list(F.col("g")), ",")).groupBy("g", "names").agg(F.count("*").alias("n"))


@query("""select name, count(*) as n, case when name in ('a_h_3', 'A_H') then 'A_H' when name = 'q_l' then 'Q_L' else 'unknown' end as scenario from (select ['a_h_3', 'A_H', 'q_l', 'zz', 'A'][seq % 5 + 1] as name from signals) group by name""")
def scenario_names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("a_h_3", "A_H", "q_l", "zz", "A"))), (F.col("seq") % 5 + 1).cast("int"))
    return S.signals(spark, sf_dir).groupBy(name.alias("name")).agg(F.count("*").alias("n")).withColumn("scenario", R.scenario_of(F.col("name")))


@query("""select strftime(make_timestamp((ts_ms + 9 * 3600000 - 6 * 3600000) * 1000), '%Y-%m-%d') as day, count(*) as n from signals group by 1""")
def business_days(spark, sf_dir):
    return S.signals(spark, sf_dir).groupBy(business_date(F.col("ts_ms"), "Asia/Tokyo", 6).alias("day")).agg(F.count("*").alias("n"))


@query("""select seq, inside from (select seq, (m >= 22 * 60 or m < 150 or (m >= 600 and m < 720)) and dayofweek(t) between 1 and 5 and strftime(t, '%Y-%m-%d') not in ('1996-01-01', '1997-12-25') as inside from (select seq, make_timestamp(ts_ms * 1000) as t, hour(t) * 60 + minute(t) as m from signals))""")
def trading_hours(spark, sf_dir):
    return S.signals(spark, sf_dir).select("seq", R.in_windows(F.col("ts_ms"), ["22:00-02:30", "10:00-12:00"], (1, 2, 3, 4, 5), ("1996-01-01", "1997-12-25")).alias("inside"))


_JUDGED2 = _S + """, base as (select *, case when least(abs(z_ofi), abs(z_cvd)) < 1e-9 or sign(z_ofi) <> sign(z_cvd) then 0.0::double else least(abs(z_ofi), abs(z_cvd)) / greatest(abs(z_ofi), abs(z_cvd)) end as raw,
    case scenario when 'A_H' then 0.7::double when 'Q_L' then 0.4::double else 0.5::double end as weak, case scenario when 'A_H' then 0.15::double else 0.1::double end as least_c, case scenario when 'A_H' then 2 else 1 end as need from sg),
  rs as (select *, case when raw <= 0 and abs(score) >= 0.4 then 0.10::double when raw <= 0 and div_type is not null then 0.12::double else raw end as consistency from base),
  rr as (select *, case when abs(score) >= 1.5 then 'strong' when abs(score) >= weak then 'normal' else 'weak' end as tier, list_filter([case when warmup then 'warmup' end, case when spread_bps > 20 then 'spread_bps_exceeded' end, case when lag_sec > 3 then 'lag_sec_exceeded' end,
    case when consistency < least_c then 'low_consistency' end, case when abs(score) < weak then 'weak_signal' end], lambda x: x is not null) as reasons from rs),
"""
_STREAK = """  run as (select symbol, seq, row_number() over (partition by symbol, isl order by ts_ms, seq) as streak from (select *, sum(case when sg is distinct from was then 1 else 0 end) over (partition by symbol order by ts_ms, seq) as isl from (
    select *, sign(score) as sg, lag(sign(score)) over (partition by symbol order by ts_ms, seq) as was from gone where go))),
  fin as (select g.*, coalesce(streak, 0) as streak, go and coalesce(streak, 0) >= need as confirm from gone g left join run using (symbol, seq)),
  decided as (select *, case when go and not confirm then list_append(reasons, 'short_streak') else reasons end as why, case when score = 0 then 'neutral' when not confirm then 'pending' else case when abs(score) >= 1.5 then 'strong_' else '' end || case when score > 0 then 'buy' else 'sell' end end as signal_type from fin)
"""
_V1 = _JUDGED2 + "  gone as (select *, len(reasons) = 0 and score <> 0 as go from rr),\n" + _STREAK
_V2 = _JUDGED2 + """  gone as (select *, score <> 0 and not list_has_any(reasons, ['warmup', 'spread_bps_exceeded', 'lag_sec_exceeded']) and (tier = 'strong' or (tier = 'normal' and len(reasons) = 0)) as go from rr),
""" + _STREAK
_DECIDED = "select seq, symbol, round(consistency, 6) as consistency, tier as quality_tier, array_to_string(why, ',') as reasons, confirm, cast(streak as bigint) as streak, signal_type from decided"


def _v1(spark, d, tiers=False):
    return D.decided(_signals(spark, d), tiers=tiers)


def _shown(s):
    return s.select("seq", "symbol", rounded(F.col("consistency")).alias("consistency"), "quality_tier", F.array_join("reasons", ",").alias("reasons"), "confirm", "streak", "signal_type")


@query(_V1 + _DECIDED)
def signal_decisions(spark, sf_dir):
    return _shown(_v1(spark, sf_dir))


@query(_V2 + _DECIDED)
def tiered_decisions(spark, sf_dir):
    return _shown(_v1(spark, sf_dir, True))


@query(_V2 + "select tier as quality_tier, count(*) as n, count(*) filter (confirm) as confirmed, round(avg(confirm::int), 6) as rate from decided group by 1")
def tier_rates(spark, sf_dir):
    return _v1(spark, sf_dir, True).groupBy("quality_tier").agg(F.count("*").alias("n"), F.count_if("confirm").alias("confirmed"), rounded(F.avg(F.col("confirm").cast("int"))).alias("rate"))


@query(_V1 + """select mode, why_not, count(*) as n from (select 'strict' as mode, case when list_has_any(why, ['spread_bps_exceeded', 'lag_sec_exceeded']) then 'hard' when len(why) > 0 then 'gating' when not confirm then 'confirm' end as why_not from decided
  union all select 'ignore_soft', case when list_has_any(why, ['spread_bps_exceeded', 'lag_sec_exceeded']) then 'hard' when len(list_filter(why, lambda x: x not in ('weak_signal', 'low_consistency'))) > 0 then 'gating' when not confirm then 'confirm' end from decided
  union all select 'ignore_all', case when list_has_any(why, ['spread_bps_exceeded', 'lag_sec_exceeded']) then 'hard' when not confirm then 'confirm' end from decided) group by all""")
def tradeable_counts(spark, sf_dir):
    s, out = _v1(spark, sf_dir), None
    for mode in ("strict", "ignore_soft", "ignore_all"):
        w = R.untradeable(F.col("reasons"), F.col("confirm"), mode)
        one = s.select(F.lit(mode).alias("mode"), F.when(w.startswith("gating_hard_"), "hard").when(w.startswith("gating_"), "gating").when(w == "confirm_false", "confirm").alias("why_not"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mode", "why_not").agg(F.count("*").alias("n"))


@query(_V2 + """select mode, count(*) as n from (select unnest(list_filter([case when tier = 'strong' then 'conservative' end, case when tier in ('strong', 'normal') then 'balanced' end, 'aggressive', 'all', case when abs(score) >= 1 then 'legacy' end], lambda x: x is not null)) as mode from decided) group by 1""")
def quality_modes(spark, sf_dir):
    s = _v1(spark, sf_dir, True)
    names = D.reasons(*((R.in_quality(F.col("quality_tier"), m), m) for m in ("conservative", "balanced", "aggressive", "all")), (F.abs("score") >= 1, "legacy"))
    return s.select(F.explode(names).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query(_V1 + """select seq, case when signal_type like '%buy%' then 'buy' when signal_type like '%sell%' then 'sell' end as side, greatest(1, floor(cast(1000 / (100 + spread_bps) as decimal(28,8)) / 0.001)::bigint) as steps, left('c-' || symbol || '-' || ts_ms || '-' || seq, 36) as client_id from decided where confirm""")
def signal_orders(spark, sf_dir):
    o = D.orders(_v1(spark, sf_dir), 1000.0, 100 + F.col("spread_bps"))
    return o.select("seq", "side", F.round(F.col("qty") * 1000).cast("long").alias("steps"), "client_id")


@query(_S + """, r as (select *, case when lag_sec >= 3 then 'active' when lag_sec >= 1 then 'normal' else 'quiet' end as reg, score > 0 as up from sg),
  p as (select *, 880000000000 - ts_ms > 86400000::bigint * 1000 as old, case when not coalesce(div_type = 'bull', false) and not (abs(z_ofi) >= 1.5 and abs(z_cvd) >= 1.2) then 'FAIL_GATING' when reg = 'quiet' then 'BAD_REGIME' when abs(score) < case when reg = 'active' then 1.8 else 2.2 end then 'LOW_SCORE' else 'OK' end as code0 from r),
  n as (select *, row_number() over (partition by symbol, up order by ts_ms, seq) as n from p),
  e as (select symbol, up, n, seq, case when old then 'EXPIRE' else code0 end as code, case when not old and code0 = 'OK' then ts_ms + 604800000 else 0 end as until from n where n = 1 union all
    select n.symbol, n.up, n.n, n.seq, case when old then 'EXPIRE' when ts_ms < e.until then 'COOLDOWN' else code0 end, case when not old and ts_ms >= e.until and code0 = 'OK' then ts_ms + 604800000 else e.until end from e join n on n.symbol = e.symbol and n.up = e.up and n.n = e.n + 1)
  select seq, symbol, code from e""")
def engine_decisions(spark, sf_dir):
    s = _signals(spark, sf_dir).withColumn("regime", regime(F.col("lag_sec")))
    return D.decisions(s, F.lit(880000000000), 86_400_000_000, 604_800_000).select("seq", "symbol", "code")


@query("""select kind, count(*) as n from (select case when abs(z_ofi) < 0.5 and abs(z_cvd) < 0.5 then 'quiet' when (z_ofi > 0) = (z_cvd > 0) then 'trend' else 'revert' end as kind from signals) group by 1""")
def flow_regimes(spark, sf_dir):
    return S.signals(spark, sf_dir).groupBy(D.regime_of(F.col("z_ofi"), F.col("z_cvd")).alias("kind")).agg(F.count("*").alias("n"))


@query("""select seq, round(coalesce(case when seq % 4 = 0 then lag_sec end, case when seq % 4 = 1 then spread_bps / 60 end, case when seq % 4 = 2 then spread_bps / 600 end, case when seq % 8 = 3 then abs(score) end, 0), 6) as tps from signals""")
def imputed_activity(spark, sf_dir):
    k = F.col("seq")
    return S.signals(spark, sf_dir).select("seq", rounded(D.imputed_activity(F.when(k % 4 == 0, F.col("lag_sec")), F.when(k % 4 == 1, F.col("spread_bps")), F.when(k % 4 == 2, F.col("spread_bps")), F.when(k % 8 == 3, F.abs("score") * 1e6))).alias("tps"))


@query("""select code, count(*) as n from (select case when warmup then 'warmup' when spread_bps > 25 then 'critical_reason' when consistency < 0.15 then 'inconsistent' when consistency < 0.20 then 'throttled' when abs(score) < 0.5 then 'weak' else 'pass' end as code from scored) group by 1""")
def executor_prechecks(spark, sf_dir):
    s = D.confirmed(S.signals(spark, sf_dir))
    return s.groupBy(D.prechecked(F.col("warmup"), F.col("spread_bps") > 25, F.col("consistency"), F.abs("score") < 0.5).alias("code")).agg(F.count("*").alias("n"))


_ORDERS = """, o as (select seq, case when seq % 17 = 0 then null else symbol end as symbol, ['buy', 'sell', 'hold'][seq % 3 + 1] as side, case when seq % 19 = 0 then 0.0 else score + 2 end as qty, 100 + spread_bps as price, ts_ms, spread_bps, lag_sec, seq % 12 as tpm from signals)
"""


def _orders(spark, d):
    k = F.col("seq")
    side = F.element_at(F.array(*map(F.lit, ("buy", "sell", "hold"))), (k % 3 + 1).cast("int"))
    return S.signals(spark, d).select("seq", F.when(k % 17 != 0, F.col("symbol")).alias("symbol"), side.alias("side"), F.when(k % 19 == 0, 0.0).otherwise(F.col("score") + 2).alias("qty"), (100 + F.col("spread_bps")).alias("price"), "ts_ms", "spread_bps", "lag_sec", (k % 12).alias("tpm"))


@query(_ORDERS + """select fault, count(*) as n from (select unnest(list_filter([case when symbol is null then 'symbol' end, case when side not in ('buy', 'sell') then 'side' end, case when not qty > 0 then 'qty' end, case when not price > 0 then 'price' end], lambda x: x is not null)) as fault from o) group by 1""")
def order_faults(spark, sf_dir):
    return D.order_faults(_orders(spark, sf_dir)).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query(_ORDERS + """select fault, count(*) as n from (select unnest(list_filter([case when spread_bps > 8 then 'spread_bps' end, case when lag_sec > 1.5 then 'lag_sec' end, case when tpm > 10 then 'tpm' end, case when price * qty < 150 then 'notional' end, case when abs(coalesce(pos, 0) + case when side = 'buy' then qty else -qty end) > 30 then 'position' end], lambda x: x is not null)) as fault
  from o left join (select symbol, round(sum(score), 6) as pos from signals group by 1) using (symbol)) group by 1""")
def risk_faults(spark, sf_dir):
    pos = S.signals(spark, sf_dir).groupBy("symbol").agg(rounded(F.sum("score")).alias("position"))
    return D.risk_faults(_orders(spark, sf_dir), pos, 150.0, 30.0).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query("""select fill_id, floor(px::decimal(28,8) * 20 + 0.5)::bigint as price_ticks, floor(px::decimal(28,8) * 20)::bigint as down_ticks, greatest(1, floor((qty / 3)::decimal(28,8) * 4)::bigint) as qty_steps, cast(round_even(px * (1 + case when side = 'buy' then 1 else -1 end * 5 / 1e4::double) / 0.05::double, 0) as bigint) as cap_ticks from fills""")
def aligned_orders(spark, sf_dir):
    f = S.fills(spark, sf_dir)
    ticks = lambda x, t: F.round(x / t).cast("long")
    return f.select("fill_id", ticks(R.aligned_price(F.col("px"), "0.05"), 0.05).alias("price_ticks"), ticks(R.aligned_price(F.col("px"), "0.05", True), 0.05).alias("down_ticks"), ticks(R.aligned_qty(F.col("qty") / 3, "0.25"), 0.25).alias("qty_steps"), ticks(R.price_cap(F.col("px"), F.col("side"), 5.0, 0.05), 0.05).alias("cap_ticks"))


@query("""select fill_id, case when px * qty < 30000 then ceil((30000 / px)::decimal(28,8) / 0.5)::bigint end as half_units from fills""")
def notional_suggestions(spark, sf_dir):
    return S.fills(spark, sf_dir).select("fill_id", F.round(R.suggested_qty(F.col("px"), F.col("qty"), 30_000.0, "0.5") * 2).cast("long").alias("half_units"))


_COSTED = """, sc as (select *, case when slippage_bps > 5 then 'A' else 'Q' end || '_' || case when fee_bps >= 4 then 'H' else 'L' end as scenario from costs),
  mk as (select *, greatest(0, least(1, case scenario when 'Q_L' then 0.8::double when 'Q_H' then 0.6::double when 'A_L' then 0.5::double else 0.3::double end * case when slippage_bps < 1 then 0.8::double when slippage_bps > 5 then 1.2::double else 1 end * case when side = 'buy' then 1.05::double else 0.95::double end)) as p from sc)
"""


def _costed(spark, d):
    name = F.concat(F.when(F.col("slippage_bps") > 5, "A").otherwise("Q"), F.lit("_"), F.when(F.col("fee_bps") >= 4, "H").otherwise("L"))
    c = L.costs(S.fills(spark, d)).withColumn("scenario", name)
    return c.withColumn("p", L.maker_probability(F.col("scenario"), F.col("slippage_bps"), F.col("side")))


@query(_COSTED + """select scenario, side, count(*) as n, round(avg(p), 6) as maker, round(avg(greatest(2, 0.5 * slippage_bps + 0.3::double * fee_bps)), 6) as linear, round(avg(2 * case scenario when 'A_H' then 2.0 when 'A_L' then 1.5 when 'Q_H' then 1.2 else 1.0 end), 6) as piecewise,
  round(avg(case when notional >= 50000 then 3.0 when notional >= 20000 then 4.0 else 5.0 end), 6) as tiered, round(avg(p * 2 + (1 - p) * 5), 6) as maker_taker from mk group by 1, 2""")
def cost_models(spark, sf_dir):
    c, col = _costed(spark, sf_dir), F.col
    slip = lambda m: L.slippage_bps(m, 2.0, col("slippage_bps"), col("fee_bps"), col("scenario"))
    fee = lambda m: L.fee_bps(m, col("notional"), col("p"))
    return c.groupBy("scenario", "side").agg(F.count("*").alias("n"), rounded(F.avg("p")).alias("maker"), rounded(F.avg(slip("linear"))).alias("linear"), rounded(F.avg(slip("piecewise"))).alias("piecewise"), rounded(F.avg(fee("tiered"))).alias("tiered"), rounded(F.avg(fee("maker_taker"))).alias("maker_taker"))


@query(_V1 + """select seq from decided where confirm and (signal_type like 'strong%' or ('0x' || left(md5(seq::varchar), 8))::bigint / 4294967296.0 < 0.2)""")
def sampled_confirmations(spark, sf_dir):
    s = _v1(spark, sf_dir).where("confirm")
    return s.where(F.col("signal_type").startswith("strong") | (R.uniform(F.col("seq").cast("string")) < 0.2)).select("seq")


_GATES = """, lists as (select *, case when lag_sec >= 3 then 'active' when lag_sec >= 1 then 'normal' else 'quiet' end as regime, concat_ws(',', case when spread_bps > 20 then 'spread_bps>' || round(spread_bps)::int end, case when lag_sec > 3 then 'lag_sec>3.0' end, case when seq % 5 = 0 then ' reason:low_consistency_throttle' end,
    case when seq % 7 = 0 then 'reason:code' || seq % 3 end, case when seq % 9 = 0 then 'reverse_cooldown_' || seq % 4 end, case when warmup then 'warmup' end, case when seq % 13 = 0 then ' ' end) as gates from signals)
"""


@query(_GATES + """select regime, ts_ms // 60000 % 1440 // 360 as part, gate, count(*) as n from (select *, case when trim(gates, ', ') = '' then 'unknown' when g like 'spread_bps>%' then 'spread_bps_exceeded' when g like 'lag_sec>%' then 'lag_sec_exceeded' when g = 'reason:low_consistency_throttle' then 'low_consistency' when g like 'reason:%' then 'reason_' || substr(g, 8)
    when g like 'reverse_cooldown%' then 'reverse_cooldown' else g end as gate from (select *, trim(unnest(string_split(gates, ','))) as g from lists) where g <> '' or trim(gates, ', ') = '') group by all""")
def gate_breakdown(spark, sf_dir):
    k, s = F.col("seq"), S.signals(spark, sf_dir)
    text = lambda *x: F.concat(*x)
    gates = F.concat_ws(
        ",", F.when(F.col("spread_bps") > 20, text(F.lit("spread_bps>"), F.round("spread_bps").cast("int").cast("string"))), F.when(F.col("lag_sec") > 3, "lag_sec>3.0"), F.when(k % 5 == 0, " reason:low_consistency_throttle"),
        F.when(k % 7 == 0, text(F.lit("reason:code"), (k % 3).cast("string"))), F.when(k % 9 == 0, text(F.lit("reverse_cooldown_"), (k % 4).cast("string"))), F.when(F.col("warmup"), "warmup"), F.when(k % 13 == 0, " "),
    )
    s = s.select(regime(F.col("lag_sec")).alias("regime"), F.expr("ts_ms div 60000 % 1440 div 360").alias("part"), F.explode(R.gate_reasons(gates)).alias("gate"))
    return s.groupBy("regime", "part", "gate").agg(F.count("*").alias("n"))


@query("""select code, count(*) as n from (select case when status in (400, 404) then 'E_PARAMS' when status in (401, 403) then 'E_BROKER_REJECT' when status in (418, 429) then 'E_RATE_LIMIT' when status in (500, 502, 503, 504) then 'E_NETWORK' when venue between -1106 and -1100 or venue in (-1111, -1112, -1114, -1121, -1125, -1130) then 'E_PARAMS'
    when venue in (-2010, -2011, -2013, -2014, -2015, -2019, -2021) then 'E_BROKER_REJECT' when venue in (-1003, -1006, -1007) then 'E_RATE_LIMIT' when venue in (-2012, -2022) then 'E_STATE_CONFLICT' when venue in (-1021, -1022) then 'E_NETWORK' when regexp_matches(t, 'timeout|timed out|connection') then 'E_NETWORK'
    when regexp_matches(t, 'rate limit|too many requests|429|418') then 'E_RATE_LIMIT' when regexp_matches(t, 'insufficient|balance|margin') then 'E_BROKER_REJECT' when regexp_matches(t, 'invalid|bad request|400|not found|404') then 'E_PARAMS' when regexp_matches(t, 'conflict|already exists|duplicate') then 'E_STATE_CONFLICT' else 'E_UNKNOWN' end as code
  from (select case when seq % 3 = 0 then 398 + seq % 110 end as status, case when seq % 4 = 0 then -1000 - seq % 140 when seq % 4 = 1 then -2008 - seq % 17 end as venue, lower(case seq % 6 when 0 then 'Order ' || seq || ' rejected: price too low' when 1 then 'symbol ' || seq || ' Not Found' when 2 then 'Margin is insufficient for ' || seq when 3 then 'order ' || seq || ' already exists' when 4 then 'read timed out after ' || seq end) as t from signals)) group by 1""")
def error_kinds(spark, sf_dir):
    k = F.col("seq")
    t = k.cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit("Order "), t, F.lit(" rejected: price too low"))).when(k % 6 == 1, F.concat(F.lit("symbol "), t, F.lit(" Not Found"))).when(k % 6 == 2, F.concat(F.lit("Margin is insufficient for "), t))
    text = text.when(k % 6 == 3, F.concat(F.lit("order "), t, F.lit(" already exists"))).when(k % 6 == 4, F.concat(F.lit("read timed out after "), t))
    venue = F.when(k % 4 == 0, -1000 - k % 140).when(k % 4 == 1, -2008 - k % 17)
    return S.signals(spark, sf_dir).groupBy(R.error_code(text, F.when(k % 3 == 0, 398 + k % 110), venue).alias("code")).agg(F.count("*").alias("n"))


@query("""select state, count(*) as n, max(day) as last from (select case o_orderstatus when 'F' then 'filled' when 'O' then 'open' else 'partial' end as state, cast(o_orderdate as varchar)[:10] as day from orders) group by 1""")
def order_states(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "NEW").otherwise("PARTIALLY_FILLED")
    return o.groupBy(R.order_state(status).alias("state")).agg(F.count("*").alias("n"), F.substring(F.max("o_orderdate").cast("string"), 1, 10).alias("last"))


# quality

@query(""", x as (select *, case when seq % 23 = 0 then null else price end as p2, seq // 2 as row_id from tape), j as (select *, row_number() over (partition by row_id order by seq) as n from x)
  select reason, count(*) as n from (select unnest(case when len(r) = 0 then ['ok'] else r end) as reason from (select list_filter([case when p2 is null then 'missing_price' end, case when side is null then 'missing_side' end, case when p2 < 101 then 'price' end, case when n > 1 then 'duplicate' end], lambda v: v is not null) as r from j)) group by 1""")
def gate_report(spark, sf_dir):
    t = S.tape(spark, sf_dir).withColumn("price", F.when(F.col("seq") % 23 != 0, F.col("price"))).withColumn("row_id", F.expr("seq div 2"))
    return Q.gate(t, ["price", "side"], ["row_id"], ["seq"], [(F.col("price") < 101, "price")])[2]


@query("""select seq from (select *, row_number() over (partition by symbol, ts_ms // 1000 order by ts_ms, seq) as n from trades) where n = 1""")
def first_of_second(spark, sf_dir):
    return Q.keep_first(S.trades(spark, sf_dir).withColumn("s", F.expr("ts_ms div 1000")), ["symbol", "s"], "ts_ms", "seq").select("seq")


@query("""select seq from (select *, row_number() over (partition by symbol, k order by seq desc) as n from tape) where n = 1""")
def last_of_id(spark, sf_dir):
    return Q.keep_last(S.tape(spark, sf_dir), ["symbol", "k"]).select("seq")


@query(""", f as (select * from (select *, row_number() over (partition by symbol, ts_ms order by seq) as n from tape) where n = 1)
  select a.seq from f a where not exists (select 1 from f b where b.symbol = a.symbol and b.k = a.k and b.seq <> a.seq and b.ts_ms between a.ts_ms - 30000 and a.ts_ms)""")
def deduplicated_window(spark, sf_dir):
    return Q.within_window(S.tape(spark, sf_dir), "k", 30_000).select("seq")


@query("""select symbol, count(*) as rows, count(*) filter (t is null) as missing, count(*) filter (bad) as backward, coalesce(array_to_string(list_sort(list(seq) filter (bad and nth <= 3)), ','), '') as first_three from (
  select *, row_number() over (partition by symbol, bad order by seq) as nth from (select *, coalesce(t < lag(t) over (partition by symbol order by seq), false) as bad from (select seq, symbol, case when seq % 101 = 0 then null else ts_ms end as t from signals))) group by 1""")
def order_audit(spark, sf_dir):
    return Q.order_faults(S.signals(spark, sf_dir).withColumn("ts_ms", F.when(F.col("seq") % 101 != 0, F.col("ts_ms"))))


@query("""select name, count(*) as rows, round(avg((v is null)::int), 6) as missing, round(avg((v = 0)::int), 6) as zero, round(avg(v), 6) as mean from (select 'price' as name, price as v from tape union all select 'qty', case when seq % 5 = 0 then null else qty end from tape) group by 1""")
def value_audit(spark, sf_dir):
    a = Q.audit(S.tape(spark, sf_dir).withColumn("qty", F.when(F.col("seq") % 5 != 0, F.col("qty"))), ["price", "qty"])
    return a.select("name", "rows", *(rounded(F.col(c)).alias(c) for c in ("missing", "zero", "mean")))


_FILES = ", files as (select symbol, ts_ms // 600000 as f, min(ts_ms) as start_ms, max(ts_ms) as end_ms from trades where ts_ms // 600000 % 7 <> 3 group by 1, 2)\n"


@query(_FILES + """select symbol, count(*) as files, count(*) filter (gap > 5) as gaps, round(coalesce(sum(gap) filter (gap > 5), 0), 4) as gap_min, case when count(*) filter (gap > 5) = 0 then 'GOOD' when count(*) filter (gap > 5) <= 3 then 'FAIR' else 'POOR' end as grade from (
  select *, (start_ms - max(end_ms) over (partition by symbol order by start_ms, end_ms rows between unbounded preceding and 1 preceding)) / 60000 as gap from files) group by 1""")
def file_continuity(spark, sf_dir):
    f = S.trades(spark, sf_dir).groupBy("symbol", F.expr("ts_ms div 600000").alias("f")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms")).where("f % 7 <> 3")
    return Q.continuity(f).withColumn("gap_min", F.round("gap_min", 4))


@query(_S + """select s.symbol, k.kind, round(count(*) filter (s.scenario = k.kind) / count(*), 6) as share, count(*) filter (s.scenario = k.kind) / count(*) < 0.205 as missed from sg s cross join (select unnest(['A_H', 'A_L', 'Q_H', 'Q_L']) as kind) k group by 1, 2""")
def scenario_coverage(spark, sf_dir):
    return Q.coverage(_signals(spark, sf_dir), "scenario", R.SCENARIOS, 0.205).withColumn("share", rounded(F.col("share")))


@query("""select src as kind, count(*) filter (side is not null) as ok, count(*) filter (side is null) as bad, round(avg((side is null)::int), 6) as ratio from tape group by 1""")
def quality_summary(spark, sf_dir):
    bad = F.col("side").isNull()
    return S.tape(spark, sf_dir).groupBy(F.col("src").alias("kind")).agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("bad"), rounded(F.avg(bad.cast("int"))).alias("ratio"))


@query(_S + """select symbol, ts_ms // 8640000000 as span, count(*) as n, round(avg((scenario = 'x')::int), 6) as unknown, case when count(*) < 10 then 'few_rows' when avg((scenario = 'x')::int) > 0.2 then 'many_unknown' else 'ok' end as verdict from sg group by 1, 2""")
def robustness_guard(spark, sf_dir):
    s = _signals(spark, sf_dir).withColumn("span", F.expr("ts_ms div 8640000000"))
    return Q.robustness(s, F.col("scenario") == "x", "symbol", "span", most=0.2).withColumn("unknown", rounded(F.col("unknown")))


@query("""select symbol, cast(sum(('0x' || left(sha256(seq || '|' || symbol || '|' || ts_ms), 15))::hugeint) as varchar) as fingerprint, count(*) as n from signals group by 1""")
def run_fingerprint(spark, sf_dir):
    return Q.fingerprint(S.signals(spark, sf_dir), ["seq", "symbol", "ts_ms"], "symbol")


@query("""select seq, 'signal/v2' as schema_version, coalesce(case when seq % 6 = 0 then 'own-' || seq end, 'unknown-' || symbol || '-' || ts_ms || '-' || seq) as signal_id, case when score > 0 then 'buy' when score < 0 then 'sell' else 'flat' end as side_hint, gating, 60000::bigint as expiry_ms,
    coalesce(code, case when confirm and gating = 1 then 'OK' when gating = 0 then 'FAIL_GATING' else 'LOW_SCORE' end) as decision_code, case when code is not null then 'given' when confirm and gating = 1 then 'score>=entry' when gating = 0 then coalesce(why, 'gating failed') else 'score<entry' end as decision_reason
  from (select *, coalesce(case when seq % 4 = 0 then 1 end, confirm::int) as gating, case when seq % 9 = 0 then 'EXPIRE' end as code, case when seq % 5 < 3 then 'lag' end as why from (select *, abs(score) >= 1 and lag_sec < 3 as confirm from signals))""")
def upgraded_signals(spark, sf_dir):
    k = F.col("seq")
    s = S.signals(spark, sf_dir).withColumn("confirm", (F.abs("score") >= 1) & (F.col("lag_sec") < 3)).withColumn("gating", F.when(k % 4 == 0, 1)).withColumn("gate_reason", F.when(k % 5 < 3, "lag"))
    s = s.withColumn("signal_id", F.when(k % 6 == 0, F.concat(F.lit("own-"), k.cast("string")))).withColumn("decision_code", F.when(k % 9 == 0, "EXPIRE")).withColumn("decision_reason", F.when(k % 9 == 0, "given"))
    return D.upgraded(s).select("seq", "schema_version", "signal_id", "side_hint", "gating", "expiry_ms", "decision_code", "decision_reason")


_CHECKED = """, o as (select seq, case when seq % 17 > 0 then symbol end as symbol, case seq % 23 when 0 then 'hold' when 1 then '' else case when seq % 2 = 0 then 'buy' else 'sell' end end as side, case when seq % 3 = 0 then 'market' else 'limit' end as order_type, case when seq % 19 = 0 then -1.0::double else round(50 * abs(score) + 0.123, 3) end as qty,
    case when seq % 13 > 0 then round(100 + spread_bps + z_ofi, 2) end as price, case when seq % 29 = 0 then 'odd' end as account_mode, 5.0::double as slip, spread_bps / 3 as spread, case when seq % 31 > 0 then lag_sec / 2 else -1 end as lag, seq % 60 as tpm from signals),
  r as (select symbol, case when symbol <> 'C3' then 2000.0::double end as min_notional, case when symbol <> 'C4' then 0.5::double end as step, case when symbol <> 'C5' then 0.25::double end as tick, case when symbol = 'C1' then 60.0::double end as most from (select distinct symbol from signals)),
  j as (select o.*, min_notional, step, tick, most, round_even(qty / step, 0) * step as aq, round_even(price / tick, 0) * tick as ap from o left join r using (symbol)),
  w as (select *, case when symbol is null then ['missing_required_field', 'symbol'] else list_concat(case when e = [] then [] else ['invalid_schema'] end, e) end as wrong from (select *, list_concat(case when side = '' then ['missing_required_field', 'side'] else [] end, case when qty <= 0 then ['invalid_field_type', 'qty'] else [] end,
    case when side not in ('buy', 'sell') then ['invalid_enum_value', 'side=' || side] else [] end, case when account_mode is not null then ['invalid_enum_value', 'account_mode=odd'] else [] end, case when order_type = 'limit' and price is null then ['missing_required_field', 'price (required for limit orders)'] else [] end, case when lag < 0 then ['invalid_field_type', 'guards.event_lag_sec'] else [] end) as e from j)),
  y as (select *, len(wrong) = 0 as fine, coalesce(qty * price < min_notional, false) as small, coalesce(price is not null and abs(qty - aq) > 1e-10, false) as offs, coalesce(abs(price - ap) > 1e-10, false) as offt, coalesce(qty * price > 20000, false) as large, coalesce(price is not null and qty > most, false) as over_ from w)
"""


@query(_CHECKED + """select seq, array_to_string(case when fine then list_filter([case when spread > 8 then 'spread_too_wide' end, case when lag > 1.5 then 'lag_exceeds_cap' end, case when tpm < 10 then 'market_inactive' end, case when small then 'notional_below_min' end, case when offs then 'qty_not_aligned_to_step_size' end,
    case when offt then 'price_not_aligned_to_tick_size' end, case when large then 'notional_exceeds_limit' end, case when over_ then 'symbol_qty_exceeds_limit' end], lambda x: x is not null) else wrong end, ',') as reasons, round(case when fine and small then min_notional / price end, 6) as min_qty, round(case when fine then mq end, 6) as max_qty,
    round(case when fine and offs then case when mq is not null then least(aq, mq) else aq end end, 6) as final_qty, round(case when fine and order_type = 'limit' and price is not null then case when not offt then cap when side = 'buy' then least(cap, ap) else greatest(cap, ap) end end, 6) as price_cap
  from (select *, case when large and over_ then least(20000 / price, most) when large then 20000 / price when over_ then most end as mq, round_even(price * (1 + case when side = 'buy' then 1 else -1 end * slip / 1e4::double) / 0.01::double, 0) * 0.01::double as cap from y)""")
def checked_orders(spark, sf_dir):
    k, s = F.col("seq"), S.signals(spark, sf_dir)
    side = F.when(k % 23 == 0, "hold").when(k % 23 == 1, "").otherwise(F.when(k % 2 == 0, "buy").otherwise("sell"))
    o = s.select(
        "seq", F.when(k % 17 > 0, F.col("symbol")).alias("symbol"), side.alias("side"), F.when(k % 3 == 0, "market").otherwise("limit").alias("order_type"), F.when(k % 19 == 0, -1.0).otherwise(F.round(50 * F.abs("score") + 0.123, 3)).alias("qty"),
        F.when(k % 13 > 0, F.round(100 + F.col("spread_bps") + F.col("z_ofi"), 2)).alias("price"), F.when(k % 29 == 0, "odd").alias("account_mode"), F.lit(5.0).alias("max_slippage_bps"),
        (F.col("spread_bps") / 3).alias("spread_bps"), F.when(k % 31 > 0, F.col("lag_sec") / 2).otherwise(-1.0).alias("event_lag_sec"), (k % 60).cast("double").alias("activity_tpm"),
    )
    is_not = lambda x, v: F.when(F.col("symbol") != x, v)
    rules = s.select("symbol").distinct().select("symbol", is_not("C3", 2000.0).alias("min_notional"), is_not("C4", 0.5).alias("step_size"), is_not("C5", 0.25).alias("tick_size"), F.when(F.col("symbol") == "C1", 60.0).alias("max_qty"))
    c = PT.checked_orders(o, rules, tick=0.01)
    return c.select("seq", F.array_join("reasons", ",").alias("reasons"), *(rounded(F.col(x)).alias(x) for x in ("min_qty", "max_qty", "final_qty", "price_cap")))
