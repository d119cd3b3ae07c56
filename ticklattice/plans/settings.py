"""Queries of settings that change while the rows go by. The log of changes is made of the signals themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import consistency, regime, rounded
from ..operators import settings as SE
from .base import query

_CONS = "case when least(abs(z_ofi), abs(z_cvd)) < 1e-9 or sign(z_ofi) <> sign(z_cvd) then 0.0::double else least(abs(z_ofi), abs(z_cvd)) / greatest(abs(z_ofi), abs(z_cvd)) end"
_REGIME = "case when lag_sec >= 3 then 'active' when lag_sec >= 1 then 'normal' else 'quiet' end"
_FUSED = f""", ch as (select ts_ms as from_ms, seq, case when seq % 2 = 0 then abs(z_ofi) end as a, case when seq % 3 > 0 then abs(z_cvd) - 1 end as b, case when seq % 5 < 2 then 0.5::double + spread_bps / 30 end as buy,
    case when seq % 5 = 3 then 0.3::double + lag_sec / 20 end as firm from signals where seq % 29 = 0),
  g as (select from_ms, last(a order by seq) filter (a is not null) as a, last(b order by seq) filter (b is not null) as b, last(buy order by seq) filter (buy is not null) as buy, last(firm order by seq) filter (firm is not null) as firm from ch group by 1),
  v as (select from_ms, coalesce(last_value(a ignore nulls) over w, 0.6::double) as a, coalesce(last_value(b ignore nulls) over w, 0.4::double) as b, coalesce(last_value(buy ignore nulls) over w, 0.95::double) as buy, coalesce(last_value(firm ignore nulls) over w, 0.45::double) as firm
        from g window w as (order by from_ms rows between unbounded preceding and current row)),
  u as (select *, coalesce(last_value(case when a + b > 0 then a / (a + b) end ignore nulls) over w, 0.6::double) as wa, coalesce(last_value(case when a + b > 0 then b / (a + b) end ignore nulls) over w, 0.4::double) as wb from v window w as (order by from_ms rows between unbounded preceding and current row)),
  r as (select s.*, {_REGIME} as regime, u.from_ms, coalesce(wa, 0.6::double) as wa, coalesce(wb, 0.4::double) as wb, coalesce(buy, 0.95::double) as buy, coalesce(firm, 0.45::double) as firm, {_CONS} as c,
        row_number() over (partition by symbol order by s.ts_ms, seq) as n from signals s asof left join u on s.ts_ms >= u.from_ms),
  x as (select *, last_value(case when regime in ('active', 'quiet') then ts_ms end ignore nulls) over w as set_ms, last_value(case when regime in ('active', 'quiet') then regime end ignore nulls) over w as set_by from r
        window w as (partition by symbol order by ts_ms, seq rows between unbounded preceding and current row)),
  y as (select *, case when n <= 10 then 0.0::double else greatest(-4, least(4, z_ofi * wa + z_cvd * wb)) end as f, set_ms is not null and (from_ms is null or set_ms >= from_ms) as later from x),
  z as (select *, case when later then case set_by when 'active' then 0.1::double else 0.3::double end else 0.12::double end as lo, case when later then case set_by when 'active' then 0.4::double else 0.6::double end else firm end as hi from y)
"""


def _changes(s):
    k = F.col("seq")
    when = lambda test, x: F.when(test, x)
    return s.where(k % 29 == 0).select(F.col("ts_ms").alias("from_ms"), "seq", when(k % 2 == 0, F.abs("z_ofi")).alias("w_ofi"), when(k % 3 > 0, F.abs("z_cvd") - 1).alias("w_cvd"), when(k % 5 < 2, 0.5 + F.col("spread_bps") / 30).alias("fuse_buy"), when(k % 5 == 3, 0.3 + F.col("lag_sec") / 20).alias("strong_min_consistency"))


@query(_FUSED + """select seq, symbol, round(f, 6) + 0.0::double as fusion, case when f > 1.7 and c > hi then 'strong_buy' when f < -1.7 and c > hi then 'strong_sell' when f > buy and c > lo then 'buy' when f < -0.95 and c > lo then 'sell' else 'neutral' end as fusion_label from z""")
def switched_fusion(spark, sf_dir):
    s = S.signals(spark, sf_dir).withColumn("regime", regime(F.col("lag_sec")))
    changes = _changes(s).groupBy("from_ms").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("w_ofi", "w_cvd", "fuse_buy", "strong_min_consistency")))
    out = SE.fused_in_force(s, changes, {"active": (0.1, 0.4), "quiet": (0.3, 0.6)}, small=0)
    return out.select("seq", "symbol", (rounded(F.col("fusion")) + 0.0).alias("fusion"), "fusion_label")


_SCENARIO = "['A_H', 'A_L', 'Q_H', 'Q_L', 'x'][seq % 5 + 1]"


@query(f""", ch as (select ts_ms as from_ms, ['a_h', 'Q_L ', 'Q_H', 'bad'][seq % 4 + 1] as name, case when seq % 3 > 0 then z_ofi + 5 end as zl, case when seq % 3 < 2 then z_cvd + 5 end as zs, case when seq % 2 = 0 then spread_bps end as tp from signals where seq % 31 = 0),
  k as (select from_ms, upper(trim(name)) as scenario, max(zl) as zl, max(zs) as zs, max(tp) as tp from ch where upper(trim(name)) in ('A_H', 'A_L', 'Q_H', 'Q_L') group by 1, 2),
  f as (select a.from_ms, s.scenario, zl, zs, tp, true as there from (select distinct from_ms from k) a cross join (select unnest(['A_H', 'A_L', 'Q_H', 'Q_L']) as scenario) s left join k on k.from_ms = a.from_ms and k.scenario = s.scenario)
  select seq, g.symbol, g.scenario, f.from_ms, round(case when score > 0 then coalesce(zl, 2.5) else coalesce(zs, 2.5) end, 6) as z_hi, 0.5::double as z_mid, coalesce(tp, 12.0::double) as tp_bps, 9.0::double as sl_bps
  from (select *, {_SCENARIO} as scenario from signals) g asof left join f on g.scenario = f.scenario and g.ts_ms >= f.from_ms""")
def scenario_settings(spark, sf_dir):
    k = F.col("seq")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    s = S.signals(spark, sf_dir).withColumn("scenario", pick("A_H", "A_L", "Q_H", "Q_L", "x"))
    given = s.where(k % 31 == 0).select(F.col("ts_ms").alias("from_ms"), pick("a_h", "Q_L ", "Q_H", "bad").alias("scenario"), F.when(k % 3 > 0, F.col("z_ofi") + 5).alias("z_hi_long"), F.when(k % 3 < 2, F.col("z_cvd") + 5).alias("z_hi_short"), F.lit(None).cast("double").alias("z_mid"), F.when(k % 2 == 0, F.col("spread_bps")).alias("tp_bps"), F.lit(None).cast("double").alias("sl_bps"))
    out = SE.scenario_parameters(s, given, F.when(F.col("score") > 0, "long").otherwise("short"))
    return out.select("seq", "symbol", "scenario", "from_ms", rounded(F.col("z_hi")).alias("z_hi"), "z_mid", "tp_bps", "sl_bps")


@query(f"""select seq, symbol, case when score >= hi then 1 when score <= -hi then -1 else 0 end as direction, abs(score) >= 2 * hi as firm, c >= case scenario when 'A_H' then 0.15::double + 0.05::double else case regime when 'quiet' then 0.3::double else 0.15::double end end as consistent
  from (select *, case regime when 'active' then 0.5::double when 'quiet' then 0.7::double else 0.6::double end as hi from (select *, {_REGIME} as regime, {_SCENARIO} as scenario, {_CONS} as c from signals))""")
def regime_directions(spark, sf_dir):
    scenario = F.element_at(F.array(*map(F.lit, ("A_H", "A_L", "Q_H", "Q_L", "x"))), (F.col("seq") % 5 + 1).cast("int"))
    s = S.signals(spark, sf_dir).withColumn("regime", regime(F.col("lag_sec"))).withColumn("scenario", scenario).withColumn("consistency", consistency(F.col("z_ofi"), F.col("z_cvd")))
    return SE.regime_direction(s, 0.15, {"quiet": 0.3}, {"A_H": 0.05}).select("seq", "symbol", "direction", "firm", "consistent")
