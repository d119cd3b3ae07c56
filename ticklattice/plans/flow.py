"""Queries of indicators and states along the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import consistency, rounded
from ..operators import alignment as A
from ..operators import decisions as D
from ..operators import indicators as I
from ..operators import states as ST
from .base import query

_OFI = """, ofis as (select *, round(0.4::double / 0.65::double * ((bid1_q - coalesce(lag(bid1_q) over w, 0)) - (ask1_q - coalesce(lag(ask1_q) over w, 0)))
    + 0.25::double / 0.65::double * ((bid2_q - coalesce(lag(bid2_q) over w, 0)) - (ask2_q - coalesce(lag(ask2_q) over w, 0))), 9) as ofi from book window w as (partition by symbol order by ts_ms, seq))
"""
_N = """, t as (select * replace (round(price, 0) as price), row_number() over (partition by symbol order by ts_ms, seq) as n from trades)
"""
_SIGNED = """, signed as (select *, row_number() over (partition by symbol order by ts_ms, seq) as n, case when s2 = 'buy' then qty else -qty end as delta from (
    select *, coalesce(side, case when price >= lag(price) over (partition by symbol order by ts_ms, seq) then 'buy' else 'sell' end) as s2 from trades where qty > 0))
"""
_DECAY = """, ew as (select symbol, n, seq, ts_ms, delta, abs(delta) as fast, abs(delta) as slow from signed where n = 1 union all
  select s.symbol, s.n, s.seq, s.ts_ms, s.delta, e.fast + (1 - pow(2, -greatest(1, s.ts_ms - e.ts_ms) / 60000)) * (abs(s.delta) - e.fast), e.slow + (1 - pow(2, -greatest(1, s.ts_ms - e.ts_ms) / 600000)) * (abs(s.delta) - e.slow)
  from ew e join signed s on s.symbol = e.symbol and s.n = e.n + 1)
"""
_MAD = """list_median(list_transform(l, lambda x: abs(x - list_median(l))))"""


def _trades(spark, d):
    return S.trades(spark, d)


def _ofi(spark, d):
    return I.order_flow(S.book(spark, d)).withColumn("ofi", F.round("ofi", 9))


@query("""select t.seq, t.symbol, b.ts_ms as q_ts, case when b.ts_ms is null then 'none' when t.ts_ms - b.ts_ms <= 800 then 'strict' else 'fallback' end as alignment
  from trades t asof left join book b on t.symbol = b.symbol and t.ts_ms >= b.ts_ms""")
def asof_fallback(spark, sf_dir):
    return A.as_of_or_newest(_trades(spark, sf_dir), S.book(spark, sf_dir), ["best_bid"], 800, "q_").select("seq", "symbol", "q_ts", "alignment")


@query("""select seq, symbol, a_seq, b_seq from (select *, last_value(case when src = 'book' then seq end ignore nulls) over w as a_seq, last_value(case when src = 'book' then ts_ms end ignore nulls) over w as a_ts,
  last_value(case when src = 'trade' then seq end ignore nulls) over w as b_seq, last_value(case when src = 'trade' then ts_ms end ignore nulls) over w as b_ts from tape window w as (partition by symbol order by ts_ms, seq rows between unbounded preceding and current row))
  where abs(a_ts - b_ts) <= 10000""")
def latest_states(spark, sf_dir):
    s = A.latest_states(S.tape(spark, sf_dir), F.col("src") == "book", F.col("src") == "trade", ["price"], 10_000)
    return s.select("seq", "symbol", F.col("_a.seq").alias("a_seq"), F.col("_b.seq").alias("b_seq"))


@query(_OFI + """select symbol, second, price, ofi from (select symbol, ts_ms // 1000 as second, round(last(price order by ts_ms, seq), 6) as price from trades group by 1, 2)
  left join (select symbol, ts_ms // 1000 as second, round(last(ofi order by ts_ms, seq), 6) as ofi from ofis group by 1, 2) using (symbol, second)""")
def joined_seconds(spark, sf_dir):
    j = A.joined_seconds(A.per_second(_trades(spark, sf_dir), ["price"]), A.per_second(_ofi(spark, sf_dir), ["ofi"]))
    return j.select("symbol", "second", rounded(F.col("price")).alias("price"), rounded(F.col("ofi")).alias("ofi"))


@query(_OFI + """select seq, symbol, round(case when z is not null then greatest(-3, least(3, z)) end, 6) as z, cast(sum(case when abs(z) > 2 then 1 else 0 end) over v as bigint) as over_2, cast(count(z) over v as bigint) as n_z from (select seq, symbol, ts_ms, case when k >= 5 then (ofi - m) / greatest(s, 1e-4) end as z
  from (select *, count(ofi) over w as k, avg(ofi) over w as m, stddev_samp(ofi) over w as s from ofis window w as (partition by symbol order by ts_ms, seq rows between 20 preceding and 1 preceding))) window v as (partition by symbol order by ts_ms, seq)""")
def ofi_z(spark, sf_dir):
    z = I.tail_counts(I.prior_z(_ofi(spark, sf_dir), "ofi", 20, 5), "z")
    return z.select("seq", "symbol", rounded(F.col("z")).alias("z"), F.col("over_2").cast("long").alias("over_2"), F.col("n_z").cast("long").alias("n_z"))


@query("""select seq, symbol, cast(sum(case when step > 0 then 1 else 0 end) over w as bigint) as ups, cast(sum(case when step < 0 then 1 else 0 end) over w as bigint) as downs, round(sum(coalesce(abs(step), 0)) over w, 4) as impact_bps
  from (select *, (best_bid - lag(best_bid) over v) / lag(best_bid) over v * 1e4 as step from book window v as (partition by symbol order by ts_ms, seq)) window w as (partition by symbol order by ts_ms, seq)""")
def price_jumps(spark, sf_dir):
    return I.price_jumps(S.book(spark, sf_dir)).select("seq", "symbol", F.col("ups").cast("long").alias("ups"), F.col("downs").cast("long").alias("downs"), F.round("impact_bps", 4).alias("impact_bps"))


@query(_N + """, e as (select symbol, n, seq, side, side as was, case when side is not null then price end as price, case when side is not null then ts_ms end as at_ms, 0 as k from t where n = 1 union all
  select t.symbol, t.n, t.seq, x.side, coalesce(x.side, e.was), case when x.side is not null then coalesce(t.price, e.price) else e.price end, case when x.side is not null then t.ts_ms else e.at_ms end,
    case when t.side is not null or t.price is null then e.k when e.price is null or t.price <> e.price or x.side is null then 0 else e.k + 1 end
  from e join t on t.symbol = e.symbol and t.n = e.n + 1 cross join lateral (select coalesce(t.side, case when t.price > e.price then 'buy' when t.price < e.price then 'sell' when t.price = e.price and e.k + 1 <= 5 and t.ts_ms - e.at_ms <= 2000 then e.was end) as side) x)
  select seq, symbol, side as tick_side from e""")
def tick_sides(spark, sf_dir):
    flat = _trades(spark, sf_dir).withColumn("price", F.round("price", 0))  # so that equal prices follow each other
    return I.tick_rule(flat).select("seq", "symbol", "tick_side")


@query(_SIGNED + """select seq, symbol, round(case when kk >= 10 then case when s <= 1e-9 then 0.0 else (cvd - m) / s end end, 6) as z from (select *, count(cvd) over w as kk, avg(cvd) over w as m, stddev_pop(cvd) over w as s
  from (select *, sum(delta) over (partition by symbol order by ts_ms, seq) as cvd from signed) window w as (partition by symbol order by ts_ms, seq rows between 50 preceding and 1 preceding))""")
def cvd_level_z(spark, sf_dir):
    return I.prior_z(I.signed_volume(_trades(spark, sf_dir)), "cvd", 50, 10, population=True).select("seq", "symbol", rounded(F.col("z")).alias("z"))


@query(_SIGNED + _DECAY + "select seq, symbol, round(fast, 6) as decayed_60s, round(slow, 6) as decayed_600s from ew")
def decayed_volume(spark, sf_dir):
    d = I.decayed_means(I.signed_volume(_trades(spark, sf_dir)), "delta")
    return d.select("seq", "symbol", rounded(F.col("decayed_60s")).alias("decayed_60s"), rounded(F.col("decayed_600s")).alias("decayed_600s"))


@query(_SIGNED + f"""select seq, symbol, round(case when len(l) >= 20 then {_MAD} * 1.4826::double end, 6) as mad from (select seq, symbol, list(delta) over (partition by symbol order by ts_ms, seq rows between 49 preceding and current row) as l from signed)""")
def rolling_mad(spark, sf_dir):
    return I.rolling_mad(I.signed_volume(_trades(spark, sf_dir)), "delta", 50, 20).select("seq", "symbol", rounded(F.col("mad")).alias("mad"))


@query("""select seq, symbol, round(count(*) over w / greatest(60, (ts_ms - min(ts_ms) over w) / 1000), 6) as tps from trades window w as (partition by symbol order by ts_ms range between 60000 preceding and current row)""")
def trade_tps(spark, sf_dir):
    return I.trade_rate(_trades(spark, sf_dir)).select("seq", "symbol", rounded(F.col("tps")).alias("tps"))


@query("""select seq, symbol, round(case when ts_ms > t0 then (kk - 1) / ((ts_ms - t0) / 1000) end, 6) as activity from (select *, count(*) over w as kk, min(ts_ms) over w as t0 from trades window w as (partition by symbol order by ts_ms, seq rows between 99 preceding and current row))""")
def activity_rate(spark, sf_dir):
    return I.activity_rate(_trades(spark, sf_dir)).select("seq", "symbol", rounded(F.col("activity")).alias("activity"))


_FROZEN = """coalesce(max(gap) over (partition by symbol order by ts_ms, seq rows between 2 preceding and current row) > 5000, false) or coalesce(max(gap) over (partition by symbol order by ts_ms, seq rows between 1 preceding and current row) > 4000, false)"""


@query(f"select seq, symbol, {_FROZEN} as frozen from (select *, ts_ms - lag(ts_ms) over (partition by symbol order by ts_ms, seq) as gap from trades)")
def gap_freeze(spark, sf_dir):
    return I.after_gaps(_trades(spark, sf_dir)).select("seq", "symbol", "frozen")


@query(_SIGNED + _DECAY + f""", m as (select *, ts_ms - lag(ts_ms) over v as gap0, n - min(n) over w + 1 as cnt, min(ts_ms) over w as t0 from signed window v as (partition by symbol order by ts_ms, seq), w as (partition by symbol order by ts_ms range between 60000 preceding and current row)),
  g as (select *, case when n >= 20 then gap0 end as gap, list(delta) over (partition by symbol order by ts_ms, seq rows between 199 preceding and current row) as l, case when cnt >= 2 then cnt / greatest(60, (ts_ms - t0) / 1000) else 0.0::double end as tps from m),
  f as (select *, coalesce(gap > 4000, false) or coalesce(lag(gap) over v > 4000, false) or coalesce(lag(gap, 2) over v > 5000, false) as frozen, case when len(l) >= 50 then {_MAD} * 1.4826::double * 1.7::double else 0 end as floor0 from g window v as (partition by symbol order by ts_ms, seq)),
  sc as (select f.*, greatest(0.3::double * least(1.0, tps / 1.5) * fast + (1 - 0.3::double * least(1.0, tps / 1.5)) * slow, floor0 * greatest(1.0, pow(1.5::double / greatest(tps, 0.2::double), 0.7::double)), 1e-9::double) as scale from f join ew using (seq))
  select seq, symbol, case when tps > 2 then 'ACTIVE' else 'QUIET' end as mode, round(case when not frozen and n >= 20 then greatest(-2.0, least(2.0, delta / scale)) end, 6) + 0.0::double as z_cvd from sc""")
def cvd_delta_z(spark, sf_dir):
    return I.cvd_delta_z(_trades(spark, sf_dir)).select("seq", "symbol", "mode", (rounded(F.col("z_cvd")) + 0.0).alias("z_cvd"))


@query(_SIGNED + f"""select seq, symbol, round(case when len(l) >= 10 then greatest(-2.5, least(2.5, (delta - list_avg(l)) / greatest(list_stddev_pop(l), 0.3::double * case when {_MAD} > 0 then {_MAD} * 1.4826::double else 1 end))) else delta / 100 end, 6) + 0.0::double as z from (
  select *, list_transform(list_filter(h, lambda x: x.t >= ts_ms - 300000), lambda x: x.d) as l from (select *, list({{'t': ts_ms, 'd': delta}}) over (partition by symbol order by ts_ms, seq rows between 4095 preceding and current row) as h from signed))""")
def timed_cvd_z(spark, sf_dir):
    return I.timed_z(I.signed_volume(_trades(spark, sf_dir)), "delta").select("seq", "symbol", (rounded(F.col("z")) + 0.0).alias("z"))


@query(_OFI + f"""select seq, symbol, round(case when len(l) >= 10 then (ofi - list_median(l)) / case when {_MAD} > 0 then greatest({_MAD} * 1.4826::double, 1e-9) else 1 end else ofi / 1000 end, 6) + 0.0::double as z from (select seq, symbol, ofi, list(ofi) over (partition by symbol order by ts_ms, seq rows between 4095 preceding and current row) as l from ofis)""")
def robust_ofi_z(spark, sf_dir):
    return I.robust_z(_ofi(spark, sf_dir), "ofi").select("seq", "symbol", (rounded(F.col("z")) + 0.0).alias("z"))


@query()
def winsorised_ofi_z(spark, sf_dir):
    z = I.ema(I.winsorised_history_z(_ofi(spark, sf_dir), "ofi"), "z", 0.3, "session_id")
    return z.select("seq", "symbol", *(rounded(F.col(c)).alias(c) for c in ("kept", "z", "ema")))


_FUSED = """, fu as (select *, case when lag_sec > 0.25 then 1.0::double when least(abs(z_ofi), abs(z_cvd)) < 1e-9 or sign(z_ofi) <> sign(z_cvd) then 0.0::double else least(abs(z_ofi), abs(z_cvd)) / greatest(abs(z_ofi), abs(z_cvd)) end as cons,
  case when row_number() over (partition by symbol order by ts_ms, seq) <= 10 then 0.0::double else greatest(-4, least(4, case when lag_sec > 0.25 then case when abs(z_ofi) >= abs(z_cvd) then z_ofi else z_cvd end else z_ofi * 0.6::double + z_cvd * 0.4::double end)) end as fusion from signals)
"""


@query(_FUSED + """select seq, symbol, round(fusion, 6) + 0.0::double as fusion, round(cons, 6) as consistency, case when abs(fusion) > 2 and cons > 0.5 then 'strong_' || case when fusion > 0 then 'buy' else 'sell' end when abs(fusion) > 1 and cons > 0.2 then case when fusion > 0 then 'buy' else 'sell' end else 'neutral' end as fusion_label from fu""")
def fusion_labels(spark, sf_dir):
    f = ST.fused(S.signals(spark, sf_dir))
    return f.select("seq", "symbol", (rounded(F.col("fusion")) + 0.0).alias("fusion"), rounded(F.col("consistency")).alias("consistency"), "fusion_label")


@query()
def fusion_signals(spark, sf_dir):
    return ST.denoised(ST.fused(S.signals(spark, sf_dir))).where("signal <> 0").select("seq", "symbol", "signal")


_PIVOTS = """, pv as (select *, count(*) over p = 3 and count(*) over f = 3 as full_, price >= max(price) over p and price >= max(price) over f as hi, price <= min(price) over p and price <= min(price) over f as lo, lead(ts_ms, 3) over o as known_ms, lead(seq, 3) over o as known_seq, lead(cons, 3) over o as kcons from rows_
    window o as (partition by symbol, ch order by m), p as (partition by symbol, ch order by m rows between 3 preceding and 1 preceding), f as (partition by symbol, ch order by m rows between 1 following and 3 following)),
  pk as (select *, row_number() over (partition by symbol, ch, kind, ts_ms order by m) as same from (select *, unnest(list_filter([case when hi then 'high' end, case when lo then 'low' end], lambda x: x is not null)) as kind from pv where full_)),
  pp as (select *, lag(price) over k as pa, lag(i) over k as ia, m - lag(m) over k as apart from pk where same = 1 window k as (partition by symbol, ch, kind order by m)),
  dv as (select *, case when kind = 'low' and price < pa and i > ia then 'bull_div' when kind = 'low' and price > pa and i < ia then 'hidden_bull' when kind = 'high' and price > pa and i < ia then 'bear_div' when kind = 'high' and price < pa and i > ia then 'hidden_bear' end as divergence,
    100 * (0.35::double * case when greatest(abs(ia), abs(i)) >= 1.5 then 1.0 when greatest(abs(ia), abs(i)) >= 0.7 then 0.7 else 0.3 end + 0.25::double * (least(1.0, apart / 6.0::double) + least(1.0, (abs(price - pa) / pa + abs(i - ia)) / 2)) / 2 + 0.25::double
      + 0.15::double * case when kcons >= 0.3 then 0.05::double + (kcons - 0.3::double) / 0.7::double * 0.1::double else 0 end) as score from pp where apart >= 6)
"""


@query(_SIGNED + """, rows_ as (select symbol, seq, ts_ms, n as m, price, sum(delta) over (partition by symbol order by ts_ms, seq) as i, 'cvd' as ch, null::double as cons from signed)
""" + _PIVOTS + "select seq, symbol, known_seq, divergence, round(least(100.0, greatest(0.0, score)), 4) as score from dv where divergence is not null")
def divergences(spark, sf_dir):
    return I.divergences(I.signed_volume(_trades(spark, sf_dir)), "price", "cvd").select("seq", "symbol", "known_seq", "divergence", F.round("score", 4).alias("score"))


_EVENTS = """, bs as (select seq, symbol, ts_ms, 100 + spread_bps + score as price, greatest(-5, least(5, z_ofi)) as zo, greatest(-5, least(5, z_cvd)) as zc, case when seq % 7 > 0 then greatest(-5, least(5, z_ofi * 0.6::double + z_cvd * 0.4::double)) end as fu, consistency as cons, warmup, lag_sec / 10 as late,
    row_number() over (partition by symbol order by ts_ms, seq) as n from scored),
  ch as (select symbol, seq, ts_ms, price, zo as i, 'ofi' as ch, null::double as cons from bs union all select symbol, seq, ts_ms, price, zc, 'cvd', null from bs union all select symbol, seq, ts_ms, price, fu, 'fusion', cons from bs where fu is not null),
  rows_ as (select *, row_number() over (partition by symbol, ch order by ts_ms, seq) as m from ch)
""" + _PIVOTS + """, best as (select symbol, known_seq as seq, divergence as ev, ch as channel, least(100.0, greatest(0.0, score)) as sc from dv where divergence is not null and known_ms is not null
    qualify row_number() over (partition by symbol, known_seq order by score desc, case ch when 'ofi' then 0 when 'cvd' then 1 else 2 end, kind desc) = 1),
  nb as (select bs.*, ev, channel, sc, row_number() over (partition by bs.symbol, ev, channel order by ts_ms, bs.seq) as k from bs left join best using (symbol, seq)),
  cd as (select symbol, ev as e1, channel as c1, k as k1, seq, ts_ms as last, true as kept from nb where ev is not null and k = 1 union all select n.symbol, n.ev, n.channel, n.k, n.seq, case when n.ts_ms - c.last >= 259200000 then n.ts_ms else c.last end, n.ts_ms - c.last >= 259200000
    from cd c join nb n on n.symbol = c.symbol and n.ev = c.e1 and n.channel = c.c1 and n.k = c.k1 + 1),
  bt as (select nb.* replace (case when kept then ev end as ev, case when kept then channel end as channel), abs(zo) >= 1.5 and abs(zc) >= 0.7 and sign(zo) * sign(zc) < 0 as apart from nb left join cd using (symbol, seq)),
  bn as (select *, row_number() over (partition by symbol order by ts_ms, seq) as j from bt where ev is not null or apart),
  cf as (select symbol, j as j1, seq, ev is null as alone_kept, false as waits, case when ev is null then ts_ms end as last from bn where j = 1 union all
    select b.symbol, b.j, b.seq, b.ev is null and not coalesce(b.ts_ms - c.last < 259200000, false), coalesce(b.ts_ms - c.last < 259200000, false), case when b.ev is null and not coalesce(b.ts_ms - c.last < 259200000, false) then b.ts_ms else c.last end from cf c join bn b on b.symbol = c.symbol and b.j = c.j1 + 1)
"""


@query(_EVENTS + """select seq, symbol, coalesce(ev, 'ofi_cvd_conflict') as event, channel, ev is not null and apart and not waits as with_conflict, case when ev is null then 1.0::double else trust end as confidence,
    round(case when ev is null then 60.0::double else least(100.0, sc + case when apart and not waits then 10 else 0 end) * trust end, 4) as score from (select *, case when warmup or n < 100 then 0.3::double when late > 0.3 then 0.5::double else 1.0::double end as trust from bn join cf using (symbol, seq)) where ev is not null or alone_kept""")
def flow_events(spark, sf_dir):
    s = S.signals(spark, sf_dir).withColumn("price", 100 + F.col("spread_bps") + F.col("score")).withColumn("consistency", consistency(F.col("z_ofi"), F.col("z_cvd")))
    s = s.withColumn("fusion", F.when(F.col("seq") % 7 > 0, F.col("z_ofi") * 0.6 + F.col("z_cvd") * 0.4)).withColumn("lag_sec", F.col("lag_sec") / 10)
    return ST.flow_events(s, 3, 6, 259_200_000).select("seq", "symbol", "event", "channel", "with_conflict", "confidence", F.round("score", 4).alias("score"))


_CONFLICT = """, k as (select *, case when z_ofi > 0 then 'ofi_up' else 'ofi_down' end as conflict, row_number() over (partition by symbol, z_ofi > 0 order by ts_ms, seq) as n from signals where abs(z_ofi) >= 1.5 and abs(z_cvd) >= 1.5 and sign(z_ofi) <> sign(z_cvd)),
  e as (select symbol, conflict, n, seq, ts_ms as last, true as kept from k where n = 1 union all select k.symbol, k.conflict, k.n, k.seq, case when k.ts_ms - e.last >= 86400000 then k.ts_ms else e.last end, k.ts_ms - e.last >= 86400000 from e join k on k.symbol = e.symbol and k.conflict = e.conflict and k.n = e.n + 1)
"""


@query(_CONFLICT + "select seq, symbol, conflict from e where kept")
def flow_conflicts(spark, sf_dir):
    return ST.conflicts(S.signals(spark, sf_dir), cooldown_ms=86_400_000).select("seq", "symbol", "conflict")


@query("""select symbol, round(avg(gap), 6) as mean_gap, max(gap) as max_gap, round(avg(case when gap > 2 then 1.0 when gap <= 2 then 0.0 end), 6) as bad_rate, count(*) filter (gap > 2) as bad from (
  select symbol, second - lag(second) over (partition by symbol order by second) as gap from (select distinct symbol, ts_ms // 1000 as second from trades)) group by 1""")
def observation_gaps(spark, sf_dir):
    return ST.observation_gaps(A.per_second(_trades(spark, sf_dir), ["price"])).select("symbol", rounded(F.col("mean_gap")).alias("mean_gap"), "max_gap", rounded(F.col("bad_rate")).alias("bad_rate"), "bad")


@query("""select seq, symbol, case when tps >= coalesce(greatest(0.05, 0.3::double * avg(tps) over x), 0.1) then 'A' else 'Q' end || '_' || case when len(l) >= 9 and list_avg(l) >= 0.6::double * list_median(l) then 'H' else 'L' end as scenario from (
  select *, (len(l) + 1) / 300.0::double as tps from (select *, list_transform(list_filter(h, lambda x: x.t >= ts_ms - 300000), lambda x: x.m) as l from (select *, list({'t': was, 'm': move}) over (partition by symbol order by ts_ms, seq rows between 298 preceding and current row) as h from (
    select *, lag(ts_ms) over v as was, abs(price - lag(price) over v) / lag(price) over v as move from trades window v as (partition by symbol order by ts_ms, seq)))))
  window x as (partition by symbol order by ts_ms, seq rows between 10 preceding and 1 preceding)""")
def tape_scenarios(spark, sf_dir):
    return ST.tape_scenarios(_trades(spark, sf_dir)).select("seq", "symbol", "scenario")


@query("""select seq, symbol, round(l, 6) as allowed, throttled from (
  with recursive r as (select *, row_number() over (partition by symbol order by ts_ms, seq) as n, case when k % 3 = 0 then k * 2 else 0 end as denied, case when k % 11 < 2 then 'active' when k % 11 < 4 then 'quiet' else 'normal' end as reg from trades),
  c as (select *, n - min(n) over (partition by symbol order by ts_ms range between 60000 preceding and current row) as cnt from r),
  d as (select *, case when denied > 0 then denied / (cnt + denied)::double end as rate from c),
  e as (select symbol, n, seq, cnt, greatest(case when reg = 'quiet' then 2.0 else -1e9 end, least(case when reg = 'active' then 20.0 else 1e9 end, case reg when 'quiet' then 0.5 when 'active' then 1.2::double else 1.0 end * case when rate > 0.5 then greatest(2.0, 10 * 0.8::double) when rate < 0.1 then least(20.0, 10 * 1.1::double) else 10.0 end)) as l from d where n = 1 union all
    select d.symbol, d.n, d.seq, d.cnt, greatest(case when reg = 'quiet' then 2.0 else -1e9 end, least(case when reg = 'active' then 20.0 else 1e9 end, case reg when 'quiet' then 0.5 when 'active' then 1.2::double else 1.0 end * case when rate > 0.5 then greatest(2.0, e.l * 0.8::double) when rate < 0.1 then least(20.0, e.l * 1.1::double) else e.l end))
    from e join d on d.symbol = e.symbol and d.n = e.n + 1)
  select *, cnt >= l * 60 as throttled from e)""")
def adaptive_limits(spark, sf_dir):
    k = F.col("k")
    t = S.tape(spark, sf_dir).where("src = 'trade'").withColumn("denied", F.when(k % 3 == 0, k * 2).otherwise(0)).withColumn("regime", F.when(k % 11 < 2, "active").when(k % 11 < 4, "quiet").otherwise("normal"))
    return D.adaptive_limit(t, 10.0, 2.0, 20.0).select("seq", "symbol", rounded(F.col("limit")).alias("allowed"), "throttled")


@query("""select event, symbol, count(*) as n from (select symbol, unnest(list_filter([case when abs(z_ofi) > 2 and abs(z_cvd) > 1 and sign(z_ofi) <> sign(z_cvd) then 'conflict' end, case when abs(z_ofi) > 2.5 and abs(z_cvd) > 2.5 and sign(z_ofi) <> sign(z_cvd) then 'divergence' end,
  case when abs(z_ofi) > 3 or abs(z_cvd) > 2.5 then 'anomaly' end, case when abs(price - was) / was > 0.05 then 'price_jump' end], lambda x: x is not null)) as event from (
  select *, 100 + spread_bps as price, lag(100 + spread_bps) over (partition by symbol order by ts_ms, seq) as was from signals)) group by all""")
def tape_events(spark, sf_dir):
    return ST.events(S.signals(spark, sf_dir).withColumn("price", 100 + F.col("spread_bps"))).groupBy("event", "symbol").agg(F.count("*").alias("n"))


@query("""select seq, symbol, case when sg = 0 then 0 else row_number() over (partition by symbol, isl order by ts_ms, seq) end as streak from (select *, sum(case when sg is distinct from was then 1 else 0 end) over (partition by symbol order by ts_ms, seq) as isl from (
  select *, sign(score) as sg, lag(sign(score)) over (partition by symbol order by ts_ms, seq) as was from signals where abs(score) >= 0.5))""")
def direction_streaks(spark, sf_dir):
    return ST.streaks(S.signals(spark, sf_dir).where("abs(score) >= 0.5"), F.col("score")).select("seq", "symbol", "streak")


_LATCH = """, a as (select *, lag_sec < 2.5 as act, row_number() over (partition by symbol order by ts_ms, seq) as n from signals),
  latch as (select *, coalesce(last_value(case when act and n >= 3 and p1 and p2 then 'ACTIVE' when not act and n >= 2 and not p1 then 'QUIET' end ignore nulls) over (partition by symbol order by ts_ms, seq rows between unbounded preceding and current row), 'QUIET') as mode
    from (select *, lag(act) over w as p1, lag(act, 2) over w as p2 from a window w as (partition by symbol order by ts_ms, seq)))
"""


@query(_LATCH + "select seq, symbol, mode from latch")
def regime_latch(spark, sf_dir):
    return ST.latched(S.signals(spark, sf_dir), F.col("lag_sec") < 2.5, 3, 2).select("seq", "symbol", "mode")


@query(_LATCH + """select symbol, mode, cast(sum(ms) as bigint) as ms, cast(count(*) as bigint) as n, cast(sum(case when was is distinct from mode then 1 else 0 end) as bigint) as entered from (
  select symbol, mode, coalesce(lead(ts_ms) over w - ts_ms, 0) as ms, lag(mode) over w as was from latch window w as (partition by symbol order by ts_ms, seq)) group by 1, 2""")
def mode_times(spark, sf_dir):
    return ST.mode_times(ST.latched(S.signals(spark, sf_dir), F.col("lag_sec") < 2.5, 3, 2))


@query("""select symbol, active, count(*) as n from (select symbol, len(l) >= 3 and w[(len(w) + 1) // 2] >= 0.5 * list_sum(w) / len(w) as active from (
  select symbol, l, list_transform(l, lambda x: greatest(l[cast(floor((len(l) - 1) * 0.1) as bigint) + 1], least(l[cast(floor((len(l) - 1) * 0.9) as bigint) + 1], x))) as w from (
    select symbol, list_sort(list(qty) over (partition by symbol order by ts_ms range between 60000 preceding and current row)) as l from trades))) group by all""")
def market_active(spark, sf_dir):
    return ST.market_active(_trades(spark, sf_dir)).groupBy("symbol", "active").agg(F.count("*").alias("n"))


@query("""select symbol, src, max(ts_ms) as last_ms, 1704093120000 - max(ts_ms) as age_ms, 1704093120000 - max(ts_ms) > case src when 'book' then 30000 else 60000 end as stale from tape group by 1, 2""")
def stale_streams(spark, sf_dir):
    return ST.stale(S.tape(spark, sf_dir), F.lit(1704093120000), {"book": 30_000, "trade": 60_000})


@query("""select symbol, alert, min(ts_ms) filter (on_) as triggered_ms, max(rec) as recovered_ms, count(*) filter (on_) as rows from (select *, (spell + 1) // 2 as pair, case when not on_ and edge then ts_ms end as x, max(case when not on_ and edge then ts_ms end) over (partition by symbol, alert, spell // 2) as dummy,
    min(case when not on_ then ts_ms end) over (partition by symbol, alert order by ts_ms, seq rows between current row and unbounded following) as rec from (
    select *, sum(case when edge then 1 else 0 end) over (partition by symbol, alert order by ts_ms, seq) as spell from (select *, on_ <> coalesce(lag(on_) over (partition by symbol, alert order by ts_ms, seq), false) as edge from (
      select symbol, ts_ms, seq, 'lag' as alert, lag_sec > 3 as on_ from signals union all select symbol, ts_ms, seq, 'spread', spread_bps > 20 from signals)))) where on_ group by symbol, alert, spell""")
def alert_spells(spark, sf_dir):
    return ST.alert_spells(S.signals(spark, sf_dir), {"lag": F.col("lag_sec") > 3, "spread": F.col("spread_bps") > 20})


@query("""select s.seq, s.symbol, coalesce(s.ts_ms - e.ts_ms < 3600000, false) as cooling from signals s asof left join (select distinct symbol, ts_ms from signals where abs(score) >= 1.9) e on s.symbol = e.symbol and s.ts_ms >= e.ts_ms""")
def exit_cooldown(spark, sf_dir):
    s = S.signals(spark, sf_dir)
    return ST.in_cooldown(s, s.where("abs(score) >= 1.9"), 3_600_000).select("seq", "symbol", "cooling")


@query("""select seq, symbol, case when seq % 5 = 0 then 7.5::double else least(3000, nt - bt)::double end as trade_rate, round(least(6000, nq - bq) / 60.0::double, 6) as quote_rate from (select *, min(nt - t) over w as bt, min(nq - q) over w as bq from (
  select *, sum(t) over v as nt, sum(q) over v as nq from (select *, (src = 'trade')::int as t, (src = 'book')::int as q from tape) window v as (partition by symbol order by ts_ms, seq rows between unbounded preceding and current row)) window w as (partition by symbol order by ts_ms range between 60000 preceding and current row))""")
def activity_fields(spark, sf_dir):
    t = S.tape(spark, sf_dir).withColumn("trade_rate", F.when(F.col("seq") % 5 == 0, 7.5))
    return I.activity_rates(t, F.col("src") == "trade", F.col("src") == "book").select("seq", "symbol", "trade_rate", rounded(F.col("quote_rate")).alias("quote_rate"))


@query("""select symbol, second, round(price, 6) as price, filled, gap_second, round(ret, 6) + 0.0::double as return_bps from (with s as (select symbol, ts_ms // 1000 as second, last(price order by ts_ms, seq) as price from trades group by 1, 2),
  p as (select *, lag(second) over w as ps, lag(price) over w as pp from s window w as (partition by symbol order by second))
  select symbol, second, price, false as filled, coalesce(second - ps > 1.5, false) as gap_second, (price - pp) / pp * 1e4 as ret from p union all
  select symbol, unnest(range(greatest(ps + 1, second - 60), second)), pp, true, false, 0 from p where second - ps > 1)""")
def filled_returns(spark, sf_dir):
    f = I.filled_forward(A.per_second(_trades(spark, sf_dir), ["price"]), "price", 60)
    return f.select("symbol", "second", rounded(F.col("price")).alias("price"), "filled", "gap_second", (rounded(F.col("return_bps")) + 0.0).alias("return_bps"))
