"""A query for each operator, with its SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import nearest_rank_of, return_bps, rounded, session_label, spread_bps, squash
from ..operators import alignment as A
from ..operators import decisions as D
from ..operators import indicators as I
from ..operators import ledger as L
from ..operators.chunks import numbered, with_previous
from .base import ORACLE, QUERIES, _i, query

__all__ = ["ORACLE", "QUERIES"]

@query("""select reason, symbol, count(*) as n from (
  select symbol, unnest(case when len(r) = 0 then ['pass'] else r end) as reason from (
    select t.symbol, list_filter([case when b.ts_ms is null or t.ts_ms - b.ts_ms > 5000 then 'no_quote' end,
      case when t.ts_ms - b.ts_ms <= 5000 and (b.best_ask - b.best_bid) / ((b.best_bid + b.best_ask) / 2) * 1e4 > 8 then 'spread' end,
      case when t.n60 > 3 then 'rate' end, case when t.qty < 20 then 'small' end], lambda x: x is not null) as r
    from (select *, count(*) over (partition by symbol order by ts_ms range between 60000 preceding and current row) as n60 from trades) t
    asof left join book b on t.symbol = b.symbol and t.ts_ms >= b.ts_ms)) group by all""")
def pretrade_reasons(spark, sf_dir):
    """Each trade with its latest quote, 60 s rate and reasons to deny it; counts by symbol and reason."""
    t = I.rolling_rates(S.trades(spark, sf_dir)).select("symbol", "ts_ms", "seq", "qty", "n_60s")
    q = A.as_of(t, S.book(spark, sf_dir), ["best_bid", "best_ask"], 5000, "q_")
    why = D.reasons((F.col("q_ts").isNull(), "no_quote"), (spread_bps(F.col("q_best_bid"), F.col("q_best_ask")) > 8, "spread"), (F.col("n_60s") > 3, "rate"), (F.col("qty") < 20, "small"))
    r = q.select("symbol", F.when(F.size(why) == 0, F.array(F.lit("pass"))).otherwise(why).alias("r"))
    return r.select("symbol", F.explode("r").alias("reason")).groupBy("symbol", "reason").agg(F.count("*").alias("n"))


@query("""select t.seq, t.symbol, case when t.ts_ms - b.ts_ms <= 2000 then b.ts_ms end as q_ts, case when t.ts_ms - b.ts_ms <= 2000 then round(b.best_bid, 6) end as q_best_bid
  from trades t asof left join book b on t.symbol = b.symbol and t.ts_ms >= b.ts_ms""")
def asof_quotes(spark, sf_dir):
    q = A.as_of(S.trades(spark, sf_dir), S.book(spark, sf_dir), ["best_bid"], 2000, "q_")
    return q.select("seq", "symbol", "q_ts", rounded(F.col("q_best_bid")).alias("q_best_bid"))


@query("""select t.seq, t.symbol, round(case when n.ts_ms is null or t.ts_ms - p.ts_ms <= n.ts_ms - t.ts_ms then p.best_bid else n.best_bid end, 6) as best_bid
  from trades t asof left join book p on t.symbol = p.symbol and t.ts_ms >= p.ts_ms asof left join book n on t.symbol = n.symbol and t.ts_ms < n.ts_ms""")
def nearest_quotes(spark, sf_dir):
    return A.nearest(S.trades(spark, sf_dir), S.book(spark, sf_dir), "best_bid").select("seq", "symbol", rounded(F.col("best_bid")).alias("best_bid"))


@query("""select symbol, second, round(price, 6) as price, round((price - lag(price) over w) / lag(price) over w * 1e4, 6) as ret_bps, coalesce(second - lag(second) over w > 1, false) as gap
  from (select symbol, ts_ms // 1000 as second, last(price order by ts_ms, seq) as price from trades group by 1, 2) window w as (partition by symbol order by second)""")
def second_returns(spark, sf_dir):
    s = A.per_second(S.trades(spark, sf_dir), ["price"]).withColumn("ts_ms", F.col("second") * 1000)
    s = with_previous(s, ["second", "price"], order=())
    return s.select("symbol", "second", rounded(F.col("price")).alias("price"), rounded(return_bps(F.col("price"), F.col("_prev.price"))).alias("ret_bps"), F.coalesce(F.col("second") - F.col("_prev.second") > 1, F.lit(False)).alias("gap"))


@query("""select symbol, second, round(price, 6) as price, round(bid, 6) as bid from (
    select symbol, second, last_value(price ignore nulls) over w as price, last_value(bid ignore nulls) over w as bid
    from (select symbol, ts_ms // 1000 as second, last(price order by ts_ms, seq) as price from trades group by 1, 2)
    full outer join (select symbol, ts_ms // 1000 as second, last(best_bid order by ts_ms, seq) as bid from book group by 1, 2) using (symbol, second)
    window w as (partition by symbol order by second range between 5 preceding and current row)) where price is not null and bid is not null""")
def aligned_seconds(spark, sf_dir):
    both = A.filled_seconds(A.per_second(S.trades(spark, sf_dir), ["price"]), A.per_second(S.book(spark, sf_dir), ["best_bid"]), 5)
    return both.select("symbol", "second", rounded(F.col("price")).alias("price"), rounded(F.col("best_bid")).alias("bid"))


@query("""select seq, symbol, round(0.4::double / 0.65::double * ((bid1_q - coalesce(lag(bid1_q) over w, 0)) - (ask1_q - coalesce(lag(ask1_q) over w, 0)))
    + 0.25::double / 0.65::double * ((bid2_q - coalesce(lag(bid2_q) over w, 0)) - (ask2_q - coalesce(lag(ask2_q) over w, 0))), 6) as ofi,
    cast(sum(f) over (partition by symbol order by ts_ms, seq) as bigint) as session_id
  from (select *, case when lag(ts_ms) over v is null or ts_ms - lag(ts_ms) over v > 2000 or ts_ms // 86400000 <> lag(ts_ms // 86400000) over v then 1 else 0 end as f
        from book window v as (partition by symbol order by ts_ms, seq)) window w as (partition by symbol order by ts_ms, seq)""")
def order_flow(spark, sf_dir):
    return I.order_flow(S.book(spark, sf_dir)).select("seq", "symbol", rounded(F.col("ofi")).alias("ofi"), _i("session_id"))


_DELTA = """, signed as (select *, case when s2 = 'buy' then qty else -qty end as delta from (
    select *, coalesce(side, case when price >= lag(price) over (partition by symbol order by ts_ms, seq) then 'buy' else 'sell' end) as s2 from trades where qty > 0))
"""


@query(_DELTA + "select seq, symbol, sum(delta) over (partition by symbol order by ts_ms, seq) as cvd from signed")
def signed_volume(spark, sf_dir):
    return I.signed_volume(S.trades(spark, sf_dir)).select("seq", "symbol", "cvd")


@query(_DELTA + """select seq, symbol, round(case when n >= 5 then (delta - m) / greatest(s, 1e-4) end, 6) as z from (
  select *, count(delta) over w as n, avg(delta) over w as m, stddev_samp(delta) over w as s from signed window w as (partition by symbol order by ts_ms, seq rows between 20 preceding and 1 preceding))""")
def prior_z_score(spark, sf_dir):
    return I.prior_z(I.signed_volume(S.trades(spark, sf_dir)), "delta", 20, 5).select("seq", "symbol", rounded(F.col("z")).alias("z"))


@query("""select seq, symbol, count(*) over w as n_60s, round(sum(price * qty) over w, 4) as usd_60s from trades window w as (partition by symbol order by ts_ms range between 60000 preceding and current row)""")
def rolling_rates(spark, sf_dir):
    return I.rolling_rates(S.trades(spark, sf_dir)).select("seq", "symbol", "n_60s", F.round("usd_60s", 4).alias("usd_60s"))


@query("""select seq, symbol, round(stddev_pop(r) over (partition by symbol order by ts_ms, seq rows between 599 preceding and current row) * 1e4, 4) as vol_bps from (
  select *, ln(price / lag(price) over (partition by symbol order by ts_ms, seq)) as r from trades)""")
def realised_vol(spark, sf_dir):
    return I.realised_vol(S.trades(spark, sf_dir)).select("seq", "symbol", F.round("vol_bps", 4).alias("vol_bps"))


NUMBERED = """, t as (select *, row_number() over (partition by symbol order by ts_ms, seq) as n from trades)
"""


@query(NUMBERED + """, e as (select symbol, n, seq, price as ema from t where n = 1 union all
  select t.symbol, t.n, t.seq, 0.3::double * t.price + 0.7::double * e.ema from e join t on t.symbol = e.symbol and t.n = e.n + 1) select seq, symbol, round(ema, 6) as ema from e""")
def price_ema(spark, sf_dir):
    return I.ema(S.trades(spark, sf_dir), "price", 0.3).select("seq", "symbol", rounded(F.col("ema")).alias("ema"))


@query(NUMBERED + """, e as (select symbol, n, seq, ts_ms as last, true as kept from t where n = 1 union all
  select t.symbol, t.n, t.seq, case when t.ts_ms - e.last >= 30000 then t.ts_ms else e.last end, t.ts_ms - e.last >= 30000 from e join t on t.symbol = e.symbol and t.n = e.n + 1)
  select seq, symbol from e where kept""")
def throttled_trades(spark, sf_dir):
    return I.throttled(S.trades(spark, sf_dir), 30_000, "symbol").select("seq", "symbol")


@query("""select seq, symbol, kind from (select *, case when n1 = 3 and n2 = 3 and price >= a and price >= b then 'high' when n1 = 3 and n2 = 3 and price <= c and price <= d then 'low' end as kind from (
  select *, count(*) over p as n1, count(*) over f as n2, max(price) over p as a, max(price) over f as b, min(price) over p as c, min(price) over f as d from trades
  window p as (partition by symbol order by ts_ms, seq rows between 3 preceding and 1 preceding), f as (partition by symbol order by ts_ms, seq rows between 1 following and 3 following))) where kind is not null""")
def price_pivots(spark, sf_dir):
    return I.pivots(S.trades(spark, sf_dir), "price", 3).select("seq", "symbol", "kind")


@query("""select seq, round(5 * tanh(score / 3), 6) as squashed, round(consistency, 6) as consistency, round(greatest(-4, least(4, z_ofi * 0.6::double + z_cvd * 0.4::double)), 6) + 0.0::double as fusion,
  case when hour(make_timestamp(ts_ms * 1000)) < 8 then 'Tokyo' when hour(make_timestamp(ts_ms * 1000)) < 16 then 'London' else 'NY' end as session from scored""")
def scored_signals(spark, sf_dir):
    s = D.confirmed(S.signals(spark, sf_dir))
    hour = F.hour(F.timestamp_millis("ts_ms"))
    return s.select("seq", rounded(squash(F.col("score"))).alias("squashed"), rounded(F.col("consistency")).alias("consistency"), (rounded(I.fusion(s)) + 0.0).alias("fusion"), session_label(hour).alias("session"))


@query("""select signal_type, confirm, count(*) as n from (select len(reasons) = 0 and score <> 0 as confirm, case when score = 0 then 'neutral' when len(reasons) > 0 then 'pending'
  else case when abs(score) >= 1.5 then 'strong_' else '' end || case when score > 0 then 'buy' else 'sell' end end as signal_type from judged) group by all""")
def signal_types(spark, sf_dir):
    return D.confirmed(S.signals(spark, sf_dir)).groupBy("signal_type", "confirm").agg(F.count("*").alias("n"))


@query("select reason, count(*) as n from (select unnest(reasons) as reason from judged) group by 1")
def gate_breakdown(spark, sf_dir):
    return D.confirmed(S.signals(spark, sf_dir)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""select symbol, count(*) as signals, count(*) filter (not list_contains(reasons, 'weak_signal')) as not_weak,
  count(*) filter (not list_contains(reasons, 'weak_signal') and not list_contains(reasons, 'low_consistency')) as consistent, count(*) filter (len(reasons) = 0 and score <> 0) as confirmed, round(count(*) filter (len(reasons) = 0 and score <> 0) / count(*), 6) as confirm_rate from judged group by 1""")
def confirm_funnel(spark, sf_dir):
    return D.funnel(S.signals(spark, sf_dir)).withColumn("confirm_rate", rounded(F.col("confirm_rate")))


@query("""select code, count(*) as n from (select case when not (abs(z_ofi) >= 1.5 and abs(z_cvd) >= 1.2) then 'FAIL_GATING' when lag_sec < 1 then 'BAD_REGIME'
  when abs(score) < case when lag_sec >= 3 then 1.8 else 2.2 end then 'LOW_SCORE' else 'OK' end as code from signals) group by 1""")
def decision_codes(spark, sf_dir):
    from ..functions import regime

    return S.signals(spark, sf_dir).select(D.decision_code(regime(F.col("lag_sec"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("select cast(floor(consistency * 10) as bigint) as bucket, count(*) as n from scored group by 1")
def consistency_histogram(spark, sf_dir):
    return D.confirmed(S.signals(spark, sf_dir)).groupBy(F.floor(F.col("consistency") * 10).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("""select symbol, ts_ms, seq, score from signals qualify row_number() over (partition by symbol, ts_ms // 86400000 order by abs(score) desc, seq) = 1""")
def strongest_signals(spark, sf_dir):
    w = Window.partitionBy("symbol", F.expr("ts_ms div 86400000")).orderBy(F.desc(F.abs("score")), "seq")
    return S.signals(spark, sf_dir).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", "ts_ms", "seq", "score")


@query("""select symbol, max(gap) as max_gap_ms, round(sum(least(gap, 5000)) / sum(gap), 6) as coverage, max(gap) <= 5000 as ok from (
  select symbol, lead(ts_ms) over (partition by symbol order by ts_ms, seq) - ts_ms as gap from tape) group by 1""")
def gap_analysis(spark, sf_dir):
    t = with_previous(S.tape(spark, sf_dir), ["ts_ms"]).select("symbol", (F.col("ts_ms") - F.col("_prev.ts_ms")).alias("gap"))
    return t.groupBy("symbol").agg(F.max("gap").alias("max_gap_ms"), rounded(F.sum(F.least("gap", F.lit(5000))) / F.sum("gap")).alias("coverage"), (F.max("gap") <= 5000).alias("ok"))


@query("select symbol, ts_ms // 60000 as minute, round(count(distinct ts_ms // 1000) / 60, 6) as completeness from tape group by 1, 2")
def minute_completeness(spark, sf_dir):
    return S.tape(spark, sf_dir).groupBy("symbol", F.expr("ts_ms div 60000").alias("minute")).agg(rounded(F.countDistinct(F.expr("ts_ms div 1000")) / 60).alias("completeness"))


@query("""select kind, count(*) as n from (select case when price is null then 'missing' when price <= 0 then 'price' when side is null then 'side' when qty > 90 then 'qty' else 'ok' end as kind from trades) group by 1""")
def quality_gate(spark, sf_dir):
    why = D.reasons((F.col("price").isNull(), "missing"), (F.col("price") <= 0, "price"), (F.col("side").isNull(), "side"), (F.col("qty") > 90, "qty"))
    return S.trades(spark, sf_dir).select(F.coalesce(F.get(why, 0), F.lit("ok")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("select symbol, count(*) as kept from (select distinct symbol, ts_ms // 1000 as s from trades) group by 1")
def first_per_second(spark, sf_dir):
    t = S.trades(spark, sf_dir).withColumn("s", F.expr("ts_ms div 1000")).dropDuplicates(["symbol", "s"])
    return t.groupBy("symbol").agg(F.count("*").alias("kept"))


@query("select symbol, l[cast(floor(len(l) * 0.5) as bigint) + 1] as p50, l[cast(floor(len(l) * 0.95) as bigint) + 1] as p95 from (select symbol, list(lag_sec order by lag_sec) as l from signals group by 1)")
def lag_percentiles(spark, sf_dir):
    p = lambda q, to: nearest_rank_of(S.signals(spark, sf_dir), "lag_sec", q, "symbol").withColumnRenamed("lag_sec", to)
    return p(0.5, "p50").join(p(0.95, "p95"), "symbol")


@query("select symbol, side, count(*) as n, round(sum(notional), 2) as notional, round(sum(fee), 2) as fee, round(avg(exec_px), 6) as exec_px from costs group by 1, 2")
def fill_costs(spark, sf_dir):
    return L.costs(S.fills(spark, sf_dir)).groupBy("symbol", "side").agg(F.count("*").alias("n"), F.round(F.sum("notional"), 2).alias("notional"), F.round(F.sum("fee"), 2).alias("fee"), rounded(F.avg("exec_px")).alias("exec_px"))


@query("select symbol, sum(case when side = 'buy' then qty else -qty end) as position from fills group by 1")
def net_position(spark, sf_dir):
    return S.fills(spark, sf_dir).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))).alias("position"))


#: Legs of lots: stretches of cumulative quantity between the starts of fills, each with the buy and the sell open there.
LEGS = """, c as materialized (select *, sum(u) over (partition by symbol, side order by ts_ms, fill_id)::bigint as e from (select *, cast(round(qty * 100000000) as bigint) as u from costs where qty > 0)),
  cuts as (select *, lead(st) over (partition by symbol order by st) as nx from (select distinct symbol, e - u as st from c)),
  open_lots as (select k.symbol, k.st, k.nx, b.fill_id as buy_id, s.fill_id as sell_id, b.e as be, s.e as se, b.px as buy_px, s.px as sell_px, b.fee as buy_fee, s.fee as sell_fee, b.qty as buy_qty, s.qty as sell_qty, b.ts_ms as bt, s.ts_ms as stime
    from cuts k asof join (select *, e - u as s0 from c where side = 'buy') b on k.symbol = b.symbol and k.st >= b.s0 asof join (select *, e - u as s0 from c where side = 'sell') s on k.symbol = s.symbol and k.st >= s.s0),
  legs as materialized (select *, (sell_px - buy_px) * q as pnl, buy_fee * q / buy_qty + sell_fee * q / sell_qty as fee, least(bt, stime) as open_ms, greatest(bt, stime) as close_ms, case when bt < stime or (bt = stime and buy_id <= sell_id) then 'long' else 'short' end as way
    from (select *, (least(be, se, coalesce(nx, least(be, se))) - st)::double / 1e8::double as q from open_lots) where q > 0),
  leg_days as (select strftime(make_timestamp((close_ms + 9 * 3600000 - 6 * 3600000) * 1000), '%Y-%m-%d') as day, symbol, sum(pnl) as gross, sum(fee) as fee, sum(pnl - fee) as net, sum(q * (buy_px + sell_px)) as turnover,
    count(*) as legs, count(*) filter (pnl - fee > 0) as wins, count(*) filter (pnl - fee < 0) as losses, avg(case when pnl - fee > 0 then 1 else 0 end) as win_rate,
    avg(case when pnl - fee > 0 then pnl - fee end) / avg(case when pnl - fee < 0 then fee - pnl end) as rr, avg((close_ms - open_ms) / 1000) as hold_s from legs group by 1, 2)
"""


def legs_of(spark, sf_dir):
    return L.fifo_lots(L.costs(S.fills(spark, sf_dir)))


def leg_days(spark, sf_dir):
    return L.daily_legs(legs_of(spark, sf_dir), "Asia/Tokyo", 6)


@query(LEGS + """select symbol, buy_id, sell_id, round(q, 8) as q, cast(floor(pnl * 1e4::double + 0.3137::double) as bigint) as pnl_e4, cast(floor(fee * 1e6::double + 0.3137::double) as bigint) as fee_e6, open_ms, close_ms, way from legs""")
def fifo_lots(spark, sf_dir):
    return legs_of(spark, sf_dir).select("symbol", "buy_id", "sell_id", F.round("q", 8).alias("q"), F.floor(F.col("pnl") * 1e4 + 0.3137).cast("long").alias("pnl_e4"), F.floor(F.col("fee") * 1e6 + 0.3137).cast("long").alias("fee_e6"), "open_ms", "close_ms", "way")


@query(LEGS + "select day, symbol, cast(floor(gross * 1e4::double + 0.3137::double) as bigint) as gross_e4, cast(floor(fee * 1e4::double + 0.3137::double) as bigint) as fee_e4, cast(floor(net * 1e4::double + 0.3137::double) as bigint) as net_e4, cast(floor(turnover * 1e4::double + 0.3137::double) as bigint) as turnover_e4, legs, wins, losses, cast(floor(win_rate * 1e4::double + 0.3137::double) as bigint) as win_rate_e4, cast(floor(rr * 1e4::double + 0.3137::double) as bigint) as rr_e4, cast(floor(hold_s * 1e4::double + 0.3137::double) as bigint) as hold_s_e4 from leg_days")
def daily_results(spark, sf_dir):
    d = leg_days(spark, sf_dir)
    return d.select("day", "symbol", "legs", "wins", "losses", *(F.floor(F.col(c) * 1e4 + 0.3137).cast("long").alias(f"{c}_e4") for c in ("gross", "fee", "net", "turnover", "win_rate", "rr", "hold_s")))


@query(LEGS + """select symbol, round(sum(net), 2) as total, round(avg(net) / stddev_samp(net) * sqrt(252), 6) as sharpe, round(avg(net) / stddev_samp(case when net < 0 then net end) * sqrt(252), 6) as sortino, round(max(peak - equity), 2) as drawdown,
  round(avg(net) * 252 / max(peak - equity), 6) as mar, round(avg(cast(net > 0 as integer)), 6) as win_rate, count(*) as days from (select *, max(equity) over (partition by symbol order by day) as peak from (select *, sum(net) over (partition by symbol order by day) as equity from leg_days)) group by 1""")
def performance(spark, sf_dir):
    return L.performance(leg_days(spark, sf_dir))


@query(LEGS + """select day, round(net, 4) as net, round(equity, 4) as equity, round(max(equity) over (order by day) - equity, 4) as drawdown from (select day, net, sum(net) over (order by day) as equity from (select day, sum(net) as net from leg_days group by 1))""")
def equity_curve(spark, sf_dir):
    return L.equity_curve(leg_days(spark, sf_dir)).select("day", *(F.round(c, 4).alias(c) for c in ("net", "equity", "drawdown")))


@query("select day, symbol, round(net, 2) as net, round(fee, 2) as fee, round(turnover, 2) as turnover, trades from days")
def daily_cash(spark, sf_dir):
    return L.daily(S.fills(spark, sf_dir)).select("day", "symbol", *(F.round(c, 2).alias(c) for c in ("net", "fee", "turnover")), "trades")


@query("""select h.hour, count(c.fill_id) as n, round(coalesce(sum(c.fee), 0), 2) as fee, round(coalesce(sum(c.notional), 0), 2) as notional from (select range as hour from range(24)) h
  left join costs c on (c.ts_ms // 3600000) % 24 = h.hour group by 1""")
def hourly_report(spark, sf_dir):
    by = L.costs(S.fills(spark, sf_dir)).groupBy((F.expr("ts_ms div 3600000") % 24).alias("hour")).agg(F.count("*").alias("n"), F.sum("fee").alias("fee"), F.sum("notional").alias("notional"))
    return spark.range(24).withColumnRenamed("id", "hour").join(by, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), *(F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("fee", "notional")))


_SCENARIO = "case when slippage_bps > 5 then 'A' else 'Q' end || '_' || case when abs(fee_bps) >= 4 then 'H' else 'L' end"


@query(f"select {_SCENARIO} as scenario, count(*) as n, round(sum(notional), 2) as notional, round(sum(fee) / sum(notional) * 1e4, 6) as fee_rate from costs group by 1")
def scenario_report(spark, sf_dir):
    name = F.concat(F.when(F.col("slippage_bps") > 5, "A").otherwise("Q"), F.lit("_"), F.when(F.abs("fee_bps") >= 4, "H").otherwise("L"))
    c = L.costs(S.fills(spark, sf_dir)).groupBy(name.alias("scenario"))
    return c.agg(F.count("*").alias("n"), F.round(F.sum("notional"), 2).alias("notional"), rounded(F.sum("fee") / F.sum("notional") * 1e4).alias("fee_rate"))


@query("""select fill_id, round(notional, 2) as notional, way from ((select fill_id, notional, 'top' as way from costs order by notional desc, fill_id limit 10) union all (select fill_id, notional, 'bottom' as way from costs order by notional, fill_id limit 10))""")
def top_and_bottom(spark, sf_dir):
    c = L.costs(S.fills(spark, sf_dir)).select("fill_id", "notional")
    top = c.orderBy(F.desc("notional"), "fill_id").limit(10).withColumn("way", F.lit("top"))
    return top.unionByName(c.orderBy("notional", "fill_id").limit(10).withColumn("way", F.lit("bottom"))).withColumn("notional", F.round("notional", 2))


@query(""", t as (select symbol || '-' || cast(day // 90 as varchar) as trial, round(sum(net), 2) as pnl, round(sum(fee), 2) as fee from days group by 1)
  select trial, pnl, fee, round((rank() over (order by pnl) - 1) / count(*) over (), 6) as score,
         not exists (select 1 from t o where o.pnl >= t.pnl and o.fee <= t.fee and (o.pnl > t.pnl or o.fee < t.fee)) as front from t""")
def ranked_trials(spark, sf_dir):
    d = L.daily(S.fills(spark, sf_dir))
    t = d.groupBy(F.concat_ws("-", "symbol", F.expr("day div 90").cast("string")).alias("trial")).agg(F.round(F.sum("net"), 2).alias("pnl"), F.round(F.sum("fee"), 2).alias("fee"))
    front = L.pareto(t, ["pnl"], ["fee"], "trial").select("trial", F.lit(True).alias("front"))
    score = (F.rank().over(Window.orderBy("pnl")) - 1) / F.count("*").over(Window.partitionBy())
    return t.withColumn("score", rounded(score)).join(front, "trial", "left").select("trial", "pnl", "fee", "score", F.coalesce("front", F.lit(False)).alias("front"))


@query("""select status, count(*) as n from (select case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as status from
  (select distinct symbol || ':' || (ts_ms // 60000) as k from trades) a full outer join (select distinct symbol || ':' || (ts_ms // 60000) as k from book) b using (k)) group by 1""")
def reconciled_minutes(spark, sf_dir):
    key = F.concat_ws(":", "symbol", F.expr("ts_ms div 60000").cast("string")).alias("k")
    a, b = (x.select(key).distinct().withColumn(n, F.lit(1)) for x, n in ((S.trades(spark, sf_dir), "a"), (S.book(spark, sf_dir), "b")))
    status = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both")
    return a.join(b, "k", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""select symbol, seq, 'run-' || symbol || '-' || ts_ms || '-' || (row_number() over (partition by symbol order by ts_ms, seq) - 1) as signal_id, left(sha256(symbol || '|' || printf('%.8f', score)), 32) as order_key from signals""")
def stable_ids(spark, sf_dir):
    n = (F.col("_n") - 1).cast("string")
    order = F.substring(F.sha2(F.concat_ws("|", "symbol", F.format_string("%.8f", "score")), 256), 1, 32)
    return numbered(S.signals(spark, sf_dir)).select("symbol", "seq", F.concat_ws("-", F.lit("run"), "symbol", F.col("ts_ms").cast("string"), n).alias("signal_id"), order.alias("order_key"))


from . import flow, reports, rules, settings  # noqa: E402, F401  these register their queries too
