"""Queries of reports, reconciliation and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import rounded
from ..functions import rules as R
from ..operators import decisions as D
from ..operators import ledger as L
from ..operators import matching as M
from ..operators import trials as T
from ..operators import reports as P
from .base import query

# A trade of the reports is a fill with an invented result, so that all its sums are sums of the fills' own columns.
_TR = """, tr as (select *, case when slippage_bps > 5 then 'A' else 'Q' end || '_' || case when fee_bps >= 4 then 'H' else 'L' end as scenario, (ts_ms // 3600000) % 24 as hour, (px - floor(px / 100) * 100 - 50) * qty as gross, notional * slippage_bps / 1e4::double as slip,
  cast(ts_ms % 1000 as double) as hold_s, (px - floor(px / 100) * 100 - 50) * qty - fee - notional * slippage_bps / 1e4::double as net from costs)
"""
_ROUNDED = "round(sum(gross), 2) as gross, round(sum(fee), 2) as fee, round(sum(slip), 2) as slip, round(sum(net), 2) as net, round(avg((net > 0)::int), 6) as win_rate, round(avg(case when net > 0 then net end) / avg(case when net < 0 then -net end), 6) as rr, round(avg(hold_s), 4) as hold_s, round(sum(fee + slip) / greatest(sum(notional), 1e-9) * 1e4, 6) as cost_bps"


def trades(spark, d):
    name = F.concat(F.when(F.col("slippage_bps") > 5, "A").otherwise("Q"), F.lit("_"), F.when(F.col("fee_bps") >= 4, "H").otherwise("L"))
    t = L.costs(S.fills(spark, d)).withColumn("scenario", name).withColumn("hour", F.expr("ts_ms div 3600000 % 24"))
    t = t.withColumn("gross", (F.col("px") - F.floor(F.col("px") / 100) * 100 - 50) * F.col("qty")).withColumn("slip", F.col("notional") * F.col("slippage_bps") / 1e4)
    return t.withColumn("hold_s", (F.col("ts_ms") % 1000).cast("double")).withColumn("net", F.col("gross") - F.col("fee") - F.col("slip"))


def _shown(stats, *keys):
    two = lambda c: F.round(c, 2).alias(c)
    return stats.select(*keys, "n", *map(two, ("gross", "fee", "slip", "net")), rounded(F.col("win_rate")).alias("win_rate"), rounded(F.col("rr")).alias("rr"), F.round("hold_s", 4).alias("hold_s"), rounded(F.col("cost_bps")).alias("cost_bps"))


@query(_TR + f"select h.hour, coalesce(t.n, 0) as n, t.* exclude (hour, n) from (select range as hour from range(24)) h left join (select hour, count(*) as n, {_ROUNDED} from tr group by 1) t using (hour)")
def hour_stats(spark, sf_dir):
    return _shown(P.by_hour(trades(spark, sf_dir), F.col("hour")), "hour")


@query(_TR + f"select scenario, count(*) as n, {_ROUNDED} from tr group by 1")
def scenario_stats(spark, sf_dir):
    return _shown(P.trade_stats(trades(spark, sf_dir), "scenario"), "scenario")


@query(_TR + f"select symbol, count(*) as n, {_ROUNDED} from tr group by 1")
def symbol_stats(spark, sf_dir):
    return _shown(P.trade_stats(trades(spark, sf_dir), "symbol"), "symbol")


@query(_TR + f"select scenario, case when hour < 8 then 'Tokyo' when hour < 16 then 'London' else 'NY' end as session, count(*) as n, {_ROUNDED} from tr group by 1, 2")
def scenario_session_stats(spark, sf_dir):
    from ..functions import session_label

    return _shown(P.trade_stats(trades(spark, sf_dir), "scenario", session_label(F.col("hour")).alias("session")), "scenario", "session")


@query(_TR + "select hour, " + ", ".join(f"round(avg((net > 0)::int) filter (scenario = '{s}'), 6) as {s}" for s in R.SCENARIOS) + " from tr group by 1")
def win_matrix(spark, sf_dir):
    m = P.win_matrix(trades(spark, sf_dir), F.col("hour"), F.col("scenario"), R.SCENARIOS)
    return m.select("hour", *(rounded(F.col(s)).alias(s) for s in R.SCENARIOS))


@query(_TR + "select fill_id, way, round(gross, 4) as gross from ((select fill_id, 'top' as way, gross from tr order by gross desc, fill_id limit 10) union all (select fill_id, 'bottom', gross from tr order by gross, fill_id limit 10))")
def best_and_worst(spark, sf_dir):
    t = trades(spark, sf_dir).select("fill_id", "gross")
    best = t.orderBy(F.desc("gross"), "fill_id").limit(10).withColumn("way", F.lit("top"))
    return best.unionByName(t.orderBy("gross", "fill_id").limit(10).withColumn("way", F.lit("bottom"))).withColumn("gross", F.round("gross", 4))


@query(_TR + "select symbol, round(sum(net + fee + slippage_bps * coalesce(case when qty < 40 then notional end, case when qty < 45 then qty * px end, 200) / 1e4), 2) as gross from tr group by 1")
def gross_backed_out(spark, sf_dir):
    q = F.col("qty")
    g = P.gross_of(F.col("net"), F.col("fee"), F.col("slippage_bps"), F.when(q < 40, F.col("notional")), F.when(q < 45, q), F.col("px"))
    return trades(spark, sf_dir).groupBy("symbol").agg(F.round(F.sum(g), 2).alias("gross"))


@query(_TR + """, m as (select *, case scenario when 'Q_L' then 0.8::double when 'Q_H' then 0.6::double when 'A_L' then 0.5::double else 0.3::double end as p from tr)
  select symbol, round(avg((p > 0.55)::int), 6) as maker, round(avg((p > 0.55)::int) filter (side = 'buy'), 6) as maker_entry, round(avg((p > 0.55)::int) filter (side <> 'buy'), 6) as maker_exit, round(sum(notional * p), 2) as maker_turnover, round(sum(notional * (1 - p)), 2) as taker_turnover, round(quantile_cont(slippage_bps, 0.5), 6) as spread_p50, round(quantile_cont(slippage_bps, 0.95), 6) as spread_p95,
    round(sum(case when p > 0.55 then notional else 0 end), 2) as by_makers, round(sum(case when p > 0.55 then 0 else notional end), 2) as by_takers from m group by 1""")
def maker_shares(spark, sf_dir):
    p = L._pick(F.col("scenario"), {"Q_L": 0.8, "Q_H": 0.6, "A_L": 0.5}, 0.3)
    m = P.maker_shares(trades(spark, sf_dir).withColumn("p", p), F.col("p") > 0.55, F.col("side") == "buy")
    return m.select("symbol", *(rounded(F.col(c)).alias(c) for c in ("maker", "maker_entry", "maker_exit", "spread_p50", "spread_p95")), *(F.round(c, 2).alias(c) for c in ("maker_turnover", "taker_turnover", "by_makers", "by_takers")))


@query(_TR + """select tier, n, turnover, fee, cost_bps, bad_scenario, bad_fee, round(raw / sum(raw) over (), 6) as share from (select case when notional >= 50000 then 'large' when notional >= 20000 then 'middle' else 'small' end as tier, count(*) as n, sum(notional) as raw, round(sum(notional), 2) as turnover, round(sum(f), 2) as fee,
    round(sum(coalesce(f, 0) + notional * slippage_bps / 1e4::double) / greatest(sum(notional), 1e-9) * 1e4, 6) as cost_bps, round(avg(case when scenario in ('A_H', 'A_L', 'Q_H') then 0 else 1 end), 6) as bad_scenario, round(avg(case when f >= 0 then 0 else 1 end), 6) as bad_fee
  from (select *, case when fee_bps = 3 then null when fee_bps = 5 then -fee else fee end as f from tr) group by 1)""")
def tier_costs(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("fee", F.when(F.col("fee_bps") == 5, -F.col("fee")).when(F.col("fee_bps") == 3, None).otherwise(F.col("fee")))
    tier = F.when(F.col("notional") >= 50_000, "large").when(F.col("notional") >= 20_000, "middle").otherwise("small")
    g = P.by_tier(t, tier, F.col("scenario"), ("A_H", "A_L", "Q_H"))
    return g.select("tier", "n", F.round("turnover", 2).alias("turnover"), F.round("fee", 2).alias("fee"), *(rounded(F.col(c)).alias(c) for c in ("cost_bps", "bad_scenario", "bad_fee", "share")))


@query("select symbol, reason, count(*) as n, round(count(*) / any_value(all_), 6) as share from (select symbol, unnest(reasons) as reason, 1 as one from judged) join (select symbol, sum(len(reasons)) as all_ from judged group by 1) using (symbol) group by 1, 2")
def reason_shares(spark, sf_dir):
    r = D.confirmed(S.signals(spark, sf_dir)).select("symbol", F.explode("reasons").alias("reason"))
    return P.tally(r, "symbol", "reason", share_of="symbol").withColumn("share", rounded(F.col("share")))


@query("select reason, ts_ms // 86400000 as day, count(*) as n from (select ts_ms, unnest(reasons) as reason from judged) group by 1, 2")
def reasons_by_day(spark, sf_dir):
    return D.confirmed(S.signals(spark, sf_dir)).select(F.explode("reasons").alias("reason"), F.expr("ts_ms div 86400000").alias("day")).groupBy("reason", "day").agg(F.count("*").alias("n"))


@query("""select symbol, minute, count(seq) as signals, count(*) filter (confirm) as confirmed from (select symbol, unnest(range(m - 4, m + 1)) as minute from (select symbol, max(ts_ms) // 60000 as m from signals group by 1))
  left join (select symbol, ts_ms // 60000 as minute, seq, len(reasons) = 0 and score <> 0 as confirm from judged) using (symbol, minute) group by 1, 2""")
def last_minutes(spark, sf_dir):
    return P.last_minutes(D.confirmed(S.signals(spark, sf_dir)), 5)


@query("""select symbol, round(avg((score > 0)::int), 6) as buy, round(avg((score < 0)::int), 6) as sell, round(avg((abs(score) >= 1.5)::int), 6) as strong, max(ts_ms) as last_ms from signals group by 1""")
def signal_ratios(spark, sf_dir):
    s = F.col("score")
    return S.signals(spark, sf_dir).groupBy("symbol").agg(rounded(F.avg((s > 0).cast("int"))).alias("buy"), rounded(F.avg((s < 0).cast("int"))).alias("sell"), rounded(F.avg((F.abs(s) >= 1.5).cast("int"))).alias("strong"), F.max("ts_ms").alias("last_ms"))


@query("select symbol, seq from (select *, row_number() over (partition by symbol, ts_ms order by abs(score) desc, seq) as n from (select *, ts_ms // 86400000 * 86400000 as t0 from signals)) where n = 1")
def strongest_at_once(spark, sf_dir):
    from ..operators.quality import keep_one

    return keep_one(S.signals(spark, sf_dir), ["symbol", "ts_ms"], F.desc(F.abs("score")), F.col("seq")).select("symbol", "seq")


@query("select symbol, seq, ts_ms from (select *, row_number() over (partition by symbol order by ts_ms desc, seq desc) as n from signals) where n <= 5 order by ts_ms desc, seq desc, symbol limit 20")
def latest_signals(spark, sf_dir):
    return P.last_of_each(S.signals(spark, sf_dir), 5, 20).select("symbol", "seq", "ts_ms")


@query("select symbol, round(quantile_cont(z_cvd, 0.05), 6) as p05, round(quantile_cont(z_cvd, 0.95), 6) as p95, round(quantile_cont(z_cvd, 0.99), 6) as p99, round(quantile_cont(abs(z_cvd), 0.95), 6) as abs_p95, round(avg((abs(z_cvd) >= 2)::int), 6) as clip_rate from (select *, row_number() over (partition by symbol order by ts_ms desc, seq desc) as n from signals) where n <= 1000 group by 1")
def volume_monitor(spark, sf_dir):
    last = P.last_of_each(S.signals(spark, sf_dir), 1000, 1 << 30)
    q = P.quantiles(last, "z_cvd", "symbol")
    return q.select("symbol", *(rounded(F.col(c)).alias(c) for c in q.columns[1:]))


@query("select round(corr(spread_bps, w), 6) as r, count(*) as n from (select spread_bps, avg((score > 0)::int) as w from signals group by 1)")
def gate_correlation(spark, sf_dir):
    g = S.signals(spark, sf_dir).groupBy("spread_bps").agg(F.avg((F.col("score") > 0).cast("int")).alias("w"))
    return g.agg(rounded(F.corr("spread_bps", "w")).alias("r"), F.count("*").alias("n"))


@query("""select symbol, count(*) as n, round(avg(0.5 * (seq % 50 <> 0)::int + 0.25 * (seq % 30 <> 0)::int + 0.25 * (seq % 20 <> 0)::int), 6) as score, case when avg(0.5 * (seq % 50 <> 0)::int + 0.25 * (seq % 30 <> 0)::int + 0.25 * (seq % 20 <> 0)::int) < 0.98 then 'critical' when avg(0.5 * (seq % 50 <> 0)::int + 0.25 * (seq % 30 <> 0)::int + 0.25 * (seq % 20 <> 0)::int) < 0.99 then 'warning' else 'ok' end as level from signals group by 1""")
def shadow_parity(spark, sf_dir):
    k = F.col("seq")
    return P.parity_score(S.signals(spark, sf_dir), k % 50 != 0, k % 30 != 0, k % 20 != 0).withColumn("score", rounded(F.col("score")))


@query("""select symbol, metric, round(a, 6) as a, round(b, 6) as b, abs(a - b) / greatest(abs(a), abs(b), 1e-9) <= 0.02 as within from (select symbol, unnest(['score', 'z']) as metric, unnest([avg(score) filter (seq % 2 = 0), avg(z_ofi) filter (seq % 2 = 0)]) as a, unnest([avg(score) filter (seq % 2 = 1), avg(z_ofi) filter (seq % 2 = 1)]) as b from signals group by symbol)""")
def ab_metrics(spark, sf_dir):
    one = lambda r: S.signals(spark, sf_dir).where(F.col("seq") % 2 == r).groupBy("symbol").agg(F.avg("score").alias("score"), F.avg("z_ofi").alias("z"))
    m = P.compared_metrics(one(0), one(1), "symbol", ["score", "z"], 0.02)
    return m.select("symbol", "metric", rounded(F.col("a")).alias("a"), rounded(F.col("b")).alias("b"), "within")


# trials

_TRIALS = """, trials as (select symbol || '-' || cast(day // 90 as varchar) as trial, symbol, day // 90 as span, round(sum(net), 2) as pnl, round(sum(fee), 2) as fee, sum(trades)::bigint as trades, round(max(abs(net)), 2) as worst from days group by all)
"""


def _trials(spark, d):
    span = F.expr("day div 90")
    t = L.daily(S.fills(spark, d)).withColumn("span", span).groupBy("symbol", "span").agg(F.round(F.sum("net"), 2).alias("pnl"), F.round(F.sum("fee"), 2).alias("fee"), F.sum("trades").cast("long").alias("trades"), F.round(F.max(F.abs("net")), 2).alias("worst"))
    return t.withColumn("trial", F.concat_ws("-", "symbol", F.col("span").cast("string")))


@query(_TRIALS + """select trial, round(((rank() over (order by pnl) - 1) * 1.0 + (rank() over (order by fee desc) - 1) * 0.5) / count(*) over () - case when trades < 300 then 0.2 else 0 end - case when pnl < 0 then 0.1 else 0 end, 6) as score from trials""")
def trial_scores(spark, sf_dir):
    s = P.rank_scores(_trials(spark, sf_dir), {"pnl": 1.0}, {"fee": 0.5}, [(F.col("trades") < 300, 0.2), (F.col("pnl") < 0, 0.1)])
    return s.select("trial", rounded(F.col("score")).alias("score"))


@query(_TRIALS + "select span, round(avg(pnl), 4) as score, count(*) as symbols from trials group by 1")
def multi_symbol_scores(spark, sf_dir):
    return _trials(spark, sf_dir).groupBy("span").agg(F.round(F.avg("pnl"), 4).alias("score"), F.count("*").alias("symbols"))


@query(_TRIALS + "select symbol, sum(trades)::bigint as trades, round(sum(pnl), 2) as pnl, round(sum(fee * trades) / sum(trades), 4) as fee, max(worst) as worst from trials group by 1")
def merged_metrics(spark, sf_dir):
    m = P.merged_windows(_trials(spark, sf_dir), "symbol", ["pnl"], ["fee"], ["worst"])
    return m.select("symbol", "trades", F.round("pnl", 2).alias("pnl"), F.round("fee", 4).alias("fee"), "worst")


@query(""", ends as (select min(day) as lo, max(day) as hi from days), folds as (select f as fold, lo + f * 100 as a, lo + f * 100 + 300 as b, lo + f * 100 + 400 as c from ends, (select unnest(range(0, greatest(0, (hi - lo + 1 - 300) // 100))) as f from ends))
  select fold::int as fold, symbol, round(avg(net) filter (day < b), 4) as train, round(avg(net) filter (day >= b), 4) as test from days join folds on day >= a and day < c group by 1, 2""")
def walk_forward(spark, sf_dir):
    w = P.walk_forward(L.daily(S.fills(spark, sf_dir)), 300, 100)
    return w.select("fold", "symbol", F.round("train", 4).alias("train"), F.round("test", 4).alias("test"))


@query("""select symbol, round(mean_lag, 6) as mean_lag, samples, round(rate, 6) as success_rate from (select symbol, avg(lag) as mean_lag, count(*) as samples from (select symbol, lag_sec as lag from signals where seq % 7 > 0 qualify row_number() over (partition by symbol order by ts_ms desc, seq desc) <= 100) group by 1)
  join (select symbol, avg(case when abs(score) >= 0.5 then 1 else 0 end) as rate from signals group by 1) using (symbol)""")
def lag_samples(spark, sf_dir):
    s = S.signals(spark, sf_dir).withColumn("lag", F.when(F.col("seq") % 7 > 0, F.col("lag_sec")))
    return P.lag_samples(s, "lag", F.abs("score") >= 0.5).select("symbol", rounded(F.col("mean_lag")).alias("mean_lag"), "samples", rounded(F.col("success_rate")).alias("success_rate"))


@query("""select event_id, symbol, exec_ts_ms, k from (select event_id, 'S' || cast(user_id % 8 as varchar) as symbol, epoch_us(ts) // 1000 as exec_ts_ms, cast(json_extract_string(props, '$.k') as bigint) as k from events) where symbol in ('S1', 'S5') and exec_ts_ms >= 1704100000000""")
def exported_executions(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("exec_ts_ms"), F.col("props").alias("meta_json"))
    return P.executions(e, "k long", ["S1", "S5"], 1704100000000).select("event_id", "symbol", "exec_ts_ms", "meta.k")


@query("""select w_ofi, w_cvd, weak, row_number() over (order by md5(printf('%.8f|%.8f|%.8f', w_ofi, w_cvd, weak)))::int as trial from (select distinct round(a / (a + b), 9) as w_ofi, round(b / (a + b), 9) as w_cvd, weak from (select unnest([0.2::double, 0.4::double, 0.6::double]) as a), (select unnest([0.4::double, 0.8::double]) as b), (select unnest([0.3::double, 0.5::double]) as weak)) qualify trial <= 8""")
def parameter_grid(spark, sf_dir):
    return P.grid(spark, {"w_ofi": [0.2, 0.4, 0.6], "w_cvd": [0.4, 0.8], "weak": [0.3, 0.5]}, 8)


@query(_TRIALS + "select trial from (select trial, row_number() over (order by pnl desc, trial) as r, count(*) over () as n from trials) where r <= greatest(1, n // 3)")
def halved_trials(spark, sf_dir):
    return P.halved(_trials(spark, sf_dir), F.col("pnl"), 3).select("trial")


_STEPS = _TRIALS + """, steps as (select symbol || '-' || (day // 90) as trial, day % 90 as step, net, fee, trades, abs(net) as worst from days),
  l1 as (select trial, 1 as level, 10 as budget, sum(net) as net, sum(fee * trades) / sum(trades) as fee, max(worst) as worst, sum(trades) as trades from steps where step < 10 group by 1),
  a1 as (select t.trial, 1 as level, 10 as budget, l.net, l.fee, l.worst, l.trades, round(l.net - l.fee, 2) as score from (select distinct trial from steps) t left join l1 l using (trial)),
  k1 as (select trial from (select trial, row_number() over (order by coalesce(score, '-infinity'::double) desc, trial) as r, count(*) over () as n from a1) where r <= greatest(1, n // 3)),
  a2 as (select trial, 2 as level, 30 as budget, sum(net) as net, sum(fee * trades) / sum(trades) as fee, max(worst) as worst, sum(trades) as trades, round(sum(net) - sum(fee * trades) / sum(trades), 2) as score from steps where step < 30 and trial in (from k1) group by 1),
  k2 as (select trial from (select trial, row_number() over (order by coalesce(score, '-infinity'::double) desc, trial) as r, count(*) over () as n from a2) where r <= greatest(1, n // 3)),
  a3 as (select trial, 3 as level, 90 as budget, sum(net) as net, sum(fee * trades) / sum(trades) as fee, max(worst) as worst, sum(trades) as trades, round(sum(net) - sum(fee * trades) / sum(trades), 2) as score from steps where trial in (from k2) group by 1)
"""


@query(_STEPS + "select trial, level, budget, score, cast(trades as bigint) as trades, round(worst, 2) as worst from (from a1 union all by name from a2 union all by name from a3)")
def halving_levels(spark, sf_dir):
    steps = L.daily(S.fills(spark, sf_dir)).select(F.concat_ws("-", "symbol", F.expr("day div 90").cast("string")).alias("trial"), F.expr("day % 90").alias("step"), "net", "fee", F.col("trades").cast("long").alias("trades"), F.abs("net").alias("worst"))
    h = T.successive_halving(steps, F.round(F.col("net") - F.col("fee"), 2), ["net"], ["fee"], ["worst"], 10, 90, 3)
    return h.select("trial", "level", "budget", "score", F.col("trades").cast("long").alias("trades"), F.round("worst", 2).alias("worst"))


@query(_TRIALS + """select trial from trials a where not exists (select 1 from trials b where b.pnl >= a.pnl and b.fee <= a.fee and b.trades >= a.trades and b.worst <= a.worst and (b.pnl > a.pnl or b.fee < a.fee or b.trades > a.trades or b.worst < a.worst))""")
def four_goal_front(spark, sf_dir):
    return T.front(_trials(spark, sf_dir), ["pnl", "trades"], ["fee", "worst"]).select("trial")


@query(_TRIALS + "select count(*) as trials, cast(sum(('0x' || left(sha256(trial || '|' || trades), 15))::hugeint) as varchar) as fingerprint from trials")
def trial_manifest(spark, sf_dir):
    from ..operators.quality import fingerprint

    return fingerprint(_trials(spark, sf_dir), ["trial", "trades"]).select(F.col("n").alias("trials"), "fingerprint")


# matching

@query("""select fill_id, symbol, entry_ms, hold_s from (select *, lag(ts_ms) over w as entry_ms, (ts_ms - lag(ts_ms) over w) / 1000 as hold_s, e, lag(e) over w as was from (select *, fill_id < '8' as e from fills) window w as (partition by symbol, side order by ts_ms, fill_id)) where not e and was""")
def paired_trades(spark, sf_dir):
    return M.paired(S.fills(spark, sf_dir).withColumn("seq", F.col("fill_id")), F.col("fill_id") < "8").select("fill_id", "symbol", "entry_ms", "hold_s")


_TWO = """, a as (select seq, symbol, score, spread_bps from signals where seq % 7 <> 0), b as (select seq, symbol, case when seq % 5 = 0 then score + 1 else score end as score, spread_bps from signals where seq % 11 <> 0)
"""


def _two(spark, d):
    s = S.signals(spark, d).select("seq", "symbol", "score", "spread_bps", "ts_ms")
    return s.where("seq % 7 <> 0"), s.where("seq % 11 <> 0").withColumn("score", F.when(F.col("seq") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")))


@query(_TWO + """select seq, symbol, case when x is null then 'right_only' when y is null then 'left_only' else 'both' end as status, case when x is not null and y is not null and s1 is distinct from s2 then 'score' else '' end as differs from (select seq, symbol, 1 as x, score as s1 from a) full outer join (select seq, symbol, 1 as y, score as s2 from b) using (seq, symbol)""")
def reconciled_signals(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return M.reconciled(a, b, ["seq", "symbol"], ["score", "spread_bps"]).withColumn("differs", F.array_join("differs", ","))


@query(_TWO + """select count(*) filter (x and y) as both, count(*) filter (x and y is null) as left_only, count(*) filter (y and x is null) as right_only, count(*) filter (x and y and s1 is distinct from s2) as different, round(count(*) filter (x and y) / count(*), 6) as parity, 'partial' as overlap from (select seq, true as x, score as s1 from a) full outer join (select seq, true as y, score as s2 from b) using (seq)""")
def sink_parity(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return M.parity(M.reconciled(a, b, ["seq", "symbol"], ["score", "spread_bps"])).withColumn("parity", rounded(F.col("parity")))


@query(_TWO + "select seq from a where seq not in (select seq from b)")
def not_yet_executed(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return M.not_yet_done(a, b, ["seq"]).select("seq")


@query(_TWO + """, x as (select symbol, score, row_number() over (partition by symbol order by seq) as i from a), y as (select symbol, score, row_number() over (partition by symbol order by seq) as i from b)
  select symbol, missing, equal, count(*) as n from (select symbol, case when x.score is null then 'left' when y.score is null then 'right' end as missing, coalesce(abs(x.score - y.score) <= 0.5, false) as equal from x full outer join y using (symbol, i)) group by all""")
def compared_fills(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return M.compared_fills(a, b, ["seq"], ["score"], 0.5).groupBy("symbol", "missing", "equal").agg(F.count("*").alias("n"))


@query("select symbol, lim, count(*) as n from (select symbol, case symbol when 'C0' then 5.0 when 'C1' then 7.0 else 9.0 end as lim from signals) group by all")
def symbol_limits(spark, sf_dir):
    limits = spark.createDataFrame([("C0", 5.0), ("C1", 7.0)], "symbol string, lim double")
    return M.looked_up(S.signals(spark, sf_dir), limits, ["symbol"], {"lim": 9.0}).groupBy("symbol", "lim").agg(F.count("*").alias("n"))


@query("""select 'wide' as kind, inside, count(*) as signals, count(*) filter (confirm) as confirmed, round(avg(confirm::int), 6) as rate from (select s.*, len(reasons) = 0 and score <> 0 as confirm, coalesce(s.ts_ms - e.ts_ms <= 43200000, false) as inside from judged s asof left join (select distinct symbol, ts_ms from signals where spread_bps >= 28) e on s.symbol = e.symbol and s.ts_ms >= e.ts_ms) group by inside""")
def event_links(spark, sf_dir):
    s = D.confirmed(S.signals(spark, sf_dir))
    events = s.where("spread_bps >= 28").select("symbol", "ts_ms", F.lit("wide").alias("kind"))
    return M.linked(events, s, 43_200_000).withColumn("rate", rounded(F.col("rate")))
