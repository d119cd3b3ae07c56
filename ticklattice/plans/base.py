"""What the modules of queries share: the driver's tables as DuckDB sees them, and the two registers."""

from __future__ import annotations

from pyspark.sql import functions as F

VIEWS = """
with recursive tape as (
  select event_id as seq, 'S' || cast(user_id % 8 as varchar) as symbol,
         1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // 100 as ts_ms,
         case when event_type in ('view', 'click') then 'book' else 'trade' end as src,
         100.0::double + value / 10.0::double as price, cast(json_extract_string(props, '$.k') as bigint) as k,
         cast(cast(json_extract_string(props, '$.k') as bigint) + 1 as double) as qty,
         case event_type when 'purchase' then 'buy' when 'error' then 'sell' end as side
  from events),
trades as (select * from tape where src = 'trade'),
book as (
  select seq, symbol, ts_ms, price - (k % 7 + 1) * 0.01::double as best_bid, price + (k % 5 + 1) * 0.01::double as best_ask,
         cast(k % 11 + 1 as double) as bid1_q, cast(k % 13 + 1 as double) as ask1_q, cast(k % 3 + 1 as double) as bid2_q, cast(k % 4 + 1 as double) as ask2_q
  from tape where src = 'book' qualify row_number() over (partition by symbol, ts_ms order by seq desc) = 1),
fills as (
  select md5(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar,
             cast(floor(l_extendedprice * 100 + 0.5) as bigint)::varchar, (epoch_us(l_shipdate::timestamp) // 1000)::varchar)) as fill_id,
         'P' || cast(l_suppkey % 5 as varchar) as symbol, epoch_us(l_shipdate::timestamp) // 1000 + (l_orderkey * 10 + l_linenumber) % 86400000 as ts_ms,
         case when l_returnflag = 'R' then 'sell' when l_returnflag = 'A' then 'buy' when l_linenumber % 2 = 0 then 'buy' else 'sell' end as side,
         l_extendedprice / l_quantity as px, l_quantity::double as qty, l_tax * 100.0::double as fee_bps, l_discount * 100.0::double as slippage_bps
  from lineitem),
costs as (
  select *, px * (1 + case when side = 'buy' then 1 else -1 end * slippage_bps / 1e4::double) as exec_px, px * qty as notional, px * qty * fee_bps / 1e4::double as fee from fills),
signals as (
  select o_orderkey as seq, 'C' || cast(o_custkey % 6 as varchar) as symbol, epoch_us(o_orderdate::timestamp) // 1000 + (o_orderkey % 86400) * 1000 as ts_ms,
         ((o_orderkey * 37) % 200 - 100) / 50.0::double as score, ((o_orderkey * 53) % 600 - 300) / 100.0::double as z_ofi, ((o_orderkey * 71) % 500 - 250) / 100.0::double as z_cvd,
         cast((o_orderkey * 13) % 30 as double) as spread_bps, ((o_orderkey * 17) % 50) / 10.0::double as lag_sec, o_orderkey % 50 = 0 as warmup
  from orders),
scored as (
  select *, case when least(abs(z_ofi), abs(z_cvd)) < 1e-9 or sign(z_ofi) <> sign(z_cvd) then 0.0::double
                 else least(abs(z_ofi), abs(z_cvd)) / greatest(abs(z_ofi), abs(z_cvd)) end as consistency from signals),
judged as (
  select *, list_filter([case when warmup then 'warmup' end, case when spread_bps > 20 then 'spread_bps_exceeded' end, case when lag_sec > 3 then 'lag_sec_exceeded' end,
                         case when consistency < 0.1 then 'low_consistency' end, case when abs(score) < 0.5 then 'weak_signal' end], lambda x: x is not null) as reasons from scored),
days as (
  select ts_ms // 86400000 as day, symbol, sum(case when side = 'sell' then notional else -notional end - fee) as net, sum(fee) as fee, sum(notional) as turnover, count(*) as trades
  from costs group by 1, 2)
"""

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = VIEWS + sql
        return f

    return add


def _i(c: str):
    return F.col(c).cast("long").alias(c)
