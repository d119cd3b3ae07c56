"""Streaming bindings: the same transforms over readStream input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    return rows.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)


def second_bars(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Per symbol and second: trades, volume and last price by event time; late rows within the watermark still count."""
    return timed(rows, late).groupBy(F.window("at", "1 second").alias("w"), "symbol").agg(F.count("*").alias("trades"), F.sum("qty").alias("volume"), F.max_by("price", "ts_ms").alias("last")).select(F.unix_seconds("w.start").alias("second"), "symbol", "trades", "volume", "last")


def sliding_rates(rows: DataFrame, span: str = "60 seconds", every: str = "1 second", late: str = "2 hours") -> DataFrame:
    """Trades and volume of each span that ends on a multiple of `every`."""
    g = timed(rows, late).groupBy(F.window("at", span, every).alias("w"), "symbol").agg(F.count("*").alias("trades"), F.sum("qty").alias("volume"))
    return g.select(F.unix_seconds("w.end").alias("second"), "symbol", "trades", "volume")


def sessions(rows: DataFrame, gap: str = "2 seconds", late: str = "2 hours") -> DataFrame:
    """Spells of activity that end with a gap: symbol, first and last second boundary, rows."""
    g = timed(rows, late).groupBy(F.session_window("at", gap).alias("w"), "symbol").agg(F.count("*").alias("rows"))
    return g.select("symbol", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "rows")


def first_of_each(rows: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(rows, late).dropDuplicatesWithinWatermark(keys)


def latencies(rows: DataFrame) -> DataFrame:
    """latency_ms: receive time less event time, 0 at least."""
    return rows.withColumn("latency_ms", F.greatest(F.lit(0).cast("long"), F.col("recv_ts_ms") - F.col("ts_ms")))


def running_volume(trades: DataFrame) -> DataFrame:
    """symbol, seq, ts_ms, cvd: signed quantities added up by symbol; the sum and the last price are the state. Rows of a
    micro-batch are taken in order of (ts_ms, seq); a missing side follows the price."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last = state.get if state.exists else (0.0, float("nan"))
        rows = pd.concat(list(parts)).sort_values(["ts_ms", "seq"])
        out = []
        for r in rows.itertuples():
            side = r.side if r.side in ("buy", "sell") else "buy" if r.price >= last else "sell"
            total += r.qty if side == "buy" else -r.qty
            last = r.price
            out.append((key[0], r.seq, r.ts_ms, total))
        state.update((total, last))
        yield pd.DataFrame(out, columns=["symbol", "seq", "ts_ms", "cvd"])

    return trades.where("qty > 0").groupBy("symbol").applyInPandasWithState(step, "symbol string, seq long, ts_ms long, cvd double", "total double, last double", "append", GroupStateTimeout.NoTimeout)


def fresh(rows: DataFrame, cooldown_ms: int, keys: list[str]) -> DataFrame:
    """Rows above their key's high-water mark (ts_ms of the last row let through) by cooldown_ms or more; the first of a key
    passes. With cooldown_ms = 1 each key's repeated and late rows go."""
    names, kinds = rows.columns, dict(rows.dtypes)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        kept = []
        for r in pd.concat(list(parts)).sort_values(["ts_ms", "seq"]).to_dict("records"):
            if mark is None or r["ts_ms"] - mark >= cooldown_ms:
                mark = r["ts_ms"]
                kept.append(r)
        if mark is not None:
            state.update((mark,))
        yield pd.DataFrame(kept, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(step, ", ".join(f"`{c}` {kinds[c]}" for c in names), "mark long", "append", GroupStateTimeout.NoTimeout)
