"""Readers and writers on small trees, and streams against batches."""

import json

import pytest
from pyspark.sql import functions as F

from ticklattice import sources, streaming
from ticklattice.sources import readers, sinks

TICKS = "symbol string, ts_ms long, seq long, price double, qty double, side string, row_id string"


def ticks(spark):
    rows = [("A", 1_700_000_000_000 + i * 700, i, 10.0 + i % 3, 1.0 + i % 2, ("buy", "sell", None)[i % 3], f"r{i % 9}") for i in range(12)]
    return spark.createDataFrame(rows + [("B", 1_700_003_600_000, 99, float("inf"), 1.0, "buy", "b")], TICKS)


def test_checked_rows_come_back_from_the_tree(spark, tmp_path):
    manifest = sinks.write_checked(ticks(spark), str(tmp_path), "prices", ["price"], [(F.col("price") <= 0, "price")], ["price"]).collect()
    assert sum(r.rows for r in manifest) == 9
    tree = readers.read_tree(spark, f"{tmp_path}/ready", kinds=["prices"], symbols=["A"])
    assert tree.count() == 9 and {"date", "hour", "symbol", "kind"} <= set(tree.columns)
    assert tree.where("row_id = 'r1'").first().seq == 10
    bad = spark.read.json(f"{tmp_path}/deadletter").collect()
    assert len(bad) == 1 and bad[0].reasons == ["missing_price"]


def test_layouts_by_priority_and_range(spark, tmp_path):
    t = ticks(spark).where("symbol = 'A'")
    for name, df in (("ready", t.where("seq < 3").withColumn("price", F.lit(1.0))), ("preview", t)):
        df.write.parquet(f"{tmp_path}/{name}")
    got = readers.read_layouts(spark, [f"{tmp_path}/ready", f"{tmp_path}/preview"], ["symbol", "ts_ms"], 1_700_000_000_000, 1_700_000_002_800).orderBy("seq").collect()
    assert [(r.seq, r.price == 1.0) for r in got] == [(0, True), (1, True), (2, True), (3, False), (4, False)]
    assert sources.read_range(t, 1_700_000_000_700, 1_700_000_001_400, ["A"], inclusive=False).count() == 1
    assert readers.read_features(spark, f"{tmp_path}/preview", ["seq"], end_ms=1_700_000_000_700).columns == ["seq"]


def test_signals_prices_times_and_features(spark, tmp_path):
    (tmp_path / "s" / "deep").mkdir(parents=True)
    row = {"ts_ms": 5, "symbol": "A", "signal_type": "buy", "score": 1.0}
    (tmp_path / "s" / "deep" / "signals-1.jsonl").write_text("\n".join([json.dumps(row), "", "oops", json.dumps(row), json.dumps(row | {"ts_ms": 9})]))
    (tmp_path / "s" / "other.jsonl").write_text(json.dumps(row | {"ts_ms": 1}))
    schema = "ts_ms long, symbol string, signal_type string, score double"
    assert sorted(r.ts_ms for r in readers.read_signals(spark, f"jsonl://{tmp_path}/s", schema, ["A"]).collect()) == [5, 9]
    assert readers.read_signals(spark, f"jsonl://{tmp_path}/s", schema, after_ms=5).count() == 1
    with pytest.raises(ValueError):
        readers.read_signals(spark, "ftp://x", schema)
    (tmp_path / "p.jsonl").write_text('{"ts_ms": 1, "symbol": "A", "price": 3.0}\n{"ts_ms": 2, "symbol": "A", "mid_px": 4.0, "price": 1.0}\n{"ts_ms": 3, "symbol": "A"}')
    assert sorted((r.ts_ms, r.price) for r in readers.read_prices(spark, str(tmp_path / "p.jsonl"), "ready").collect()) == [(1, 3.0), (2, 4.0)]
    (tmp_path / "t.csv").write_text("ts_ms,x\n5,a\nbad,b\n7,c\n")
    assert sorted(r.ts_ms for r in readers.read_times(spark, str(tmp_path / "t.csv")).collect()) == [5, 7]
    raw = spark.createDataFrame([(1, "A", 1.0, -9.0, 500, 100.0, 101.0), (2, "A", None, 1.0, 0, 0.0, 1.0)], "ts_ms long, symbol string, ofi_z double, cvd_z double, lag_ms_price long, best_bid double, best_ask double")
    f = {r.ts_ms: r for r in readers.preview_features(raw).collect()}
    assert (f[1].z_cvd, f[1].lag_sec, f[1].consistency, f[1].warmup, f[1].spread_bps) == (-5.0, 0.5, 0.6, False, 100.0) and f[2].warmup and f[2].consistency == 0 and f[2].spread_bps is None
    n = {r.field: (r.present, r.missing) for r in readers.required_fields(raw, ["ofi_z", "nope"]).collect()}
    assert n == {"ofi_z": (True, 1), "nope": (False, None)}
    warm = readers.with_warm_up(ticks(spark), 1_700_000_005_000, 1, lambda df: df.withColumn("n", F.lit(df.count())))
    assert {r.n for r in warm.collect()} == {13} and warm.count() == 5


def test_messages(spark):
    rows = ['{"s":"A","E":7,"b":[["1","2"],["3","-4"],["x","1"]],"a":[["5","1"],["4","2"]]}', "junk", '{"s":"A","E":9,"T":8,"a":3,"p":"1.5","q":"2","m":true}']
    m = spark.createDataFrame([(x,) for x in rows], "text string")
    book = readers.parsed_books(m.limit(1)).first()
    assert [tuple(x) for x in book.bids] == [(3.0, 0.0), (1.0, 2.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)] and [tuple(x) for x in book.asks][:2] == [(4.0, 2.0), (5.0, 1.0)] and book.bad
    trade = readers.parsed_trades(m.where("text like '%true%'")).first()
    assert (trade.symbol, trade.ts_ms, trade.seq, trade.price, trade.qty, trade.side, trade.latency_ms) == ("A", 8, 3, 1.5, 2.0, "sell", 1)
    log = spark.createDataFrame([("lag=3 lag=9",), ("x",)], "value string")
    assert [tuple(r) for r in readers.log_metrics(log, {"lag": r"lag=(\d+)"}).collect()] == [("lag", 9.0, 2)]


def test_sinks_for_signals_results_and_reports(spark, tmp_path):
    s = spark.createDataFrame([("A", 1, 1.0, True), ("A", 3_600_000, 2.0, False)], "symbol string, ts_ms long, score double, confirm boolean")
    sinks.fan_out(s, lambda df: sinks.write_signals(df, f"{tmp_path}/all"), lambda df: sinks.write_confirmed(df, f"{tmp_path}/yes"))
    assert spark.read.json(f"{tmp_path}/all").select("hour").distinct().count() == 2 and spark.read.json(f"{tmp_path}/yes").count() == 1
    m = sinks.write_backtest(f"{tmp_path}/run", s, s, s.limit(0), {"a": 1})
    assert (m["signals"], m["trades"], m["pnl_daily"]) == (2, 2, 0) and len(m["config_hash"]) == 12
    assert "| A | 1 |" in sinks.write_report(f"{tmp_path}/rep", {"s": s.select("symbol", "ts_ms")})
    assert sinks.logged(ticks(spark), F.col("side") == "buy", F.col("seq").cast("string"), 0.0).count() == 5
    sinks.write_trace(s, s.select("symbol", "ts_ms", F.lit("why").alias("reason")), f"{tmp_path}/trace")
    assert spark.read.option("header", True).csv(f"{tmp_path}/trace").count() == 2


def streamed(spark, rows, path, name, make, mode="append"):
    for part in range(3):  # three micro-batches, in order of time
        rows.where(F.expr(f"seq div 5 = {part}") if part < 2 else F.expr("seq div 5 > 1")).coalesce(1).write.mode("append").parquet(str(path))
    q = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}-state").start()
    q.processAllAvailable()
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 3
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def test_streams_equal_batches(spark, tmp_path):
    from ticklattice.operators import indicators

    t = ticks(spark).where("symbol = 'A'")
    assert streamed(spark, t, tmp_path / "a", "rates", lambda s: streaming.sliding_rates(s, "5 seconds", "1 second"), "complete") == sorted(map(tuple, streaming.sliding_rates(t, "5 seconds", "1 second").collect()))
    spells = streamed(spark, t, tmp_path / "b", "spells", lambda s: streaming.sessions(s), "complete")
    assert spells == sorted(map(tuple, streaming.sessions(t).collect())) and len(spells) == 1
    got = streamed(spark, t, tmp_path / "c", "volume", streaming.running_volume)
    assert got == sorted(map(tuple, indicators.signed_volume(t).select("symbol", "seq", "ts_ms", "cvd").collect()))
    kept = streamed(spark, t, tmp_path / "d", "kept", lambda s: streaming.fresh(s, 2000, ["symbol"]))
    assert kept == sorted(map(tuple, indicators.throttled(t, 2000, "symbol").collect()))
    late = spark.createDataFrame([(5, 3), (5, 9)], "ts_ms long, recv_ts_ms long")
    assert sorted(r.latency_ms for r in streaming.latencies(late).collect()) == [0, 4]
