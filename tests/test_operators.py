"""Operators on small rows: ties, nulls, gaps of exactly the limit, empty tables."""

from pyspark.sql import functions as F

from ticklattice.functions import consistency, nearest_rank, regime, spread_bps
from ticklattice.operators import alignment, decisions, indicators, ledger
from ticklattice import sources, streaming


def test_as_of_takes_the_latest_row_within_the_tolerance(spark):
    left = spark.createDataFrame([("A", 1000), ("A", 3000), ("A", 3001), ("B", 5)], "symbol string, ts_ms long")
    right = spark.createDataFrame([("A", 1000, 1.5), ("B", 6, 9.0)], "symbol string, ts_ms long, bid double")
    got = {(r.symbol, r.ts_ms): (r.q_ts, r.q_bid) for r in alignment.as_of(left, right, ["bid"], 2000, "q_").collect()}
    assert got == {("A", 1000): (1000, 1.5), ("A", 3000): (1000, 1.5), ("A", 3001): (None, None), ("B", 5): (None, None)}


def test_nearest_takes_the_earlier_row_of_a_tie(spark):
    left = spark.createDataFrame([("A", 10, 1)], "symbol string, ts_ms long, seq long")
    right = spark.createDataFrame([("A", 8, 1, 1.0), ("A", 12, 2, 2.0)], "symbol string, ts_ms long, seq long, v double")
    assert alignment.nearest(left, right, "v").first().v == 1.0


def test_empty_tables_give_no_rows(spark):
    book = spark.createDataFrame([], "symbol string, ts_ms long, seq long, bid1_q double, ask1_q double, bid2_q double, ask2_q double")
    assert indicators.order_flow(book).count() == 0
    fills = spark.createDataFrame([], "fill_id string, symbol string, ts_ms long, side string, px double, qty double, fee_bps double, slippage_bps double")
    legs = ledger.fifo_lots(ledger.costs(fills))
    assert legs.count() == 0 and ledger.performance(ledger.daily_legs(legs)).count() == 0


def test_sessions_end_after_more_than_two_seconds_and_with_the_day(spark):
    day = 86_400_000
    rows = [("A", day - 1000, 1), ("A", day - 1, 2), ("A", day, 3), ("A", day + 2000, 4), ("A", day + 4001, 5)]
    book = spark.createDataFrame([(*r, 1.0, 1.0, 1.0, 1.0) for r in rows], "symbol string, ts_ms long, seq long, bid1_q double, ask1_q double, bid2_q double, ask2_q double")
    assert [r.session_id for r in indicators.order_flow(book).orderBy("seq").collect()] == [1, 1, 2, 2, 3]


def test_missing_side_follows_the_tick_and_empty_quantities_go(spark):
    rows = [("A", 1, 1, 10.0, 2.0, None), ("A", 2, 2, 11.0, 3.0, None), ("A", 3, 3, 9.0, 1.0, None), ("A", 4, 4, 9.0, 0.0, "buy")]
    t = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, price double, qty double, side string")
    assert [(r.side, r.cvd) for r in indicators.signed_volume(t).orderBy("seq").collect()] == [("sell", -2.0), ("buy", 1.0), ("sell", 0.0)]


FILLS = "fill_id string, symbol string, ts_ms long, side string, px double, qty double, fee double"


def test_fifo_matches_unit_by_unit(spark):
    rows = [("a", "P", 1, "buy", 10.0, 5.0, 1.0), ("b", "P", 2, "buy", 11.0, 5.0, 0.0), ("c", "P", 3, "sell", 12.0, 7.0, 0.7), ("d", "P", 4, "sell", 9.0, 1.0, 0.0), ("e", "P", 5, "buy", 9.0, 0.0, 0.0), ("f", "P", 6, None, 9.0, 1.0, 0.0)]
    legs = ledger.fifo_lots(spark.createDataFrame(rows, FILLS)).orderBy("close_ms", "open_ms").select("q", "pnl", F.round("fee", 9), "open_ms", "close_ms", "way").collect()
    assert [tuple(x) for x in legs] == [(5, 10.0, 1.5, 1, 3, "long"), (2, 2.0, 0.2, 2, 3, "long"), (1, -2.0, 0.0, 2, 4, "long")]


def test_fifo_of_fractions_over_months_and_chunks(spark):
    import random

    rng = random.Random(3)
    rows = [(f"{i:04}", "P", i * 40_000_000, rng.choice(["buy", "sell"]), 100 + rng.random(), rng.choice([0.5, 0.25, 1.75, 3.0]), 0.1) for i in range(400)]
    queue = {"buy": [], "sell": []}
    want = []
    for _, _, t, side, px, qty, _ in rows:
        other = queue["sell" if side == "buy" else "buy"]
        while qty and other:
            q = min(qty, other[0][1])
            buy, sell = (px, other[0][0]) if side == "buy" else (other[0][0], px)
            want.append((q, round((sell - buy) * q, 9), other[0][2], t))
            qty -= q
            other[0][1] -= q
            if not other[0][1]:
                other.pop(0)
        if qty:
            queue[side].append([px, qty, t])
    for chunk in (ledger.CHUNK, 3 * ledger.UNIT):
        got = ledger.fifo_lots(spark.createDataFrame(rows, FILLS), chunk).select("q", F.round("pnl", 9), "open_ms", "close_ms").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_windows_in_small_chunks_equal_plain_windows(spark):
    import random

    from pyspark.sql import Window

    from ticklattice.operators import chunks

    rng = random.Random(4)
    rows = [(rng.choice("AB"), t, i, rng.random()) for i, t in enumerate(sorted(rng.randrange(200_000) for _ in range(300)))]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, v double")
    plain = Window.partitionBy("symbol").orderBy("ts_ms", "seq")
    want = df.select("seq", F.lag("v").over(plain).alias("a"), F.round(F.sum("v").over(plain), 9).alias("b"), F.count("*").over(Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(-5000, 0)).alias("c"), F.round(F.avg("v").over(plain.rowsBetween(-4, 3)), 9).alias("d"))
    got = chunks.with_previous(df, ["v"], width=1000).select("*", F.col("_prev.v").alias("a")).drop("_prev")
    got = chunks.over_range(chunks.running(got, {"b": F.col("v")}, width=7000), 5000, {"c": lambda w: F.count("*").over(w)}, width=3000)
    got = chunks.over_rows(got, 4, 3, {"d": lambda w: F.avg("v").over(w.rowsBetween(-4, 3))}, block=10)
    assert sorted(map(tuple, got.select("seq", "a", F.round("b", 9), "c", F.round("d", 9)).collect())) == sorted(map(tuple, want.collect()))
    near = alignment.nearest(df, df.select("symbol", (F.col("ts_ms") + 7).alias("ts_ms"), "seq", "v").dropDuplicates(["symbol", "ts_ms"]), "v")
    assert near.count() == 300


def test_denoised_signals_wait_and_turn_at_once(spark):
    from ticklattice.operators import states

    rows = [("A", i * 1000, i, s, c) for i, (s, c) in enumerate([(1.2, 0.5), (1.2, 0.5), (1.2, 0.5), (0.7, 0.5), (-1.5, 0.9), (-1.5, 0.2), (1.1, 0.5), (1.1, 0.5), (None, 0.5)])]
    t = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, fusion double, consistency double")
    assert [r.signal for r in states.denoised(t).orderBy("seq").collect()] == [0, 1, 0, 0, -1, 0, 0, 1, 0]


def test_fee_and_slippage_models(spark):
    r = spark.range(1).select(*(ledger.slippage_bps(m, 1.0, F.lit(4.0), F.lit(10.0), F.lit("A_H")).alias(m) for m in ("static", "linear", "piecewise")), *(ledger.fee_bps(m, F.lit(25_000.0), F.lit(0.5)).alias("f" + m) for m in ("taker_static", "tiered", "maker_taker"))).first()
    assert tuple(r) == (1.0, 5.0, 2.0, 5.0, 4.0, 3.5)


def test_reasons_keep_their_order_and_leave_out_nulls(spark):
    row = spark.range(1).select(decisions.reasons((F.lit(True), "x"), (F.lit(None).cast("boolean"), "y"), (F.lit(True), "a")).alias("r")).first()
    assert row.r == ["x", "a"]


def test_column_functions(spark):
    r = spark.range(1).select(
        consistency(F.lit(2.0), F.lit(1.0)).alias("a"), consistency(F.lit(2.0), F.lit(-1.0)).alias("b"), spread_bps(F.lit(0.0), F.lit(0.0)).alias("c"),
        regime(F.lit(None).cast("double")).alias("d"), nearest_rank(F.array(*map(F.lit, [3, 1, 2])), 0.5).alias("e"),
    ).first()
    assert tuple(r) == (0.5, 0.0, 0.0, "normal", 2)


def test_pareto_keeps_ties(spark):
    t = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 1.0), (3, 4.0, 2.0), (4, 6.0, 9.0)], "k long, up double, down double")
    assert sorted(r.k for r in ledger.pareto(t, ["up"], ["down"], "k").collect()) == [1, 2, 4]


def test_sources_first_in_priority_win_and_bad_lines_go(spark, tmp_path):
    a, b = (spark.createDataFrame([(1, x), *more], "k long, v string") for x, more in (("a", []), ("b", [(2, "b")])))
    assert sorted(map(tuple, sources.with_priority([a, b], ["k"]).collect())) == [(1, "a"), (2, "b")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s.jsonl").write_text('{"ts_ms": 1}\n\nnot json\n{"ts_ms": 2}\n')
    assert sorted(r.ts_ms for r in sources.read_json_lines(spark, str(tmp_path), "ts_ms long").collect()) == [1, 2]


def test_streamed_bars_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1000, 1.0, 2.0), ("A", 1500, 1.5, 3.0), ("B", 2500, 4.0, 1.0)], "symbol string, ts_ms long, price double, qty double")
    rows.write.parquet(str(tmp_path / "in"))
    q = streaming.second_bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, streaming.second_bars(rows).collect())) == [(1, "A", 2, 5.0, 1.5), (2, "B", 1, 1.0, 4.0)]
