"""Steps whose cost must not grow with the rows of a frame: what the plan may not hold, and results against plain loops."""

import random

from pyspark.sql import functions as F

from ticklattice.operators import alignment, indicators, ledger, matching, states


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def times(n, to, seed, symbols="AB"):
    rng = random.Random(seed)
    return [(i, rng.choice([*symbols, None]), rng.choice([None, *(rng.randrange(to) for _ in range(20))])) for i in range(n)]


def test_nearest_looks_back_along_both_ways(spark):
    left = times(300, 9_000_000, 1)
    right = sorted({(s, t) for _, s, t in times(200, 9_000_000, 2) if t is not None}, key=str)
    found = alignment.nearest(spark.createDataFrame(left, "seq long, symbol string, ts_ms long"), spark.createDataFrame([(s, t, float(t)) for s, t in right], "symbol string, ts_ms long, v double"), "v")
    assert "unboundedfollowing" not in plan_of(found)  # a pass over all rows that follow, at each row
    want = {i: min((abs(t - u), u) for s2, u in right if s2 == s)[1] if t is not None else None for i, s, t in left}
    assert {r.seq: r.v for r in found.collect()} == want


def test_as_of_within_a_tolerance_takes_the_last_row_so_far(spark):
    left = times(300, 30_000_000, 3)
    right = sorted({(s, t) for _, s, t in times(200, 30_000_000, 4) if t is not None}, key=str)
    a, b = spark.createDataFrame(left, "seq long, symbol string, ts_ms long"), spark.createDataFrame(right, "symbol string, ts_ms long")
    for most in (50_000, 8_000_000):  # shorter and longer than a chunk
        found = alignment.as_of(a, b, [], most, "q_")
        assert "rangeframe" not in plan_of(found)  # a pass over all rows of the frame, at each row
        want = {i: max((u for s2, u in right if t is not None and s2 == s and t - most <= u <= t), default=None) for i, s, t in left}
        assert {r.seq: r.q_ts for r in found.collect()} == want


def test_links_use_no_moving_frame(spark):
    s = spark.createDataFrame([(1, "A", 5, True, "x")], "seq long, symbol string, ts_ms long, confirm boolean, reason string")
    found = matching.linked(s.select("symbol", "ts_ms", F.lit("k").alias("kind")), s, 1000)
    assert "rangeframe" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("k", True, 1, 1, 1.0)]


def test_rates_count_by_rows_that_enter_and_leave(spark):
    rows = [(i, s, t, i % 3 == 0) for i, s, t in times(600, 2_000_000, 5)]
    rows += [(600 + i, "A", 1_000_000, True) for i in range(20)] + [(700 + i, "A", 1_060_000 + i % 2, False) for i in range(6)]
    e = spark.createDataFrame(rows, "seq long, symbol string, ts_ms long, trade boolean")
    for span in (60_000, 3_000_000):  # shorter and longer than a chunk
        found = indicators.activity_rates(e, F.col("trade"), ~F.col("trade"), span)
        assert "rangeframe" not in plan_of(found)
        got = {r.seq: (r.trade_rate, r.quote_rate) for r in found.collect()}
        assert len(got) == len(rows)
        for i, s, t, _ in rows:
            last = [x for j, s2, u, x in rows if t is not None and u is not None and s2 == s and t - span <= u and (u, j) <= (t, i)]
            assert got[i] == ((None, None) if t is None else (float(sum(last)), (len(last) - sum(last)) / (span / 1000)))


def test_market_active_keeps_a_sorted_window(spark):
    rng = random.Random(6)
    rows = [(i, s, t, rng.choice([None, 1.0, 2.0, 50.0, float(rng.randrange(9))])) for i, s, t in times(500, 3_000_000, 7)]
    rows += [(500 + i, "A", 3_599_000 + (i // 40) * 500, float(i * i % 97)) for i in range(200)]  # over the edge of a chunk, 40 at a time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # rows of one time in several batches
    try:
        found = states.market_active(spark.createDataFrame(rows, "seq long, symbol string, ts_ms long, qty double"))
        assert "collect_list" not in plan_of(found)  # a list of the minute at each row
        got = {r.seq: r.active for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for i, s, t, _ in rows:
        v = sorted(q for _, s2, u, q in rows if q is not None and s2 == s and (u is None if t is None else u is not None and t - 60_000 <= u <= t))
        lo, hi = (v[int((len(v) - 1) * p)] for p in (0.1, 0.9)) if v else (0, 0)
        w = [min(hi, max(lo, x)) for x in v]
        assert bool(got[i]) == (len(w) >= 3 and w[(len(w) - 1) // 2] >= 0.5 * sum(w) / len(w))


def test_lots_send_fills_through_two_shuffles(spark):
    rows = [(f"{i:03}", "P", i, "buy" if i % 2 else "sell", 10.0 + i, float(10 ** (i % 7)), 0.1) for i in range(60)] + [("big", "P", 99, "sell", 9.0, 1e12, 0.0), ("end", "P", 100, "buy", 8.0, 3e11, 0.0)]
    fills = spark.createDataFrame(rows, "fill_id string, symbol string, ts_ms long, side string, px double, qty double, fee double").repartition(3)
    one, many = (ledger.fifo_lots(fills, c).select("buy_id", "sell_id", "q") for c in (10**18, ledger.UNIT))
    assert "sortaggregate" not in plan_of(one)
    # many: a fill of 10^12 reaches into chunks of a MOST-th of all, not of one unit
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


def test_both_z_share_their_pivots(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("AB"), i * 1000, 100 + rng.random(), rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(300)]
    r = spark.createDataFrame(rows, "seq long, symbol string, ts_ms long, price double, z_ofi double, z_cvd double")
    pairs = indicators.pivot_pairs(r, "price", ["z_ofi", "z_cvd"], 3, 6)
    for k, c in enumerate(("z_ofi", "z_cvd")):
        kind, score = indicators.disagreement(k, 3)
        got = pairs.select("seq", "kind", kind.alias("d"), score.alias("s")).where("d is not null").collect()
        assert got and sorted(map(tuple, got)) == sorted(map(tuple, indicators.divergences(r, "price", c, 3, 6).select("seq", "kind", "divergence", "score").collect()))
