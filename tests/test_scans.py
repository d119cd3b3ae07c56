"""Scans, sliding windows, settings and flow events against plain loops; one symbol over many chunks, nulls, ties."""

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklattice.functions import rules
from ticklattice.operators import alignment, chunks, decisions, indicators, matching, scans, settings, sliding, states

ROWS = "symbol string, ts_ms long, seq long, v double, g double"


def walk(n=600, seed=1, symbols=("A", "B", None)):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 0, 1, 40, 900, 5000, 400_000])
        rows.append((rng.choice(symbols), at, i, rng.choice([None, rng.uniform(-5, 5), rng.uniform(-5, 5)]), float(i // 97)))
    return rows


def by_symbol(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.fixture(params=[7, 100_000])
def small_chunks(request, monkeypatch):
    """Rows a chunk and a stretch: one symbol over many chunks, and all in one."""
    monkeypatch.setattr(scans, "CHUNK_ROWS", request.param)
    monkeypatch.setattr(scans, "STRETCH", max(3, request.param // 2))
    monkeypatch.setattr(scans.scan, "__defaults__", (request.param,))
    return request.param


def test_ema_with_resets(spark, small_chunks):
    rows = walk()
    got = {r.seq: r.ema for r in indicators.ema(spark.createDataFrame(rows, ROWS), "v", 0.3, "g").collect()}
    assert len(got) == len(rows)
    for own in by_symbol(rows).values():
        mean = reset = None
        for _, _, i, v, g in own:
            if v is not None:
                mean = v if mean is None or g != reset else 0.3 * v + 0.7 * mean
                reset = g
            assert close(got[i], mean), i


def test_decayed_means(spark, small_chunks):
    rows = walk(seed=2) + [("A", None, 10_000, 3.0, 0.0)]
    got = {r.seq: (r.decayed_1s, r.decayed_60s) for r in indicators.decayed_means(spark.createDataFrame(rows, ROWS), "v", (1000, 60_000)).collect()}
    assert len(got) == len(rows)
    for own in by_symbol(rows).values():
        means, at = None, None
        for _, t, i, v, _ in own:
            if v is not None and t is not None:
                x = abs(v)
                means = [x, x] if means is None else [m + (1 - 2 ** (-max(1, t - at) / h)) * (x - m) for m, h in zip(means, (1000, 60_000), strict=True)]
                at = t
            for a, b in zip(got[i], means or (None, None), strict=True):
                assert close(a, b), i


@pytest.mark.parametrize("gap", [0, 1, 50, 6000, 10_000_000])
def test_throttle_and_cooldown(spark, small_chunks, gap):
    rows = walk(seed=3)
    df = spark.createDataFrame(rows + [("A", None, -1, 1.0, 0.0)], ROWS)
    kept = {r.seq for r in indicators.throttled(df, gap, "symbol").collect()}
    codes = {r.seq: r.code for r in scans.scan(df.withColumn("free", (F.col("seq") % 3 == 0).cast("double")), ["symbol"], ["ts_ms", "seq"], ["ts_ms", "free"], scans.Cooldown(gap), "code long", *scans.scan.__defaults__).collect()}
    for own in by_symbol(rows).values():
        last = anchor = None
        for _, t, i, _, _ in own:
            assert (i in kept) == (last is None or t - last >= gap), i
            last = t if i in kept else last
            waits = anchor is not None and t - anchor < gap
            want = 2 if i % 3 == 0 and not waits else int(waits)
            anchor = t if want == 2 else anchor
            assert codes[i] == want, (i, gap)
    assert codes[-1] == 0 and -1 not in kept


def test_bounded_steps_compose(spark, small_chunks):
    rng = random.Random(5)
    rows = [(rng.choice(["A", "B"]), i * 10, i, rng.choice([0.5, 0.8, 1.0, 1.1, 1.2]), rng.choice([-2.0, 0.0, 3.0]), rng.choice([-1e300, 1.0]), rng.choice([1e300, 20.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, a double, b double, lo double, hi double")
    got = {r.seq: r.level for r in scans.scan(df, ["symbol"], ["ts_ms", "seq"], ["a", "b", "lo", "hi"], scans.Bounded(10.0), "level double", *scans.scan.__defaults__).collect()}
    for s in "AB":
        level = 10.0
        for r in (r for r in rows if r[0] == s):
            assert close(got[r[2]], level)
            level = min(r[6], max(r[5], r[3] * level + r[4]))


def delta_loop(own, freeze_min=20, window=200):
    """z of one symbol's trades, (ts, price, qty, side), written from the rule."""
    out, deltas, times, state = [], [], [], {"price": None, "at": None, "fast": 0.0, "slow": 0.0, "left": 0, "n": 0}
    for t, price, qty, side in own:
        side = side or ("buy" if state["price"] is not None and price >= state["price"] else "sell")
        delta, gap = qty if side == "buy" else -qty, None if state["at"] is None else t - state["at"]
        if gap is None:
            state["fast"] = state["slow"] = qty
        else:
            for name, half in (("fast", 60_000), ("slow", 600_000)):
                state[name] += (1 - 2 ** (-max(1, gap) / half)) * (qty - state[name])
        state.update(price=price, at=t, n=state["n"] + 1)
        deltas, times = (deltas + [delta])[-window:], [x for x in times if t - x <= 60_000] + [t]
        z = None
        if state["n"] >= freeze_min:
            tps = len(times) / max(60, (t - times[0]) / 1000) if len(times) > 1 else 0.0
            w = 0.3 * min(1, tps / 1.5)
            m = median(deltas)
            sigma = median(abs(x - m) for x in deltas) * 1.4826 * 1.7 if len(deltas) >= 50 else 0.0
            scale = max(w * state["fast"] + (1 - w) * state["slow"], sigma * max(1, (1.5 / max(tps, 0.2)) ** 0.7), 1e-9)
            if gap is not None and gap > 5000:
                state["left"] = 2
            elif gap is not None and gap > 4000:
                state["left"] = 1
            elif state["left"]:
                state["left"] -= 1
            else:
                z = max(-2.0, min(2.0, delta / scale))
        out.append(z)
    return out


def test_delta_z_equals_a_loop(spark, small_chunks):
    rng, rows, at = random.Random(8), [], 0
    for i in range(900):
        at += rng.choice([0, 3, 200, 700, 1500, 4500, 9000] if rng.random() < 0.3 else [5, 50, 300])
        rows.append((rng.choice(["X", "Y"]), at, i, 100 + rng.choice([0, 0, 1, -1]) * 0.5, rng.choice([1.0, 2.0, 7.5]), rng.choice([None, "buy", "sell"])))
    df = spark.createDataFrame(rows + [("X", 5, 10_001, None, 1.0, "buy"), ("X", 5, 10_002, 1.0, 0.0, "buy")], "symbol string, ts_ms long, seq long, price double, qty double, side string")
    got = {r.seq: r.z_cvd for r in indicators.cvd_delta_z(df).collect()}
    assert len(got) == 900
    for s in "XY":
        own = [r for r in rows if r[0] == s]
        for r, z in zip(own, delta_loop([(r[1], r[3], r[4], r[5]) for r in own]), strict=True):
            assert close(got[r[2]], z), (r, got[r[2]], z)
    free = {r.seq: r.z_cvd for r in indicators.cvd_delta_z(df, frozen_rows=False).collect()}  # the estimate between updates
    assert all(z is None or close(free[i], z) for i, z in got.items()) and sum(z is None for z in free.values()) == 38


def test_tick_rule_by_hand(spark):
    rows = [(0, 1.0, None), (100, 1.0, "sell"), (200, 1.0, None), (300, None, None), (400, 2.0, None)] + [(500 + i, 2.0, None) for i in range(8)] + [(3000, 2.0, None), (3100, 1.0, None), (3200, 1.0, None), (6000, 1.0, None), (6001, 1.0, None)]
    df = spark.createDataFrame([("A", t, i, p, s) for i, (t, p, s) in enumerate(rows)], "symbol string, ts_ms long, seq long, price double, side string")
    got = [r.tick_side for r in indicators.tick_rule(df).orderBy("seq").collect()]
    # after five equal prices the sixth gets none and the count begins again; at 3000 and 6000 the trade with a side before is too old
    assert got == [None, "sell", "sell", None, "buy", *["buy"] * 5, None, "buy", "buy", None, "sell", "sell", None, None]


def test_sorted_windows(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 10, 51):
        s = sorted(rng.choice([rng.uniform(-3, 3), 1.0, 2.0]) for _ in range(n))
        m = median(s)
        assert close(sliding.mad(s), median(abs(x - m) for x in s)) and close(sliding.quantile(s, 0.3), float(np.percentile(s, 30)))
    rows = walk(500, seed=6)
    got = {r.seq: (r.n, r.m, r.d, r.q) for r in sliding.sliding(spark.createDataFrame(rows, ROWS), "v", {"n": "count", "m": "middle", "d": "deviation", "q": (0.9,)}, last=20, span_ms=3000, block=16).collect()}
    spans = {r.seq: r.n for r in sliding.sliding(spark.createDataFrame(rows, ROWS), "v", {"n": "count"}, span_ms=900_000).collect()}
    assert len(got) == len(spans) == len(rows)
    for own in by_symbol(rows).values():
        for k, (_, t, i, _, _) in enumerate(own):
            last = [(r[1], r[3]) for r in own[: k + 1] if r[3] is not None]
            w = [v for at, v in last[-20:] if t - at <= 3000]
            n, m, d, q = got[i]
            assert (n or 0) == len(w) and (spans[i] or 0) == sum(t - at <= 900_000 for at, _ in last)
            if w:
                assert close(m, median(w)) and abs(d - float(np.std(w))) < 1e-7 and close(q, float(np.percentile(w, 90)))


def test_divergence_score_by_hand(spark):
    one = spark.range(1).select(indicators.divergence_score(F.lit(100.0), F.lit(99.0), F.lit(-0.9), F.lit(-0.4), F.lit(6), 12, F.lit(0.65)).alias("s")).first().s
    moves = (0.01 + 0.5) / 2
    assert close(one, 100 * (0.35 * 0.7 + 0.25 * (6 / 24 + moves) / 2 + 0.25 + 0.15 * (0.05 + 0.35 / 0.7 * 0.10)))


def test_reason_and_error_names(spark):
    reasons = {"reason:low_consistency_throttle": "low_consistency", "reason:abc": "reason_abc", "reverse_cooldown_5": "reverse_cooldown", "spread_bps>8.0": "spread_bps_exceeded", "lag_sec>1": "lag_sec_exceeded", "": "unknown", None: "unknown", "reason:warmup": "component_warmup", "warmup": "warmup", "Other": "Other"}
    df = spark.createDataFrame([(k,) for k in reasons], "r string")
    assert {r.r: r.n for r in df.select("r", rules.gate_reason(F.col("r")).alias("n")).collect()} == reasons
    both = spark.createDataFrame([("a, reason:lag_exceeded ,",), (" , ",)], "r string").select(rules.gate_reasons(F.col("r")).alias("n")).collect()
    assert [r.n for r in both] == [["a", "lag_sec_exceeded"], ["unknown"]]
    errors = [("Order 12500 rejected: price too low", None, None, "E_UNKNOWN"), ("symbol 4041 not found", None, None, "E_PARAMS"), ("timeout", 404, None, "E_PARAMS"), ("timeout", 999, -2010, "E_BROKER_REJECT"), ("Timed Out", 999, -1, "E_NETWORK"), (None, None, None, "E_UNKNOWN")]
    got = spark.createDataFrame(errors, "t string, s int, v int, want string").select(rules.error_code(F.col("t"), F.col("s"), F.col("v")).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)


# chunks with nulls


def test_rows_without_symbol_or_time_stay(spark):
    rows = [("A", 1, 1, 1.0), (None, 2, 2, 2.0), (None, 3_700_000, 3, 3.0), ("A", None, 4, 4.0), (None, None, 5, 5.0), ("A", 7_300_000, 6, 6.0)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, qty double").withColumn("price", F.col("qty")).withColumn("side", F.lit("buy"))
    got = {r.seq: r.cvd for r in indicators.signed_volume(df).collect()}
    assert got == {4: 4.0, 1: 5.0, 6: 11.0, 5: 5.0, 2: 7.0, 3: 10.0}
    assert {r.seq: r.known for r in chunks.last_known(df, {"known": F.when(F.col("seq").isin(1, 2), F.col("qty"))}).collect()} == {4: None, 1: 1.0, 6: 1.0, 5: None, 2: 2.0, 3: 2.0}
    right = spark.createDataFrame([("A", 0, 9.0), (None, 3_000_000, 8.0), ("A", None, 7.0)], "symbol string, ts_ms long, x double")
    for tolerance in (None, 4_000_000):
        out = {r.seq: r.x for r in alignment.as_of(df, right, ["x"], tolerance).collect()}
        assert out == {1: 9.0, 2: None, 3: 8.0, 4: None, 5: None, 6: 9.0 if tolerance is None else None}


def test_links_without_events(spark):
    s = spark.createDataFrame([("A", 5, 1, True)], "symbol string, ts_ms long, seq long, confirm boolean")
    assert matching.linked(spark.createDataFrame([], "symbol string, ts_ms long, kind string"), s, 10).collect() == []
    e = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y"), ("B", 5, "y")], "symbol string, ts_ms long, kind string")
    assert sorted((r.kind, r.inside, r.signals, r.confirmed) for r in matching.linked(e, s, 10).collect()) == [("x", True, 1, 1), ("y", True, 1, 1)]


# settings


def test_settings_switch_on_the_way(spark):
    log = spark.createDataFrame([(100, 3.0, 1.0, None), (200, None, None, 0.2), (300, 0.0, 0.0, None), (None, 9.0, 9.0, 9.0)], "from_ms long, w_ofi double, w_cvd double, fuse_buy double")
    rows = spark.createDataFrame([("A", t, t, 1.0, 0.5, "normal") for t in (50, 100, 199, 200, 299, 300)] + [("A", None, 1, 1.0, 0.5, "normal")], "symbol string, ts_ms long, seq long, z_ofi double, z_cvd double, regime string")
    for small in (0, 100):  # by chunks of time, and as a broadcast log
        got = {r.ts_ms: r for r in settings.fused_in_force(rows, log, warm_up=0, small=small).collect()}
        assert [round(got[t].fusion, 9) for t in (50, 100, 199, 200, 299, 300)] == [0.8, 0.875, 0.875, 0.875, 0.875, 0.875]  # weights of 0 change nothing
        assert [got[t].fusion_label for t in (50, 100, 199, 200, 299, 300)] == ["neutral", "neutral", "neutral", "buy", "buy", "buy"] and got[None].from_ms is None


def test_regimes_set_consistency_until_the_next(spark):
    rows = spark.createDataFrame([("A", t, t, r, f, 0.1, 0.2) for t, r, f in ((1, "normal", None), (2, "quiet", None), (3, "normal", None), (5, "normal", 4), (6, "quiet", 4), (None, "quiet", None))], "symbol string, ts_ms long, seq long, regime string, from_ms long, min_consistency double, strong_min_consistency double")
    got = {r.ts_ms: (r.min_consistency, r.strong_min_consistency) for r in settings.regime_consistency(rows, {"quiet": (0.3, 0.6)}).where("ts_ms is not null").collect()}
    assert got == {1: (0.1, 0.2), 2: (0.3, 0.6), 3: (0.3, 0.6), 5: (0.1, 0.2), 6: (0.3, 0.6)}


def test_scenario_tables_fill_four_and_skip_empty_versions(spark):
    given = spark.createDataFrame([(10, "a_h", 1.0, None, None, 5.0, None), (10, "junk", 7.0, 7.0, 7.0, 7.0, 7.0), (20, "junk", 7.0, 7.0, 7.0, 7.0, 7.0)], "from_ms long, scenario string, z_hi_long double, z_hi_short double, z_mid double, tp_bps double, sl_bps double")
    full = {(r.from_ms, r.scenario): tuple(r)[2:] for r in settings.filled_scenarios(given).collect()}
    assert full == {(10, "A_H"): (1.0, 2.5, 0.5, 5.0, 9.0)} | {(10, s): (2.5, 2.5, 0.5, 12.0, 9.0) for s in ("A_L", "Q_H", "Q_L")}
    rows = spark.createDataFrame([("A", t, s) for t, s in ((5, "A_H"), (15, "A_H"), (25, "A_H"), (25, "Q_L"), (25, "x"))], "symbol string, ts_ms long, scenario string")
    for small in (0, 100):
        got = sorted((r.ts_ms, r.scenario, r.z_hi, r.tp_bps, r.from_ms) for r in settings.scenario_parameters(rows, given, F.lit("long"), small).collect())
        assert got == [(5, "A_H", 2.5, 12.0, None), (15, "A_H", 1.0, 5.0, 10), (25, "A_H", 1.0, 5.0, 10), (25, "Q_L", 2.5, 12.0, 10), (25, "x", 2.5, 12.0, None)]


def test_adaptive_limit_by_hand(spark):
    rows = [("A", 0, 1, 4, "normal"), ("A", 10, 2, 4, "quiet"), ("A", 20, 3, None, "active"), ("A", 30, 4, 0, "normal"), ("A", 100_000, 5, 1, "normal")]
    got = decisions.adaptive_limit(spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, denied int, regime string"), 10.0, 3.5, 5.0).orderBy("seq").collect()
    assert [round(r.limit, 9) for r in got] == [8.0, 3.5, 4.2, 4.2, 3.5] and not any(r.throttled for r in got)


def test_latch_counts_runs(spark):
    acts = [True, True, None, True, True, True, False, True, False, False, True]
    df = spark.createDataFrame([("A", i * 4_000_000, i, a) for i, a in enumerate(acts)], "symbol string, ts_ms long, seq long, a boolean")
    got = [r.mode for r in states.latched(df, F.col("a"), 3, 2).orderBy("seq").collect()]
    assert got == ["QUIET"] * 5 + ["ACTIVE"] * 4 + ["QUIET"] * 2


def test_nearest_rows_on_both_sides(spark):
    left = spark.createDataFrame([("A", t, i) for i, t in enumerate((0, 10, 14, 15, 16, 7_200_000, 20_000_000, None))] + [(None, 12, 100), ("B", 5, 101)], "symbol string, ts_ms long, seq long")
    right = spark.createDataFrame([("A", 10, 1.0), ("A", 20, 2.0), ("A", 10_000_000, 3.0), (None, 40, 4.0), ("A", None, 9.0)], "symbol string, ts_ms long, v double")
    got = {r.seq: r.v for r in alignment.nearest(left, right, "v").collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 3.0, 6: 3.0, 7: None, 100: 4.0, 101: None}  # 15 is as far from 10 as from 20
