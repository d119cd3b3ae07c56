"""Recursive rules along a key's rows, cut into chunks that all tasks share.

A rule whose state depends on all rows before is a step from state to state. Steps that
compose can be scanned: each chunk's rows are summed up to one map of states, the maps
of a key are applied one after the other to its first state (a row a stretch of up to
STRETCH rows, not one a row), and every chunk then runs over its own rows from the
state that enters it. One key with all rows so uses all tasks. The rows are shuffled
twice: their few columns that the rule reads, to be summed up, and whole, to be run.

Chunks are spans of time of a key's own length, so that they have about CHUNK_ROWS rows
whatever the table's density; a burst makes a larger chunk, which is streamed. Rows
without a time come first, as one chunk.
"""

from __future__ import annotations

import json
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ARROW, ordered_fold

CHUNK_ROWS, STRETCH = 65_536, 65_536


class Rule(Protocol):
    """States and maps are what JSON can hold. Columns come as numpy arrays, missing numbers as NaN in float arrays."""

    first: object

    def summed(self, *columns: np.ndarray) -> object:
        """The map of these rows."""

    def after(self, state, found):
        """The state after rows with this map."""

    def run(self, state, *columns: np.ndarray) -> tuple[list, np.ndarray | None, object]:
        """The output columns of rows, which of them stay (None: all), and the state after them."""


class Decay:
    """Means of x that decay with time: a row weighs 1 - 2^(-dt / half), dt 1 ms at least; the first x is the first mean. A
    null x leaves the mean as it is and is no row for dt."""

    first = None

    def __init__(self, halves_ms: tuple[int, ...]):
        self.halves = halves_ms

    def _known(self, ts, x):
        ok = ~np.isnan(x) & ~np.isnan(ts)
        return ts[ok], x[ok], ok

    def summed(self, ts, x):
        t, v, _ = self._known(ts, x)
        if not len(t):
            return None
        # from a mean m at time s: m * 2^(-steps / half) + rest, where the first step begins at s
        out = []
        for h in self.halves:
            m, _ = self._means(0.0, t[0], t, v, h, skip=True)
            out.append(m)
        steps = float(np.maximum(1, np.diff(t)).sum())
        return [float(t[0]), float(t[-1]), float(v[0]), steps, out]

    def after(self, state, found):
        if found is None:
            return state
        t0, t1, x0, steps, rests = found
        if state is None:
            means = [x0 * 2 ** (-steps / h) + r for h, r in zip(self.halves, rests, strict=True)]
        else:
            at, old = state
            d = max(1, t0 - at)
            means = [(m * 2 ** (-d / h) + (1 - 2 ** (-d / h)) * x0) * 2 ** (-steps / h) + r for m, h, r in zip(old, self.halves, rests, strict=True)]
        return [t1, means]

    def _means(self, mean: float, at: float, t, x, half: float, skip: bool = False):
        """The last mean and all of them, from `mean` at time `at`; with skip the first row counts as already in it."""
        d = np.maximum(1.0, np.diff(t, prepend=at))
        if skip:
            d[0] = 0.0
        out, total, gain = np.empty(len(t)), np.cumsum(d) / half, 1 - 2 ** (-d / half)
        begin = 0
        while begin < len(t):  # 2^-s are the weights since `begin`; over stretches of 200 halvings none under- or overflows
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + 200)))
            s, g = total[begin:end] - total[begin], gain[begin:end].copy()
            lead = mean * 2 ** (-d[begin] / half) + g[0] * x[begin]
            g[0] = 0.0
            out[begin:end] = 2**-s * (lead + np.cumsum(g * x[begin:end] * 2**s))
            mean, begin = float(out[end - 1]), end
        return mean, out

    def run(self, state, ts, x):
        t, v, ok = self._known(ts, x)
        cols, means = [], []
        place = np.cumsum(ok) - 1  # the last known row at or before each
        for i, h in enumerate(self.halves):
            old = np.nan if state is None else state[1][i]
            if len(t):
                m, own = self._means(v[0] if state is None else old, t[0] if state is None else state[0], t, v, h, skip=state is None)
                cols.append(np.where(place >= 0, own[np.maximum(place, 0)], old))
                means.append(m)
            else:
                cols.append(np.full(len(ts), old))
        return cols, None, [float(t[-1]), means] if len(t) else state


class Ema:
    """alpha x + (1 - alpha) m; the first x, and the first after a change of `reset` (NaN counts as a value), is the mean. A null
    x leaves the mean as it is."""

    first = None

    def __init__(self, alpha: float):
        self.alpha = alpha

    def _runs(self, x, reset):
        """Known rows cut where reset changes: (begin, end) in them."""
        ok = np.flatnonzero(~np.isnan(x))
        r = reset[ok]
        cut = np.flatnonzero((r[1:] != r[:-1]) & ~(np.isnan(r[1:]) & np.isnan(r[:-1]))) + 1
        return ok, [0, *cut.tolist(), len(ok)]

    def _mean(self, start: float | None, x: np.ndarray) -> np.ndarray:
        out, a, m, begin = np.empty(len(x)), self.alpha, start, 0
        if m is None and len(x):
            m, out[0], begin = x[0], x[0], 1
        keep = 1 - a
        step = len(x) if keep <= 0 else max(1, int(-600 / np.log(keep))) if keep < 1 else len(x)
        while begin < len(x):
            v = x[begin : begin + step]
            w = keep ** np.arange(1, len(v) + 1) if keep > 0 else np.zeros(len(v))
            out[begin : begin + len(v)] = w * (m + np.cumsum(a * v / w)) if keep > 0 else v
            m, begin = out[begin + len(v) - 1], begin + len(v)
        return out

    def summed(self, x, reset):
        ok, cuts = self._runs(x, reset)
        if not len(ok):
            return None
        name = lambda i: None if np.isnan(reset[ok[i]]) else float(reset[ok[i]])
        a, b = cuts[-2], cuts[-1]
        own = float(self._mean(None, x[ok[a:b]])[-1])  # the last run by itself
        from_zero = float(self._mean(0.0, x[ok[a:b]])[-1])
        return {"begin": name(0), "end": name(-1), "one": len(cuts) == 2, "own": own, "rest": from_zero, "keep": (1 - self.alpha) ** (b - a)}

    def after(self, state, found):
        if found is None:
            return state
        goes_on = state is not None and found["one"] and state["reset"] == found["begin"]
        return {"reset": found["end"], "mean": state["mean"] * found["keep"] + found["rest"] if goes_on else found["own"]}

    def run(self, state, x, reset):
        ok, cuts = self._runs(x, reset)
        known, mean, name = np.empty(len(ok)), None if state is None else state["mean"], None if state is None else state["reset"]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own = None if np.isnan(reset[ok[a]]) else float(reset[ok[a]])
            known[a:b] = self._mean(mean if state is not None and a == 0 and own == name else None, x[ok[a:b]])
        place = np.cumsum(~np.isnan(x)) - 1
        col = np.where(place >= 0, known[np.maximum(place, 0)] if len(ok) else np.nan, np.nan if mean is None else mean)
        if len(ok):
            state = {"reset": None if np.isnan(reset[ok[-1]]) else float(reset[ok[-1]]), "mean": float(known[-1])}
        return [col], None, state


class Bounded:
    """A level that each row moves to a x + b between lo and hi. Such steps compose to one of the same form (a is 0 at least)."""

    def __init__(self, first: float):
        self.first = first

    @staticmethod
    def _then(f, g):
        """g after f; each (a, b, lo, hi)."""
        a, b, lo, hi = g
        at = lambda y: min(hi, max(lo, a * y + b))
        return (a * f[0], a * f[1] + b, at(f[2]), at(f[3]))

    def summed(self, a, b, lo, hi):
        f = (1.0, 0.0, -1e308, 1e308)
        for g in zip(a.tolist(), b.tolist(), lo.tolist(), hi.tolist(), strict=True):
            f = self._then(f, g)
        return list(f)

    def after(self, state, found):
        a, b, lo, hi = found
        return min(hi, max(lo, a * state + b))

    def run(self, state, a, b, lo, hi):
        before = np.empty(len(a))
        for i, (p, q, x, y) in enumerate(zip(a.tolist(), b.tolist(), lo.tolist(), hi.tolist(), strict=True)):
            before[i] = state
            state = min(y, max(x, p * state + q))
        return [before], None, state


class Cooldown:
    """The wait of `gap` after a row that is kept: of rows that are eligible (1) the first is kept, and the first that comes
    gap or more after the last one kept. Gives 2 for kept rows, 1 for others within the wait, 0 for the rest; with `only`
    kept rows alone stay. Rows without a time are 0.

    Each eligible row points to the next that could be kept after it; doubling the pointers gives each entry's last kept row,
    and a chunk's map from the anchor that enters it is a few steps, since chains from nearby entries soon meet."""

    first = None

    def __init__(self, gap: int, only: bool = False):
        self.gap, self.only = gap, only

    def _pointers(self, t):
        return np.searchsorted(t, t + self.gap, "left")

    def summed(self, ts, eligible):
        t = ts[(eligible > 0) & ~np.isnan(ts)]
        if not len(t):
            return None
        if self.gap <= 0:
            return [[float("inf")], [float(t[-1])], float(t[0])]
        to = self._pointers(t)
        end = np.where(to < len(t), np.minimum(to, len(t) - 1), np.arange(len(t)))
        while True:
            twice = end[end]
            if (twice == end).all():
                break
            end = twice
        entries = min(int(to[0]), len(t) - 1) + 1
        last = t[end[:entries]]
        edge = np.append(last[1:] != last[:-1], True)
        return [t[:entries][edge].tolist(), last[edge].tolist(), float(t[0])]

    def after(self, state, found):
        if found is None:
            return state
        steps, last, begin = found
        i = int(np.searchsorted(steps, begin if state is None else state + self.gap, "left"))
        return last[i] if i < len(steps) else state

    def run(self, state, ts, eligible):
        free = np.flatnonzero((eligible > 0) & ~np.isnan(ts))
        t, kept = ts[free], []
        if self.gap <= 0:
            kept = list(range(len(t)))
        else:
            to, i = self._pointers(t), 0 if state is None else int(np.searchsorted(t, state + self.gap, "left"))
            while i < len(t):
                kept.append(i)
                i = int(to[i])
        code = np.zeros(len(ts), np.int64)
        code[free[kept]] = 2
        # the anchor of a row is the last kept one before it in order
        mark = np.where(code == 2, ts, -np.inf)
        before = np.maximum.accumulate(np.concatenate([[-np.inf if state is None else state], mark[:-1]])) if len(ts) else mark
        code[(code == 0) & (ts - before < self.gap)] = 1
        return [code], code == 2 if self.only else None, float(t[kept[-1]]) if kept else state


class DeltaScale:
    """Signed quantity over a robust scale, trade by trade: what cvd_delta_z() needs from the trades before. The state holds the
    decayed means, the last `window` deltas, the times of the last minute and the last two gaps; a chunk's map holds the same of
    its own tail, so that it composes however long the chunk is.

    Columns: ts, price, qty, side (1, -1, NaN), limit and factor of the symbol."""

    first = None
    FAST, SLOW, SPAN = 60_000, 600_000, 60_000

    def __init__(self, fast_weight: float, freeze_min: int, window: int, soft_ms: int, hard_ms: int, busy_tps: float, freezes: bool):
        self.fast_weight, self.freeze_min, self.window, self.soft, self.hard, self.busy, self.freezes = fast_weight, freeze_min, window, soft_ms, hard_ms, busy_tps, freezes
        self.decay = Decay((self.FAST, self.SLOW))

    @staticmethod
    def _sides(price, side, before):
        was = np.concatenate([[np.nan if before is None else before], price[:-1]])
        return np.where(np.isnan(side), np.where(price >= was, 1.0, -1.0), side)

    def summed(self, ts, price, qty, side, limit, factor):
        n = len(ts)
        signs = self._sides(price, side, None)
        return {
            "n": n, "decay": self.decay.summed(ts, qty), "deltas": (qty * signs)[-self.window :].tolist(), "open": bool(np.isnan(side[0]) and n <= self.window), "price0": float(price[0]),
            "price": float(price[-1]), "times": ts[ts >= ts[-1] - self.SPAN].tolist(), "t0": float(ts[0]), "t1": float(ts[-1]), "gaps": np.diff(ts)[-2:].tolist(),
        }

    def after(self, state, found):
        s = state or {"n": 0, "decay": None, "deltas": [], "times": [], "price": None, "at": None, "gaps": []}
        deltas = list(found["deltas"])
        if found["open"]:
            deltas[0] = abs(deltas[0]) * (1 if s["price"] is not None and found["price0"] >= s["price"] else -1)
        gaps = ([] if s["at"] is None else [found["t0"] - s["at"]]) + found["gaps"]
        n = s["n"] + found["n"]
        counted = [g if n - len(gaps) + i + 1 >= self.freeze_min else 0.0 for i, g in enumerate(gaps)]
        times = [t for t in s["times"] if t >= found["t1"] - self.SPAN] + found["times"]
        return {"n": n, "decay": self.decay.after(s["decay"], found["decay"]), "deltas": (s["deltas"] + deltas)[-self.window :], "times": times, "price": found["price"], "at": found["t1"], "gaps": (s["gaps"] + counted)[-2:]}

    def run(self, state, ts, price, qty, side, limit, factor):
        from .sliding import Sorted, mad

        s = state or {"n": 0, "decay": None, "deltas": [], "times": [], "price": None, "at": None, "gaps": []}
        n = s["n"] + np.arange(1, len(ts) + 1)
        delta = qty * self._sides(price, side, s["price"])
        (fast, slow), _, _ = self.decay.run(s["decay"], ts, qty)
        old = np.array(s["times"], float)
        times = np.concatenate([old, ts])
        begin = np.searchsorted(times, ts - self.SPAN, "left")
        count = len(old) + np.arange(1, len(ts) + 1) - begin
        tps = np.where(count >= 2, count / np.maximum(60.0, (ts - times[begin]) / 1000), 0.0)
        window, sigma = Sorted(self.window, None), np.zeros(len(ts))
        for x in s["deltas"]:
            window.add(0.0, x)
        least = max(50, self.window // 5)
        for i, x in enumerate(delta.tolist()):
            window.add(0.0, x)
            if len(window.values) >= least:
                sigma[i] = mad(window.values) * 1.4826
        w = self.fast_weight * np.minimum(1.0, tps / 1.5)
        floor = sigma * factor * np.maximum(1.0, (1.5 / np.maximum(tps, 0.2)) ** 0.7)
        scale = np.maximum(np.maximum(w * fast + (1 - w) * slow, floor), 1e-9)
        z = np.clip(delta / scale, -limit, limit)
        gap = np.diff(ts, prepend=ts[0] if s["at"] is None else s["at"])
        gap = np.concatenate([[0.0] * (2 - len(s["gaps"])), s["gaps"], np.where(n >= self.freeze_min, gap, 0.0)])
        frozen = (gap[2:] > self.soft) | (gap[1:-1] > self.soft) | (gap[:-2] > self.hard)
        z = np.where((n < self.freeze_min) | (scale <= 1e-9) | (frozen & self.freezes), np.nan, z)
        return [delta, tps, (tps > self.busy).astype(float), z], None, self.after(state, self.summed(ts, price, qty, side, limit, factor))


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def _cut(batch: pa.RecordBatch, keys: list[str]):
    """Slices of rows with equal keys, and these."""
    import pyarrow.compute as pc

    n = batch.num_rows
    new = np.zeros(n, bool)
    for c in keys:
        x = batch.column(c)
        if n > 1:
            a, b = x.slice(1), x.slice(0, n - 1)
            same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
            new[1:] |= ~same
    at = [0, *np.flatnonzero(new).tolist(), n]
    for i, j in zip(at, at[1:], strict=False):
        if i < j:
            part = batch.slice(i, j - i)
            yield tuple(part.column(c)[0].as_py() for c in keys), part


def chunked(rows: DataFrame, keys: list[str], at: str = "ts_ms", target: int = CHUNK_ROWS) -> DataFrame:
    """rows with _chunk: the span of time they fall in, of a length that gives each key chunks of about `target` rows."""
    names = [f"_k{i}" for i in range(len(keys))]
    spans = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min(at).alias("_t0"), F.greatest(F.lit(1), F.ceil((F.max(at) - F.min(at) + 1) / F.ceil(F.count("*") / target))).alias("_width"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    out = rows.join(spans, on=_all(same), how="inner")
    return out.select(*rows.columns, F.coalesce(F.expr(f"({at} - _t0) div _width"), F.lit(-1)).cast("long").alias("_chunk"))


def _all(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def scan(rows: DataFrame, keys: list[str], order: list[str], take: list[str], rule: Rule, out: str, target: int = CHUNK_ROWS) -> DataFrame:
    """The columns of rows and those of the schema `out`, which rule gives from the columns `take` (numbers), along each key's
    rows in the order given; its first column is the time. Keys may be null, and then are one key."""
    dealt = chunked(rows, keys, order[0], target)
    kinds = dict(rows.dtypes)
    by = [*keys, "_chunk"]

    def sums(batches):
        key, part, sub, held = None, [], 0, 0

        def made():
            columns = [np.concatenate(x) for x in zip(*part, strict=True)]
            found = json.dumps(rule.summed(*columns))
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types, strict=True)), pa.array([sub], pa.int64()), pa.array([found])], names=[*by, "_sub", "_map"])

        types = None
        for b in batches:
            types = [b.schema.field(c).type for c in by]
            for own, piece in _cut(b, by):
                if part and (own != key or held >= STRETCH):
                    yield made()
                    sub, part, held = sub + 1 if own == key else 0, [], 0
                key = own
                part.append(_columns(piece, take))
                held += piece.num_rows
        if part:
            yield made()

    key_schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_chunk long"])
    small = dealt.select(*dict.fromkeys([*by, *order, *take])).repartition(*by).sortWithinPartitions(*by, *order)
    maps = small.mapInArrow(sums, f"{key_schema}, _sub long, _map string")

    def start():
        state = [rule.first]

        def step(found):
            before = json.dumps(state[0])
            state[0] = rule.after(state[0], json.loads(found))
            return (before,)

        return step

    states = ordered_fold(maps, keys, ["_chunk", "_sub"], ["_map"], start, "_state string").where("_sub = 0").select(*by, "_state")
    both = dealt.withColumn("_state", F.lit(None).cast("string")).unionByName(states, allowMissingColumns=True)
    both = both.repartition(*by).sortWithinPartitions(*by, F.col("_state").isNull(), *order)
    names = [x.split()[0] for x in out.split(",")]
    types = [ARROW[x.split()[1]] for x in out.split(",")]
    columns = rows.columns

    def runs(batches):
        state = None
        for b in batches:
            for _, piece in _cut(b, by):
                entering = piece.column("_state")
                if entering[0].is_valid:
                    state = json.loads(entering[0].as_py())
                    piece = piece.slice(1)
                if not piece.num_rows:
                    continue
                cols, keep, state = rule.run(state, *_columns(piece, take))
                found = [pa.array(np.asarray(c), from_pandas=True).cast(t) for c, t in zip(cols, types, strict=True)]
                made = pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), *found], names=[*columns, *names])
                yield made if keep is None else made.filter(pa.array(keep))

    return both.mapInArrow(runs, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), out]))
