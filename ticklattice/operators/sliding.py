"""Order statistics of the last values, from a window that stays sorted.

Rows are dealt into blocks by their number, with the rows before that a window needs, and
streamed in order; a value enters the sorted window by bisection and leaves it the same
way, so a row costs a shift of the window and no sort. The median of the distances from
the median is found by bisection too: distances grow to both sides of it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BLOCK, CHUNK_MS, chunk_of, running
from .scans import _columns, _cut


def quantile(s: list[float], q: float) -> float:
    """With linear interpolation, of a sorted list."""
    at = (len(s) - 1) * q
    i = int(at)
    return s[i] if i + 1 >= len(s) else s[i] + (s[i + 1] - s[i]) * (at - i)



def median(s: list[float]) -> float:
    n = len(s)
    return (s[(n - 1) // 2] + s[n // 2]) / 2


def mad(s: list[float]) -> float:
    """The median of the distances from the median."""
    n, m = len(s), median(s)
    first = bisect_left(s, m)
    left, right = first, n - first  # distances m - s[first - 1 - i] and s[first + i] - m, both ascending

    def nth(k: int) -> float:
        """The k-th smallest distance, from 0: k + 1 = i from the left and j from the right."""
        lo, hi = max(0, k + 1 - right), min(k + 1, left)
        while lo < hi:
            i = (lo + hi) // 2
            j = k + 1 - i
            if j > 0 and m - s[first - 1 - i] < s[first + j - 1] - m:
                lo = i + 1
            else:
                hi = i
        i, j = lo, k + 1 - lo
        return max(m - s[first - i] if i else 0.0, s[first + j - 1] - m if j else 0.0)

    return (nth((n - 1) // 2) + nth(n // 2)) / 2



class Sorted:
    """The last values (at most `last`, and of the last span_ms) in order of arrival and in order of size."""

    def __init__(self, last: int | None, span_ms: float | None):
        self.last, self.span, self.queue, self.values = last, span_ms, deque(), []
        self.total = self.squares = 0.0
        self.left = 0
        self.below: dict[object, list] = {}  # name -> [i, the sum of the i smallest]

    def add(self, at: float, x: float, now: float | None = None) -> None:
        """A value of the time `at`, at the time `now`."""
        if x == x:
            self.queue.append((at, x))
            place = bisect_right(self.values, x)
            self.values.insert(place, x)
            for b in self.below.values():
                if place < b[0]:
                    b[0] += 1
                    b[1] += x
            self.total += x
            self.squares += x * x
            if self.last is not None and len(self.queue) > self.last:
                self._leave()
        if self.span is not None:
            now = at if now is None else now
            while self.queue and now - self.queue[0][0] > self.span:
                self._leave()

    def deviation(self) -> float:
        n = len(self.values)
        mean, squares = self.total / n, self.squares / n
        if squares - mean * mean > 1e-6 * squares:
            return (squares - mean * mean) ** 0.5
        return (sum((v - mean) ** 2 for v in self.values) / n) ** 0.5  # next to nothing is left of the difference: sum anew

    def smallest(self, i: int, name: object) -> float:
        """The sum of the i smallest values, from that of the last call by this name: as far as i or the values have moved since."""
        b = self.below.setdefault(name, [0, 0.0])
        while b[0] < i:
            b[1] += self.values[b[0]]
            b[0] += 1
        while b[0] > i:
            b[0] -= 1
            b[1] -= self.values[b[0]]
        return b[1]

    def drawn(self, low: float, high: float) -> tuple[float, float]:
        """Middle (the lower of two) and mean of the values drawn in to those of the ranks floor((n - 1) * low) and ... high."""
        v, n = self.values, len(self.values)
        i, j = int((n - 1) * low), int((n - 1) * high)
        inside = self.smallest(j + 1, "high") - self.smallest(i, "low")
        return min(v[j], max(v[i], v[(n - 1) // 2])), (i * v[i] + inside + (n - 1 - j) * v[j]) / n

    def _leave(self) -> None:
        _, x = self.queue.popleft()
        place = bisect_left(self.values, x)
        del self.values[place]
        for b in self.below.values():
            if place < b[0]:
                b[0] -= 1
                b[1] -= x
        self.total -= x
        self.squares -= x * x
        self.left += 1
        if self.left % 4096 == 0:  # what rounding has left over goes
            self.total, self.squares = sum(self.values), sum(v * v for v in self.values)
            for b in self.below.values():
                b[1] = sum(self.values[: b[0]])


#: What can be asked of a window (deviation: of the population).
STATISTICS = {
    "count": lambda w: len(w.values), "middle": lambda w: median(w.values), "mad": lambda w: mad(w.values), "mean": lambda w: w.total / len(w.values),
    "deviation": lambda w: w.deviation(),
}


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def _whole(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pieces[0] if len(pieces) == 1 else pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]


def sliding(rows: DataFrame, value: str, stats: dict[str, object], last: int | None = None, span_ms: int | None = None, at: str = "ts_ms", now: str | None = None, order: tuple[str, ...] = ("seq",), least: int = 1, block: int = BLOCK, peers: bool = False) -> DataFrame:
    """Adds the columns of `stats` (to -> a name in STATISTICS, (quantile's p,) or a function of Sorted), over each symbol's `last` rows with a value
    that is not null, or those whose time `at` is at most span_ms before `now` (else `at`; both: those that meet both), this one included; null with fewer
    than `least` values. Null values are no part of a window, but their rows get its statistics. With `last`, rows are dealt
    in blocks by the number of values so far; with a span alone, in chunks of time. With `peers` rows of one time (ts_ms) are all
    part of each other's windows, which have one answer."""
    names = list(stats)
    find = [STATISTICS[s] if isinstance(s, str) else s if callable(s) else (lambda w, q=s[0]: quantile(w.values, q)) for s in stats.values()]
    if last is not None:
        n = running(rows, {"_n": F.col(value).isNotNull().cast("int")}, order)
        dealt = n.withColumn("_chunk", F.explode(F.sequence(F.expr(f"_n div {block}"), F.expr(f"(_n + {last}) div {block}")))).withColumn("_own", F.col("_chunk") == F.expr(f"_n div {block}"))
    else:
        width = max(CHUNK_MS, span_ms)  # a row is in two chunks at most
        parts = F.sequence(chunk_of(width=width), F.expr(f"(ts_ms + {span_ms}) div {width}"))
        dealt = rows.select("*", F.explode_outer(parts).alias("_chunk")).withColumn("_own", F.col("_chunk").eqNullSafe(chunk_of(width=width)))
    by = ["symbol", "_chunk"]
    columns = rows.columns
    kinds = dict(rows.dtypes)

    def answered(piece, window):
        mine = piece.column("_own").to_numpy(zero_copy_only=False)
        t, u, v, ts = (x.tolist() for x in _columns(piece, [at, now or at, value, "ts_ms"]))
        out = np.full((len(names), len(t)), np.nan)
        begin = 0
        for i, (time, at_row, x, wanted) in enumerate(zip(t, u, v, mine.tolist(), strict=True)):
            window.add(time, x, at_row)
            if peers and i + 1 < len(ts) and _same(ts[i], ts[i + 1]):
                continue
            if wanted and len(window.values) >= least:
                for k, f in enumerate(find):
                    out[k, begin : i + 1] = f(window)
            begin = i + 1
        made = [pa.array(c, from_pandas=True) for c in out]
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), *made], names=[*columns, *names]).filter(pa.array(mine))

    def run(batches):
        key, window, held = None, None, []  # held: rows whose time may go on in the next piece
        for b in batches:
            for own, piece in _cut(b, by):
                if own != key:
                    if held:
                        yield answered(_whole(held), window)
                    key, window, held = own, Sorted(last, span_ms), []
                if not peers:
                    yield answered(piece, window)
                    continue
                ts = _columns(piece, ["ts_ms"])[0]
                other = np.flatnonzero((ts != ts[-1]) & ~(np.isnan(ts) & np.isnan(ts[-1])))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    held.append(piece.slice(0, cut))
                if held and (cut or not _same(_columns(held[-1], ["ts_ms"])[0][-1], ts[-1])):
                    yield answered(_whole(held), window)
                    held = []
                held.append(piece.slice(cut))
        if held:
            yield answered(_whole(held), window)

    dealt = dealt.repartition(*by).sortWithinPartitions(*by, "ts_ms", *order)
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"`{n}` double" for n in names)]))
