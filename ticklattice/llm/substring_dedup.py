"""Exact removal of repeated byte strings by refining buckets of positions.

A window is a string of WINDOW bytes; a byte goes if a window over it also starts
earlier (smaller doc_id, or the same document and an earlier start). As in building
a suffix array, positions are put in buckets by their first bytes, and buckets are
refined by the identifiers of the buckets at later offsets, which are computed once
from prefix sums and reused; the depth needed here is WINDOW. Only one position in
some 37 is carried along:

1. The anchor of a window is the q-gram in it with the least identifier (the
   rightmost of equal ones). Equal windows have the same anchor at the same offset,
   so an anchor stands for the run of windows that chose it, and the anchors' q-grams
   are the initial buckets.
2. A bucket is refined by the identifier of all bytes under the run. All but the
   first position of a refined bucket are repeated with their whole run. If a bucket
   falls apart, the first position of each part goes on.
3. Runs that go on are cut into slices of SLICE windows, aligned to the anchor, and
   refined by the identifier of the bytes that all windows of the slice share.
4. Windows of a slice differ in a few bytes at either end, which go along as
   integers; identifiers of the shared bytes with these are the windows themselves,
   and all but the first of each are repeated.

Identifiers are 64-bit hashes (step 2 compares two together, step 4 one with the
bytes at both ends), so no string is cut off, sampled away or capped. Before rows are
shuffled, tasks drop what they can tell to be repeated from the rows they hold, so of
a passage in very many documents only a few rows for each task reach its bucket. A null text counts as empty, a null doc_id comes
before all others. Rows with equal or null doc_id are told apart by a 64-bit hash of
their text, in the order of which they stand; equal rows count as one document. Long
documents are read in overlapping stretches. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mixed
from .storage import stored

WINDOW, Q, SLICE = 100, 28, 9
SPAN = WINDOW - Q + 1  # q-grams of a window
SHARED = WINDOW - SLICE + 1  # bytes that all windows of a slice share
#: Rows that a task looks through before the shuffle, and slices dealt to a task after it, about.
HELD, DEALT = 300_000, 200_000
STRETCH = 1 << 20
_BASE = np.uint64(0x5851F42D4C957F2D)
_BYTE = np.random.default_rng(20240602).integers(0, 2**64, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFF)
#: The lowest n bytes of a 64-bit integer.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Identifiers:
    """Identifiers of any strings of a buffer: powers of the base are kept between buffers."""

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.power) <= n:
            self.power = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)))
            self.back = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.power[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.back[begin]


def stretches(texts: list[bytes]):
    """Buffers of about STRETCH bytes: (data, per piece: text number, offset in the text, place in data, bytes).

    A piece of a longer text overlaps the next by WINDOW - 1 bytes."""
    parts, rows, size = [], [], 0
    for i, x in enumerate(texts):
        for at in range(0, max(1, len(x) - WINDOW + 1), STRETCH):
            piece = x[at : at + STRETCH + WINDOW - 1]
            if size and size + len(piece) > STRETCH + WINDOW:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows, np.int64)
                parts, rows, size = [], [], 0
            parts.append(piece)
            rows.append((i, at, size, len(piece)))
            size += len(piece)
    if size:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows, np.int64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, from minima of blocks' beginnings and ends."""
    n = len(x) - width + 1
    blocks = np.append(x, np.full(-len(x) % width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(ids: Identifiers, data: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of a buffer: (piece, anchor, first and last window, bucket, identifier of the run); places are in the buffer."""
    ids.load(data)
    n = len(data) - WINDOW + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    at = np.arange(len(data) - Q + 1)
    gram = mixed(ids.of(at, at + Q))
    least = _least((gram & ~_LOW) | (_LOW - at.astype(np.uint64)), SPAN)
    piece = np.repeat(np.arange(len(pieces)), pieces[:, 3])[:n]
    window = np.flatnonzero(np.arange(n) + WINDOW <= (pieces[:, 2] + pieces[:, 3])[piece])
    anchor = (_LOW - (least[window] & _LOW)).astype(np.int64)
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[window[1:]] != piece[window[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    lo, hi, a = window[first], window[last], anchor[first]
    run = mixed(ids.of(lo, hi + WINDOW) + mixed(((a - lo) * 256 + hi - lo).astype(np.uint64)))
    return piece[lo], a, lo, hi, gram[a], run


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").to_pylist()]


def _identified(docs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    more = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col("doc_id").isNull(), text).alias("h"), text.alias("text"), *more)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """bucket, run, d, h, p, whole for every anchor; p packs first window, run length and place of the anchor. whole: a task
    has found that the run is repeated; such a row is dealt by its document."""

    def anchors_of(batches):
        ids = Identifiers()
        for b in batches:
            d, h = b.column("d").to_numpy(), b.column("h").to_numpy()
            for data, pieces in stretches(_texts(b)):
                piece, a, lo, hi, gram, whole = anchors(ids, data, pieces)
                doc = pieces[piece, 0]
                p = ((lo - pieces[piece, 2] + pieces[piece, 1]) << 16) | ((hi - lo) << 8) | (a - lo)
                yield gram.view(np.int64), whole.view(np.int64), d[doc], h[doc], p

    most = HELD

    def run(batches):
        held, n = [], 0
        for x in anchors_of(batches):
            held.append(x)
            n += len(x[0])
            if n >= most:
                yield _combined_anchors(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield _combined_anchors(*map(np.concatenate, zip(*held, strict=True)))

    return docs.mapInArrow(run, "bucket long, run long, d long, h long, p long, whole boolean")


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    """True where a row equals the one before it in all columns."""
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def _combined_anchors(bucket, run, d, h, p) -> pa.RecordBatch:
    order = np.argsort(run, kind="stable")
    twin = _same_as_before(run[order])
    twin[:-1] |= twin[1:]  # all rows whose run another row shares
    some = order[twin]
    some = some[np.lexsort((p[some], h[some], d[some], run[some], bucket[some]))]
    equal = _same_as_before(bucket[some], run[some], d[some], h[some], p[some])  # equal rows of docs: one counts
    whole, keep = np.zeros(len(bucket), bool), np.ones(len(bucket), bool)
    whole[some[_same_as_before(bucket[some], run[some])]] = True
    keep[some[equal]] = False
    bucket = np.where(whole, mixed(d.view(np.uint64)).view(np.int64), bucket)
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (bucket, run, d, h, p, whole)], names=["bucket", "run", "d", "h", "p", "whole"])


def _refined(rows: DataFrame, n: int) -> DataFrame:
    """d, h, p, whole: positions whose whole run is repeated (whole), and those that go on."""

    def run(batches):
        bucket = part = None  # of the row before
        first, told = (0, 0, 0), True  # the bucket's first row, and whether it was handed on
        last = None
        for batch in batches:
            done = batch.filter(batch.column("whole"))
            if done.num_rows:
                yield done.select(["d", "h", "p", "whole"])
            batch = batch.filter(pc.invert(batch.column("whole")))
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("bucket", "run", "d", "h", "p")]
            # equal rows of docs give equal positions, of which one counts
            own = ~_same_as_before(*columns)
            own[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
            last = [c[-1] for c in columns]
            if not own.any():
                continue
            g, r, *place = (c[own] for c in columns)
            new = np.append(bucket is None or g[0] != bucket, g[1:] != g[:-1])
            other = new | np.append(part is None or r[0] != part, r[1:] != r[:-1])
            owner = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            parted = other & ~new
            heads = np.unique(owner[parted])
            out = [[x[~other], x[parted], x[heads[heads >= 0]]] for x in place]
            if len(heads) and heads[0] < 0 and not told:
                for x, y in zip(out, first, strict=True):
                    x.append(np.array([y]))
                told = True
            if owner[-1] >= 0:
                first, told = [x[owner[-1]] for x in place], bool(len(heads)) and heads[-1] == owner[-1]
            bucket, part = g[-1], r[-1]
            whole = np.arange(sum(map(len, out[0]))) < len(out[0][0])
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out), pa.array(whole)], names=["d", "h", "p", "whole"])

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "run", "d", "h", "p").mapInArrow(run, "d long, h long, p long, whole boolean")


def _with_text(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """docs with ps: all p of places for the document (as many as it has windows at most)."""
    own = places.groupBy("d", "h").agg(F.collect_list("p").alias("ps"))
    return docs.join(own, ["d", "h"], how)


def _slices(docs: DataFrame, places: DataFrame) -> DataFrame:
    """key (of the bytes shared), left and right (the eight bytes beside them), d, h, p (place of the shared bytes, and a bit
    for each window counted back from there), done for each slice of the runs that go on. done: a task has found the
    window to be repeated; then p is as spans_of() takes it and key deals by document."""

    def run(batches):
        ids = Identifiers()
        pad = np.zeros(8, np.uint8)
        scale = np.array([1 << 8 * i for i in range(8)], np.uint64)
        for b in batches:
            for i, text in enumerate(_texts(b)):
                p = np.array(b.column("ps")[i].as_py(), np.int64)
                data = np.frombuffer(text, np.uint8)
                lo = (p >> 16) & 0xFFFFFFFF
                hi, a = lo + ((p >> 8) & 0xFF), lo + (p & 0xFF)
                base = int(lo.min())
                data = data[base : int(hi.max()) + WINDOW]
                ids.load(data)
                s0, s1 = (a - hi) // SLICE, (a - lo) // SLICE
                k = s1 - s0 + 1
                who = np.repeat(np.arange(len(p)), k)
                s = s0[who] + np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k)
                c = a[who] - SLICE * s
                j0, j1 = np.maximum(0, c - hi[who]), np.minimum(SLICE - 1, c - lo[who])
                at = c - base
                # where the shared bytes begin before the data or end after it, a later window's bytes are not needed: none is in range
                end = at + SHARED
                good = (at >= 0) & (end <= len(data))
                who, s, c, j0, j1, at, end = (x[good] for x in (who, s, c, j0, j1, at, end))
                key = mixed(ids.of(at, end) + mixed(s.astype(np.uint64) + np.uint64(977)))
                wide = np.concatenate([pad, data, pad])
                near = np.arange(8)
                left = (wide[(at + 7)[:, None] - near].astype(np.uint64) * scale).sum(axis=1, dtype=np.uint64)
                right = (wide[(end + 8)[:, None] + near].astype(np.uint64) * scale).sum(axis=1, dtype=np.uint64)
                q = (c << 16) | ((2 << j1) - (1 << j0))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), *(pa.array(np.full(len(q), b.column(x)[i].as_py(), np.int64)) for x in ("d", "h")), pa.array(q)], names=["key", "left", "right", "d", "h", "p"])

    most = HELD

    def combined(batches):
        held, n = [], 0
        for x in run(batches):
            held.append(x)
            n += x.num_rows
            if n >= most:
                yield from _combined_slices(held)
                held, n = [], 0
        if n:
            yield from _combined_slices(held)

    return _with_text(docs, places, "inner").select("d", "h", "text", "ps").mapInArrow(combined, "key long, left long, right long, d long, h long, p long, done boolean")


def _combined_slices(held: list[pa.RecordBatch]):
    t = pa.Table.from_batches(held)
    columns = [t.column(c).to_numpy() for c in ("key", "left", "right", "d", "h", "p")]
    d, h, p, rest = _repeats(*columns)
    key, left, right, dd, hh, pp = columns
    keep = rest > 0
    pp = (pp & ~0xFFFF) | rest
    zero = np.zeros(len(d), np.int64)
    spread = mixed(d.view(np.uint64)).view(np.int64)
    out = [np.concatenate([a[keep], b]) for a, b in ((key, spread), (left, zero), (right, zero), (dd, d), (hh, h), (pp, p))]
    done = np.arange(len(out[0])) >= int(keep.sum())
    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(done)], names=["key", "left", "right", "d", "h", "p", "done"])


def _repeats(key, left, right, d, h, p) -> tuple[np.ndarray, ...]:
    """d, h, p (packed as a run of one window) for each window of these slices that also starts earlier in them, and for each
    slice the bits of its other windows."""
    bits = (p & 0xFFFF).copy()
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    some = some[np.lexsort((p[some], h[some], d[some]))]
    k, lo, hi, c = key[some], left[some].view(np.uint64), right[some].view(np.uint64), (p[some] >> 16) & 0xFFFFFFFF
    out = []
    for j in range(SLICE):
        i = np.flatnonzero(bits[some] >> j & 1)
        a, b = lo[i] & _MASK[j], hi[i] & _MASK[SLICE - 1 - j]
        order = np.argsort(mixed(k[i].view(np.uint64) + mixed(a + mixed(b))), kind="stable")
        i = i[order]
        same = _same_as_before(k[i], a[order], b[order])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(i))))
        # equal rows of docs give the same place, which is no repetition of itself
        own = np.all([x[i] == x[i[first]] for x in (d[some], h[some], c)], axis=0)
        again = i[same & ~own]
        out.append((d[some[again]], h[some[again]], c[again] - j << 16))
        bits[some[i[same]]] &= ~(1 << j)
    return *(np.concatenate(x) for x in zip(*out, strict=True)), bits


def _repeated_windows(slices: DataFrame, n: int) -> DataFrame:
    """d, h, p (packed as a run of one window) for each window of a slice that also starts earlier."""

    def run(table: pa.Table) -> pa.Table:
        done = table.column("done").to_numpy()
        columns = [table.column(c).to_numpy() for c in ("key", "left", "right", "d", "h", "p")]
        found = _repeats(*(c[~done] for c in columns))
        return pa.table({c: pa.array(np.concatenate([x[done], y])) for c, x, y in zip(("d", "h", "p"), columns[3:], found[:3], strict=True)})

    return slices.withColumn("_task", F.pmod("key", F.lit(n))).groupBy("_task").applyInArrow(run, "d long, h long, p long")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """d, h and p (packed) of all windows that also start earlier, in runs."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = _identified(docs)
    places = stored(_refined(_anchor_rows(own), n), "places")
    open_places = places.where("not whole").select("d", "h", "p")
    most = open_places.agg(F.sum(F.expr("shiftright(p, 8) & 255") / SLICE + 2).alias("n")).first()["n"] or 0  # slices, at most
    windows = _repeated_windows(_slices(own, open_places), max(n, -(-int(most) // DEALT)))
    return stored(places.where("whole").select("d", "h", "p").unionByName(windows), "windows")


def spans_of(p: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the maximal runs of bytes under the windows in p."""
    p = np.array(p or [], np.int64)
    lo = (p >> 16) & 0xFFFFFFFF
    end = lo + ((p >> 8) & 0xFF) + WINDOW
    order = np.argsort(lo)
    lo, end = lo[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.append(True, lo[1:] > end[:-1])[: len(lo)]
    first = np.flatnonzero(new)
    return lo[first], np.append(end[first[1:] - 1], end[-1:])


def _cut(text: bytes, p: list[int] | None) -> tuple[bytes, list[int], list[int]]:
    begin, end = (x.tolist() for x in spans_of(p))
    return b"".join(text[x:y] for x, y in zip([0, *end], [*begin, len(text)], strict=True)), begin, end


def deduplicated(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    With `keep`, instead: these columns of docs, then begins and ends (of the bytes removed) kept (the bytes left) and kept_text (these without characters cut in two)."""
    places = repeated_runs(docs)

    def digests(batches):
        for b in batches:
            rows = []
            for d, text, p in zip(*(b.column(c).to_pylist() for c in ("d", "text", "ps")), strict=True):
                kept, begin, _ = _cut(text, p)
                rows.append((None if d == -(1 << 63) else d, len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def texts(batches):
        for b in batches:
            rows = [_cut(text, p) for text, p in zip(*(b.column(c).to_pylist() for c in ("text", "ps")), strict=True)]
            more = [pa.array([r[i] for r in rows], k) for i, k in ((1, pa.list_(pa.int64())), (2, pa.list_(pa.int64())), (0, pa.binary()))]
            more.append(pa.array([r[0].decode("utf-8", "ignore") for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(f"_keep{i}") for i in range(len(keep))), *more], names=[*keep, "begins", "ends", "kept", "kept_text"])

    rows = _with_text(_identified(docs, keep or []), places, "left")
    if keep is None:
        return rows.select("d", "text", "ps").mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    kinds = dict(docs.dtypes)
    return rows.mapInArrow(texts, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "begins array<long>, ends array<long>, kept binary, kept_text string"]))


def op_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return deduplicated(docs)
