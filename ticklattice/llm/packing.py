"""Packing documents into sequences of fixed capacity by linear grouping and best fit.

Only longer documents are cut. What is packed depends on lengths alone, and a length
is at most the capacity, so the plan is made on the driver from the histogram of
lengths (as many rows as the capacity at most, whatever the input's size):

1. large lengths, in descending order, are put in groups of equal cardinality and
   rounded up to the largest of their group;
2. configurations of the few rounded sizes are optimised as a linear programme by
   column generation, and their whole multiples are used;
3. the actual pieces of each group take the places of the rounded ones, in order;
4. the small pieces, and the large ones left over, go by decreasing length to the
   sequence with the least room that suffices.

The plan says, for runs of pieces of one length, to which run of sequences they go.
Executors number the pieces of each length by distributed prefix sums and look their
run up. Null text counts as empty; every document has the end id at least; rows with
equal doc_id stay separate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import slices, stored
from .token_files import encoder

CAPACITY = 2048
#: Numbers of groups, and shares of the capacity above which a length is large, that are tried; the plan with the fewest
#: sequences is taken. Above a half, each large piece opens a sequence however it is grouped, and so the plan is at least as
#: good as best fit by decreasing length; smaller shares leave the linear programme more to choose.
GROUPS = (24, 64, 128)
SHARES = (2, 3, 6)
#: Pieces in a chunk that one task numbers.
CHUNK = 20_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, uint32)."""

    def cut(batches):
        enc = encoder(tokenizer, False)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                ids, counts = enc.encode(batch.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                first = np.cumsum(counts) - counts
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                data = [ids[a : a + m].tobytes() for a, m in zip((first[doc] + start).tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(map(zlib.crc32, data), pa.int64())]
                columns += [pa.array(data, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECE + (", ids binary" if with_ids else ""))


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how often each is used whole, of the optimum of the linear programme:
    columns are added until none has a price above that of a sequence."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    smallest = int(sizes.min())
    while True:
        price = np.linalg.solve(basis.T, np.ones(k))
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for lo in range(smallest, capacity + 1, smallest):  # what a stretch needs lies in earlier stretches
            c = np.arange(lo, min(lo + smallest, capacity + 1))
            rest = c[None, :] - sizes[:, None]
            gain = np.where(rest >= 0, value[np.maximum(rest, 0)] + price[:, None], 0.0)
            best = gain.argmax(axis=0)
            value[c], choice[c] = gain.max(axis=0), np.where(gain.max(axis=0) > 0, best, -1)
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while choice[c] >= 0:
            column[choice[c]] += 1
            c -= sizes[choice[c]]
        if (basis == column[:, None]).all(axis=0).any():
            break  # its price is above 1 by rounding alone
        used, move = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, used / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    used = np.floor(np.linalg.solve(basis, demand) + 1e-7).astype(np.int64)
    return [(basis[:, j].astype(np.int64), int(used[j])) for j in range(k) if used[j] > 0]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, share: int = 2) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Number of sequences, and runs (length, first rank, count, first sequence, offset): the piece of that length with rank
    first + i lies in sequence first + i at that offset."""
    runs, sequences = [], 0
    rank = dict.fromkeys(histogram, 0)
    room: list[deque] = [deque() for _ in range(capacity + 1)]  # by free room: runs of sequences
    free = 0  # bit r: some sequence has room r
    left = dict(histogram)

    def add(r: int, first: int, count: int) -> None:
        nonlocal free
        if r:
            room[r].append((first, count))
            free |= 1 << r

    large = sorted((x for x in histogram if capacity // share < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    if total > 4 * groups:
        queues, bounds, g = [deque() for _ in range(groups)], [total * (i + 1) // groups for i in range(groups)], 0
        seen = 0
        for x in large:  # descending; a length may stand in two groups
            n, at = histogram[x], 0
            while n:
                while seen >= bounds[g]:
                    g += 1
                now = min(n, bounds[g] - seen)
                queues[g].append([x, now])
                n, seen, at = n - now, seen + now, at + now
        queues = [q for q in queues if q]
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(n for _, n in q) for q in queues], float)
        for config, times in configurations(sizes, demand, capacity):
            open_runs = [(sequences, times, 0)]  # first, count, used
            sequences += times
            for g in np.repeat(np.arange(len(sizes)), config):
                after = []
                for first, count, used in open_runs:
                    while count and queues[g]:
                        head = queues[g][0]
                        now = min(count, head[1])
                        runs.append((head[0], rank[head[0]], now, first, used))
                        rank[head[0]] += now
                        left[head[0]] -= now
                        after.append((first, now, used + head[0]))
                        first, count = first + now, count - now
                        head[1] -= now
                        if not head[1]:
                            queues[g].popleft()
                    if count:
                        after.append((first, count, used))
                open_runs = after
            for first, count, used in open_runs:
                add(capacity - used, first, count)
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            fits = free >> x
            if not fits:
                count = -(-n // (capacity // x))
                add(capacity, sequences, count)
                sequences += count
                continue
            r = x + (fits & -fits).bit_length() - 1
            first, count = room[r].popleft()
            each = min(r // x, n)
            now = min(count, n // each)
            for j in range(each):
                runs.append((x, rank[x], now, first, capacity - r + j * x))
                rank[x] += now
            n -= now * each
            if count > now:
                room[r].appendleft((first + now, count - now))
            if not room[r]:
                free &= ~(1 << r)
            add(r - each * x, first, now)
    return sequences, runs


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The plan with the fewest sequences of those tried; no more are tried once the total of lengths allows no fewer."""
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best = None
    for share in SHARES:
        for groups in GROUPS[: 1 if share == 2 else None]:
            plan = plan_packing(histogram, capacity, groups, share)
            best = plan if best is None or plan[0] < best[0] else best
            if best[0] == least:
                return best
    return best


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and any others); pieces should be a stored table."""
    histogram = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    _, runs = best_plan(histogram, capacity)
    runs.sort()
    length, rank, _, sequence, offset = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else [[]] * 5))
    shift = 44
    keys = (length << shift) + rank
    chunks = max(1, -(-sum(histogram.values()) // CHUNK))
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    counts = dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_own", F.row_number().over(own)).join(counts, ["length", "_chunk"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_own") - 1).select(*pieces.columns, "_rank")

    def look_up(batches):
        for b in batches:
            n = b.column("length").to_numpy()
            r = b.column("_rank").to_numpy()
            at = np.searchsorted(keys, (n << shift) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[at] + r - rank[at], pa.int64()), pa.array(offset[at], pa.int64())], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs all documents; a row for each piece with its place."""
    return packed(stored(tokenised_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, doc_ids and ids (binary, uint32) in order of offset."""
    put = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return put.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), joined.alias("ids"))


def op_query(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack_documents(docs, tokenizer)
