"""Near-duplicate documents: banded MinHash, Bayesian pruning, exact verification.

Documents are linked when the Jaccard similarity of their shingle sets is at least a
threshold; components of links are what matters, so copies are never spelt out in
pairs:

1. Equal sets (of equal size, with two equal 64-bit fingerprints) become one node.
2. Bands of each node's signature make buckets. In every bucket the node with the
   largest buckets overall is the pivot, and only pivot and member are compared.
3. Compared means: signature batches, one after the other, until the posterior
   probability that the similarity reaches the threshold falls below MISS; survivors
   are verified on their full sets.
4. Buckets that then still hold several components are compared node by node, in
   blocks of bounded size: nodes of a bucket's largest component meet only those of
   other components, these also each other. A pair counts in the first band that it
   shares. Each node's best candidates are verified first, the rest where components
   still differ. No bucket and no candidate is cut off.

A document without words has an empty set and is linked with nothing. Null text
counts as empty. Rows with equal doc_id are told apart by their sets; a null doc_id
is never a component's id, and such a row is kept if its component has no other id.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .shingles import mixed, shingle_sets
from .storage import drop, slices, stored, text_bytes

ROWS, BANDS = 5, 24
HASHES = ROWS * BANDS
BATCH = 24  # hashes compared before the next decision
#: Posterior probability of a link below which a candidate is dropped.
MISS = 1e-4
#: Nodes of a bucket compared in one block, and rows of blocks dealt to a task, about.
BLOCK, DEALT = 1024, 4096
FIRST_TRIES = 8

#: Further hashes, of which one byte is kept; only nodes that share a bucket get them.
MORE, MORE_BATCH = 1024, 256

_rng = np.random.default_rng(7)
_MUL = (_rng.integers(0, 2**31, HASHES + MORE) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, HASHES + MORE).astype(np.uint32)


def signatures(sets: list[np.ndarray], first: int = 0, count: int = HASHES) -> np.ndarray:
    """A row of `count` minima for each set, from the hash functions from `first` on; sets must not be empty."""
    start = np.cumsum([0, *(len(x) for x in sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(x * _MUL[first + k] + _ADD[first + k], start)
    return out


@lru_cache(None)
def least_matches(threshold: float, hashes: int, miss: float = MISS) -> int:
    """Fewest matches of so many hashes for which the posterior of similarity >= threshold (uniform prior) is `miss` at least."""
    total = 0.0
    for m in range(hashes + 1):
        total += exp(lgamma(hashes + 2) - lgamma(m + 1) - lgamma(hashes + 2 - m) + m * log(threshold) + (hashes + 1 - m) * log(1 - threshold))
        if total >= miss:
            return m
    return hashes


def surviving(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of signatures a and b survive every batch, and the survivors' matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, HASHES, BATCH):
        matches = matches + (a[alive, k : k + BATCH] == b[alive, k : k + BATCH]).sum(axis=1)
        go = matches >= least_matches(threshold, min(HASHES, k + BATCH))
        alive, matches = alive[go], matches[go]
    return alive, matches


def surviving_more(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The same on rows of single bytes, of which unequal minima share one in 256."""
    same = threshold + (1 - threshold) / 256
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, MORE, MORE_BATCH):
        matches = matches + (a[alive, k : k + MORE_BATCH] == b[alive, k : k + MORE_BATCH]).sum(axis=1)
        go = matches >= least_matches(same, k + MORE_BATCH)
        alive, matches = alive[go], matches[go]
    return alive, matches


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hash (of the text), n (set size), f1 and f2 (the set's fingerprints; null if empty), signature."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                sets = shingle_sets(text_bytes(batch, "text"), words)
                full = [i for i, x in enumerate(sets) if len(x)]
                sig, f1, f2 = ([None] * len(sets) for _ in range(3))
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                        sig[i] = row.astype("<u4").tobytes()
                        f1[i], f2[i] = fingerprints(sets[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array([len(x) for x in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "hash", "n", "f1", "f2", "signature"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, hash long, n long, f1 long, f2 long, signature binary")


def fingerprints(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47):
        m = mixed(x + np.uint64(salt))
        out.append(int(mixed(np.array([m.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mixed(m))]))[0].astype(np.int64)))
    return out[0], out[1]


def _nodes(signed: DataFrame) -> DataFrame:
    """f1, f2, node (a number of its own for each), rep and hash (of one document that has the set), n, signature."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("rep")
    found = signed.where(F.col("f1").isNotNull()).groupBy("f1", "f2", "n").agg(rep, F.first("signature").alias("signature"))
    return found.select("f1", "f2", F.monotonically_increasing_id().alias("node"), F.col("rep.doc_id").alias("rep"), F.col("rep.hash").alias("hash"), "n", "signature")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, its sorted set and its further hashes (both binary) for the nodes in wanted (node, f1, f2, rep, hash of rep's text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                sets = shingle_sets(text_bytes(batch, "text"), words)
                node, f1, f2 = (batch.column(c).to_pylist() for c in ("node", "f1", "f2"))
                own = [i for i, x in enumerate(sets) if len(x) and fingerprints(x) == (f1[i], f2[i])]
                more = signatures([sets[i] for i in own], HASHES, MORE).astype(np.uint8) if own else []
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in own], pa.int64()), pa.array([sets[i].astype("<u8").tobytes() for i in own], pa.binary()), pa.array([x.tobytes() for x in more], pa.binary())], names=["node", "items", "more"])

    # a doc_id, null above all, may stand for several texts: the hash tells which is meant
    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("hash"))).select("node", "f1", "f2", "text")
    return found.mapInArrow(run, "node long, items binary, more binary").dropDuplicates(["node"])


def _close(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (lo, hi) that survive the comparison of signatures."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, HASHES) for c in ("sa", "sb"))
                alive, _ = surviving(a, b, threshold)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("lo", "hi")], names=["lo", "hi"])

    sa = nodes.select(F.col("node").alias("lo"), F.col("signature").alias("sa"))
    sb = nodes.select(F.col("node").alias("hi"), F.col("signature").alias("sb"))
    return pairs.join(sa, "lo").join(sb, "hi").select("lo", "hi", "sa", "sb").mapInArrow(run, "lo long, hi long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (lo, hi) with 100 * intersection >= percent * union, as edges (a, b)."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c) for c in ("ia", "ib"))
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), "<u8") for c in (left, right))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("lo", "hi")], names=["a", "b"])

    sa = sets.select(F.col("node").alias("lo"), F.col("items").alias("ia"))
    sb = sets.select(F.col("node").alias("hi"), F.col("items").alias("ib"))
    return pairs.join(sa, "lo").join(sb, "hi").select("lo", "hi", "ia", "ib").mapInArrow(run, "a long, b long")


def _candidates(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Pairs (lo, hi, matches) of different components that share a bucket and survive; each pair once."""
    now = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = now.groupBy("key", "label").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size")).where(F.col("top.n") < F.col("size"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = parts.select("key", F.col("top.label").alias("_top"), blocks(F.col("top.n")).alias("_in"), blocks(F.col("size") - F.col("top.n")).alias("_out"))
    rows = now.select("key", "node", "n", "band", "label").join(parts, "key")
    inner = F.col("label") == F.col("_top")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64("node"), F.when(inner, F.col("_in")).otherwise(F.col("_out"))).cast("int"))
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    outs, ins = F.sequence(F.lit(0), F.col("_out") - 1), F.sequence(F.lit(0), F.col("_in") - 1)
    c = F.col("_c")
    with_outer = F.transform(outs, lambda o: place(0, c, o, F.lit(0)))
    with_inner = F.transform(ins, lambda i: place(0, i, c, F.lit(1)))
    among_outer = F.transform(outs, lambda o: place(1, F.least(c, o), F.greatest(c, o), (c > o).cast("int")))
    rows = rows.withColumn("_at", F.explode(F.when(inner, with_outer).otherwise(F.concat(with_inner, among_outer))))
    cross = (F.col("_at.kind") == 0) | (F.col("_at.i") != F.col("_at.j"))
    rows = stored(rows.select(F.xxhash64("key", "_at.kind", "_at.i", "_at.j").alias("_group"), F.col("_at.side").alias("_c"), cross.alias("_cross"), "node", "label", "n", "band"), "blocks")
    n_tasks = max(1, -(-rows.count() // DEALT))
    rows = rows.withColumn("_task", F.pmod("_group", F.lit(n_tasks))).join(nodes.select("node", "signature"), "node").join(sets.select("node", "more"), "node")

    def run(table: pa.Table) -> pa.Table:
        g, node, label, n, band, c, cross = (table.column(x).to_numpy() for x in ("_group", "node", "label", "n", "band", "_c", "_cross"))
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(-1, HASHES)
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint8).reshape(-1, MORE)
        order = np.lexsort((node, g))
        g, node, label, n, band, c, cross, sig, more = (x[order] for x in (g, node, label, n, band, c, cross, sig, more))
        lo, hi, found = [], [], []
        for d in range(1, len(g)):
            i = np.flatnonzero(g[d:] == g[:-d])
            if not len(i):
                break  # no group is longer
            j = i + d
            ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (~cross[i] | (c[i] != c[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            alive, _ = surviving(sig[i], sig[j], threshold)
            i, j = i[alive], j[alive]
            first = (sig[i] == sig[j]).reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1) == band[i]
            i, j = i[first], j[first]
            alive, matches = surviving_more(more[i], more[j], threshold)
            i, j = i[alive], j[alive]
            lo.append(np.minimum(node[i], node[j]))
            hi.append(np.maximum(node[i], node[j]))
            found.append(matches)
        cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return pa.table({"lo": pa.array(cat(lo), pa.int64()), "hi": pa.array(cat(hi), pa.int64()), "matches": pa.array(cat(found), pa.int64())})

    picked = rows.select("_task", "_group", "node", "label", "n", "band", "_c", "_cross", "signature", "more")
    return picked.groupBy("_task").applyInArrow(run, "lo long, hi long, matches long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias("_" + c)) for c in ("lo", "hi"))
    j = pairs.join(la, "lo", "left").join(lb, "hi", "left")
    return j.where(F.coalesce("_lo", "lo") != F.coalesce("_hi", "hi")).drop("_lo", "_hi")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    threshold = percent / 100
    signed = stored(_signed(docs, words), "signed")
    nodes = stored(_nodes(signed), "nodes")
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("signature", 1 + 4 * ROWS * i, 4 * ROWS)).alias("key")) for i in range(BANDS)))
    rows = nodes.select("node", "n", F.explode(bands).alias("b")).select("node", "n", "b.band", "b.key")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(rows.join(sizes, "key"), "buckets")
    degrees = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    sets = stored(_sets(docs, degrees.join(nodes, "node").select("node", "f1", "f2", "rep", "hash"), words), "sets")

    pivots = buckets.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("p")).select("key", "p.node", "p.n").toDF("key", "pivot", "pn")
    star = buckets.join(pivots, "key").where((F.col("node") != F.col("pivot")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")))
    star = star.select(F.least("node", "pivot").alias("lo"), F.greatest("node", "pivot").alias("hi")).distinct()
    links = stored(_verified(_close(star, nodes, threshold), sets, percent), "links")
    labels = stored(components(links), "labels")

    open_pairs = stored(_candidates(buckets, nodes, sets, labels, threshold, percent), "candidates")
    ends = open_pairs.select(F.col("lo").alias("x"), "lo", "hi", "matches").unionByName(open_pairs.select(F.col("hi").alias("x"), "lo", "hi", "matches"))
    order = Window.partitionBy("x").orderBy(F.desc("matches"), "lo", "hi")
    first = stored(ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_TRIES).select("lo", "hi").distinct(), "tries")
    links = stored(_verified(first, sets, percent), "links")
    labels = stored(components(links, labels), "labels")
    rest = _apart(open_pairs.select("lo", "hi"), labels).join(first, ["lo", "hi"], "left_anti")
    links = stored(_verified(rest, sets, percent), "links")
    labels = stored(components(links, labels), "labels")
    drop(buckets, sets, open_pairs, first)

    named = nodes.select("node", "f1", "f2", F.col("n").alias("_n"), "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = named.join(ids, "label").select("f1", "f2", F.col("_n").alias("n"), "component_id")
    out = signed.select("doc_id", "n", "f1", "f2").join(ids, ["f1", "f2", "n"], "left")
    component = F.when(F.col("f1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=3, percent=85)
