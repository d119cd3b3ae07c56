"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key of 64 bits, the signs of random projections in
a row; vectors are sorted by key over the cluster, numbered, and cut into blocks of
WINDOW. Each vector is compared with its block and the next one or the one before,
in double precision, so all within WINDOW places of each other are. Of the verified
pairs a block hands on a spanning forest; components come from all passes together.
Where more than WINDOW vectors share the first bits of a key (a dense region), all of
them that are in different components are then compared too, in blocks of bounded
size. So in every pass all that share these bits are compared, and the number of
passes follows: a pair right at the threshold is lost with probability MISS at most
(a closer one far less), however the vectors lie.

Links are then counted exactly: within a component all vectors are compared, in
blocks of bounded size that hand on counts, not pairs. Vectors with the same bytes
are one node with a multiplicity. Vectors that are null, zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths. Rows with equal
vec_id stay separate; a null vec_id is never a component's id unless it is alone. An
empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import stored
from .vectors import packed, unpacked, usable

WINDOW, BITS, MISS = 512, 63, 1e-3
#: Vectors of a component compared in one block.
BLOCK = 1024
#: Vectors of a dense region, and rows of blocks, dealt to one task at a time.
DEALT = 4096


def shared_bits(n: int) -> int:
    """First bits of a key that about WINDOW / 2 of n vectors spread out share."""
    return min(BITS, ceil(max(0.0, log2(max(1, n) / WINDOW) + 1)))


def passes(n: int, threshold: float, miss: float = MISS) -> int:
    same_bit = 1 - acos(threshold) / pi
    near = same_bit ** shared_bits(n)
    return 1 if near >= 1 - miss else ceil(log(miss) / log(1 - near))


def _keys(nodes: DataFrame, n_passes: int, seed: int) -> DataFrame:
    """pass, key and node for every node and pass."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        value = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims, node = b.column("dim").to_numpy(), b.column("node").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(n_passes, BITS, dim))
                at = np.flatnonzero(dims == dim)
                x = unpacked(b.column("v").take(pa.array(at)), dim)
                for p in range(n_passes):
                    key = (x @ planes[dim][p].T > 0) @ value
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p), pa.int32()), pa.array(key, pa.int64()), pa.array(node[at], pa.int64())], names=["pass", "key", "node"])

    return nodes.select("node", "dim", "v").mapInArrow(run, "pass int, key long, node long")


def _unit(v, dims: np.ndarray):
    """For each dimension: which rows have it, and their unit vectors."""
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        x = unpacked(v.take(pa.array(at)), dim)
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(near: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a symmetric adjacency matrix."""
    label = np.arange(len(near))
    np.fill_diagonal(near, True)
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _pass_links(nodes: DataFrame, n_passes: int, threshold: float, seed: int) -> DataFrame:
    """Edges (a, b) that span what the passes link."""
    n_parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = _keys(nodes, n_passes, seed).repartitionByRange(n_parts, "pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    order = stored(order.select("node", F.monotonically_increasing_id().alias("_m")), "order")
    part, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = order.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = order.withColumn("_p", part).join(F.broadcast(bases), "_p").select("node", F.floor((F.col("_base") + local) / WINDOW).alias("_own"))
    rows = placed.select("node", "_own", F.explode(F.array("_own", F.col("_own") - 1)).alias("_block")).join(nodes.select("node", "dim", "v"), "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("node").to_numpy()
        a, b = [], []
        for at, x in _unit(table.column("v"), table.column("dim").to_numpy()):
            label = _forest(x @ x.T >= threshold)
            moved = label != np.arange(len(label))
            a.append(node[at][moved])
            b.append(node[at][label[moved]])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return rows.groupBy("_block").applyInArrow(run, "a long, b long").distinct()


def _dense_links(nodes: DataFrame, labels: DataFrame, n_passes: int, bits: int, threshold: float, seed: int) -> DataFrame:
    """Edges (a, b) between components with linked vectors in one of the regions, more than WINDOW vectors with the same first bits."""
    keys = _keys(nodes, n_passes, seed).select("pass", F.shiftright("key", BITS - bits).alias("_prefix"), "node")
    rows = stored(keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "regions")
    dense = rows.groupBy("pass", "_prefix").agg(F.count("*").alias("_size"), F.min("label").alias("_x"), F.max("label").alias("_y"))
    dense = dense.where((F.col("_size") > WINDOW) & (F.col("_x") != F.col("_y"))).select("pass", "_prefix", "_size")
    rows = rows.join(dense, ["pass", "_prefix"]).join(nodes.select("node", "dim", "v"), "node")
    parts = F.ceil(F.col("_size") / DEALT).cast("int")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("_i", F.least("_c", "_o")).withColumn("_j", F.greatest("_c", "_o"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label, c, i, j = (table.column(x).to_numpy() for x in ("label", "_c", "_i", "_j"))
        found = [np.zeros((0, 2), np.int64)]
        if (label != label[0]).any():
            for at, x in _unit(table.column("v"), table.column("dim").to_numpy()):
                own, own_c = label[at], c[at]
                left, right = np.flatnonzero(own_c == i[0]), np.flatnonzero(own_c == j[0])
                for lo in range(0, len(left), BLOCK):
                    for other in range(0, len(right), BLOCK):
                        a, b = left[lo : lo + BLOCK], right[other : other + BLOCK]
                        near = (x[a] @ x[b].T >= threshold) & (own[a][:, None] != own[b][None, :])
                        u, v = np.nonzero(near)
                        if len(u):
                            pairs = np.stack([own[a[u]], own[b[v]]], axis=1)
                            pairs.sort(axis=1)
                            found.append(np.unique(pairs, axis=0))
        pairs = np.concatenate(found)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    picked = rows.select("pass", "_prefix", "_i", "_j", "_c", "label", "dim", "v")
    return picked.groupBy("pass", "_prefix", "_i", "_j").applyInArrow(run, "a long, b long").distinct()


def _counted(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """node and links: the summed multiplicities of the other nodes of its component that it links to."""
    parts = F.ceil(F.col("_size") / BLOCK).cast("int")
    sizes = labels.groupBy("label").agg(F.count("*").alias("_size"))
    n_rows = sizes.agg(F.sum(F.col("_size") * parts).alias("n")).first()["n"] or 0
    rows = labels.join(sizes, "label").join(nodes.select("node", "mult", "dim", "v"), "node")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("_i", F.least("_c", "_o")).withColumn("_j", F.greatest("_c", "_o"))
    n_tasks = max(1, -(-n_rows // DEALT))
    rows = rows.withColumn("_group", F.xxhash64("label", "_i", "_j")).withColumn("_task", F.pmod("_group", F.lit(n_tasks)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.sort_by([("_group", "ascending"), ("_c", "ascending")])
        group, node, mult, c, i, j = (table.column(x).to_numpy() for x in ("_group", "node", "mult", "_c", "_i", "_j"))
        dims, v, out = table.column("dim").to_numpy(), table.column("v"), np.zeros(len(group), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for at, x in _unit(v.slice(lo, hi - lo), dims[lo:hi]):
                at = at + lo
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if i[lo] != j[lo]:  # two blocks: only what lies across
                    near &= c[at][:, None] != c[at][None, :]
                out[at] += near @ mult[at]
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(out, pa.int64())})

    picked = rows.select("_task", "_group", "_c", "_i", "_j", "node", "mult", "dim", "v")
    return picked.groupBy("_task").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding)."""
    good = usable("embedding")
    named = stored(packed(vectors.where(good).select("vec_id", "embedding"), "embedding", "vec_id"), "packed")
    nodes = named.groupBy("dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "rep", "mult", "dim", "v"), "vectors")
    n = nodes.count()
    n_passes = passes(n, threshold)
    near = stored(_pass_links(nodes, n_passes, threshold, seed), "links")
    labels = stored(components(near), "labels")
    if n > WINDOW:
        dense = stored(_dense_links(nodes, labels, n_passes, shared_bits(n), threshold, seed), "links")
        labels = stored(components(dense, labels), "labels")
    links = _counted(nodes, labels, threshold)
    all_nodes = nodes.select("node", "rep", "mult", "dim", "v").join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = all_nodes.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = all_nodes.join(ids, "label").select("dim", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), "component_id")
    out = named.join(known, ["dim", "v"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op_query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
