"""Connected components of a graph given by its edges, as DataFrame joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stored

#: Edges that a task contracts at a time.
HELD = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) from every node to the smallest one that these edges reach from it."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # a node and its label both take the smaller label, then labels are followed
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: of HELD edges of a partition, only a forest goes on."""

    def run(batches):
        def out(held):
            t = pa.Table.from_batches(held)
            u, v = forest(t.column("u").to_numpy(), t.column("v").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return edges.mapInArrow(run, "u long, v long")


def _state(e: DataFrame):
    return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of edges (a, b; longs): label is the smallest node of its component.

    Tasks first contract what edges they hold to forests. Then two steps alternate until
    nothing changes: every node hands its larger neighbours to its smallest neighbour,
    then its smaller ones. Rounds grow with the logarithm of the component's size.
    known has the labels of earlier edges, to which these are added: only edges between
    different labels are worked on, by label. Null or equal ends are no edges. The
    number of files follows the number of edges.
    """
    ends = edges.select("a", "b")
    if known is not None:
        for c in ("a", "b"):
            ends = ends.join(known.select(F.col("node").alias(c), F.col("label").alias("_" + c)), c, "left")
        ends = ends.select(*(F.coalesce("_" + c, c).alias(c) for c in ("a", "b")))
    e = stored(ends.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _state(e)
    if known is not None and not seen["n"]:
        drop(e)
        return known
    files = lambda state: max(1, -(-state["n"] // HELD))
    e, old = stored(_contracted(e.coalesce(files(seen))), "edges"), e
    seen = _state(e)
    drop(old)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        e, old = stored(_contracted(small.coalesce(files(seen))), "edges"), e
        now = _state(e)
        drop(old)
        if now == seen:
            break
        seen = now
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    if known is None:
        return found
    renamed = known.join(found.select(F.col("node").alias("label"), F.col("label").alias("_new")), "label", "left").select("node", F.coalesce("_new", "label").alias("label"))
    return renamed.unionByName(found.join(known, "node", "left_anti"))
