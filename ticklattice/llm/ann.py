"""Nearest neighbours by inner product: inverted file, product quantisation, exact reranking.

Coarse centroids (about as many as the root of the number of distinct vectors,
MOST_LISTS at most) and the codebooks of residuals' sub-vectors are fitted on about
SAMPLE distinct vectors chosen by a hash, or PER_LIST for each list if that is more.
Every distinct vector is then indexed once: its list is that of the nearest centroid,
its code names the nearest codeword of each sub-vector of its residual, and the length
of what the code leaves over is kept. How many lists a query probes, those with the
largest inner products to their centroids, is measured: as many as find RECALL of the
nearest of sampled vectors among the sample; vectors that cluster need few, vectors
spread evenly many.

Queries go only to the lists they probe. A first round over the nearest few lists
gives each query a score that k vectors reach; the second round, over the others, need
return only what reaches it. In a list, inner products are estimated from the query's
table of sub-vectors against codewords (the query itself is not quantised). Every
vector whose estimate plus the largest possible error (the query's length times that
left over) reaches the score of k vectors is computed exactly in double precision, so
within the probed lists nothing is lost, copies and near copies included. A vector
brings its k + 1 smallest vec_ids (the query's own is left out), of which no more are
needed. Lists are cut into chunks of bounded size, and the queries of a list too, so a
list with a third of all vectors is spread.

Vectors that are null, zero or hold null or non-finite components take no part, nor
do those of another length than the most frequent. Ties go to the smaller vec_id; of
query rows with equal vec_id one is answered, and null is no query; rows with the
query's own vec_id are not its candidates. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored
from .vectors import packed, unpacked, usable

SAMPLE, PER_LIST, MOST_LISTS = 20_000, 40, 4096
RECALL, TRIED = 0.97, 300
SUB, WORDS = 16, 256
#: Best estimates that are computed exactly for a first threshold, as a multiple of k; lists of the first round, as a part.
SHORT, FIRST = 3, 16
#: Vectors and queries of a list that meet in one group.
CHUNK, QUERIES = 1024, 1024


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids (fewer rows than k: these rows) by Lloyd's rounds; a centroid that loses all rows stays."""
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the centroid nearest to each row."""
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096))])


class Index:
    """Centroids and codebooks; sub-vectors are stretches of about dim / SUB components."""

    def __init__(self, x: np.ndarray, lists: int = 128, k: int = 20, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.cuts = np.linspace(0, self.dim, min(SUB, self.dim) + 1).astype(int)
        self.centroids = k_means(x, lists, 10, rng)
        own = self.lists(x)
        rest = x - self.centroids[own]
        self.books = [k_means(rest[:, a:b], WORDS, 8, rng) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.probes = self._measured(x, own, k, rng)

    def _measured(self, x: np.ndarray, own: np.ndarray, k: int, rng: np.random.Generator) -> int:
        """Fewest lists that hold RECALL of the k nearest of TRIED vectors among x, on average."""
        tried = rng.choice(len(x), min(TRIED, len(x)), replace=False)
        score = x[tried] @ x.T
        score[np.arange(len(tried)), tried] = -np.inf
        near = own[np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]]
        order = np.argsort(-(x[tried] @ self.centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        needed = np.sort(np.take_along_axis(place, near, 1).ravel())
        return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1 if len(needed) else 1

    def lists(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        return np.stack([(rest[:, a:b] @ w.T - 0.5 * (w * w).sum(axis=1)).argmax(axis=1) for a, b, w in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists in order of nearness for each query, how many it probes in both rounds, and in the first. Probed lists hold
        more than k vectors if there are so many."""
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        enough = np.minimum((np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1, order.shape[1])
        every = np.maximum(self.probes, enough)
        return order, every, np.maximum(-(-every // FIRST), enough)

    def left_over(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of each vector to what its list and code stand for."""
        rest = x - self.centroids[lists]
        for j, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            rest[:, a:b] -= self.books[j][codes[:, j]]
        return np.sqrt((rest * rest).sum(axis=1))

    def rounding(self) -> float:
        """Bound of an estimate's rounding error in single precision, for a query of length 1."""
        longest = [np.sqrt((w * w).sum(axis=1)).max() for w in (self.centroids, *self.books)]
        return 2e-7 * (len(longest) + 1) * sum(longest)

    def estimates(self, q: np.ndarray, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        out = (q @ self.centroids.T).astype(np.float32)[:, lists]
        for j, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            out += (q[:, a:b] @ self.books[j].T).astype(np.float32)[:, codes[:, j]]
        return out


def fit(vectors: DataFrame, dim: int, n: int, k: int = 20) -> Index | None:
    """vectors: n packed distinct ones."""
    lists = min(MOST_LISTS, max(1, round(n**0.5)))
    u = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, max(SAMPLE, PER_LIST * lists) / max(1, n))
    rows = sorted(bytes(r["v"]) for r in vectors.where(u < share).select("v").collect())
    return Index(unpacked(pa.array(rows, pa.binary()), dim), lists, k) if rows else None


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score for every row of vectors (vec_id, embedding) where is_query holds."""
    spark = vectors.sparkSession
    good = packed(vectors.where(usable("embedding")), "embedding", "vec_id")
    good = stored(good, "vectors")
    dims = good.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["dim"]
    good = good.where(F.col("dim") == dim)
    # a query leaves out one vec_id and needs k rows: k + 1 different vec_ids, each with k rows at most, are enough
    rows = good.groupBy("v", F.coalesce("vec_id", F.lit(-(1 << 63))).alias("id")).agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    distinct = stored(rows.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("x")).select("v", "x.id", "x.times"), "distinct")
    n_distinct = distinct.count()
    index = fit(distinct, dim, n_distinct, k)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = unpacked(b.column("v"), dim)
                lists = index.lists(x)
                codes = index.codes(x, lists)
                more = [pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.left_over(x, lists, codes))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("v", "id", "times")), *more], names=["v", "id", "times", "list", "code", "over"])

    indexed = stored(distinct.mapInArrow(assign, "v binary, id array<long>, times array<long>, list int, code binary, over double"), "indexed")
    list_rows = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows
    sizes = np.zeros(len(index.centroids), np.int64)
    for i, n in list_rows.items():
        sizes[i] = n
    queries = good.where(is_query & F.col("vec_id").isNotNull()).select("vec_id", "v").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stored(queries.withColumn("tau", F.lit(float("-inf"))), "queries")

    def probe_counts(batches):
        n = np.zeros((2, len(sizes)), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                order, every, first = index.probed(unpacked(b.column("v").slice(i, 256), dim), sizes, k)
                at = np.arange(order.shape[1])
                for r, use in enumerate((at < first[:, None], (at >= first[:, None]) & (at < every[:, None]))):
                    n[r] += np.bincount(order[use], minlength=len(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes)), pa.int32()), pa.array(n[0]), pa.array(n[1])], names=["list", "first", "other"])

    def probes(of_first: bool):
        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    order, every, first = index.probed(unpacked(part.column("v"), dim), sizes, k)
                    at = np.arange(order.shape[1])
                    who, place = np.nonzero(at < first[:, None] if of_first else (at >= first[:, None]) & (at < every[:, None]))
                    for lo in range(0, len(who), 10_000):
                        w, p = who[lo : lo + 10_000], place[lo : lo + 10_000]
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(w)) for c in ("vec_id", "v", "tau")), pa.array(order[w, p], pa.int32())], names=["vec_id", "v", "tau", "list"])

        return run

    asked = {r["list"]: (r["a"], r["b"]) for r in queries.mapInArrow(probe_counts, "list int, first long, other long").groupBy("list").agg(F.sum("first").alias("a"), F.sum("other").alias("b")).collect()}
    cuts = [(i, -(-n // CHUNK), *(-(-x // QUERIES) for x in asked.get(i, (0, 0)))) for i, n in sorted(list_rows.items())]
    cuts = F.broadcast(spark.createDataFrame(cuts, "list int, _chunks int, _first int, _other int").coalesce(1))  # a row for each list
    rounding = index.rounding()

    def run(qs: pa.Table, xs: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if qs.num_rows and xs.num_rows:
            q_id, tau = qs.column("vec_id").to_numpy(), qs.column("tau").to_numpy()
            ids, times = xs.column("id").combine_chunks(), xs.column("times").combine_chunks()
            n_ids = ids.value_lengths().to_numpy()
            begin = np.cumsum(n_ids) - n_ids
            ids, times = ids.flatten().to_numpy(), times.flatten().to_numpy()
            only = np.where(n_ids == 1, ids[begin], 0)
            q, x = unpacked(qs.column("v"), dim), unpacked(xs.column("v"), dim)
            lists, over = np.full(len(x), xs.column("list")[0].as_py()), xs.column("over").to_numpy()
            codes = np.frombuffer(b"".join(xs.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            longest = np.sqrt((x * x).sum(axis=1).max())
            for lo in range(0, len(q), 256):
                some, own = q[lo : lo + 256], q_id[lo : lo + 256]
                size = np.sqrt((some * some).sum(axis=1))[:, None]
                may = (n_ids != 1) | (own[:, None] != only)
                near = index.estimates(some, codes, lists)
                few = min(SHORT * k, len(x))
                short = np.argpartition(-np.where(may, near, -np.inf), few - 1, axis=1)[:, :few]
                exact = np.where(np.take_along_axis(may, short, 1), np.einsum("qd,qsd->qs", some, x[short]), -np.inf)
                slack = 1e-12 * size * longest
                reached = np.maximum(tau[lo : lo + 256, None], np.sort(exact, axis=1)[:, -k, None] if exact.shape[1] >= k else -np.inf) - slack
                may &= ~(near + size * (over + rounding) < reached)  # what is not a number stays
                at = np.flatnonzero(may.any(axis=0))
                if not len(at):
                    continue
                score = np.where(may[:, at], some @ x[at].T, -np.inf)
                reached = np.maximum(tau[lo : lo + 256, None], np.partition(score, -k, axis=1)[:, -k, None] if len(at) >= k else -np.inf) - slack
                best = may[:, at] & ~(score < reached)
                for i in range(len(some)):
                    c = at[best[i]]
                    e = np.einsum("sd,d->s", x[c], some[i])
                    # rows of these vectors, the query's own left out
                    n = n_ids[c]
                    place = np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    e = np.repeat(e, n)
                    other = ids[place] != own[i]
                    e, place = e[other], place[other]
                    first = np.lexsort((ids[place], -e))[:k]
                    first = np.repeat(first, times[place[first]])[:k]
                    out["query_id"].append(np.full(len(first), own[i]))
                    out["vec_id"].append(ids[place[first]])
                    out["score"].append(e[first])
        return pa.table({c: pa.array(np.concatenate([np.zeros(0), *v]) if c == "score" else np.concatenate([np.zeros(0, np.int64), *v]), t) for (c, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    keys = ("list", "_chunk", "_part")

    def found_in(of_first: bool, queries: DataFrame) -> DataFrame:
        parts = F.col("_first" if of_first else "_other")
        left = queries.mapInArrow(probes(of_first), "vec_id long, v binary, tau double, list int").join(cuts, "list")
        left = left.withColumn("_part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        right = indexed.join(cuts, "list").where(parts > 0).withColumn("_chunk", F.pmod(F.xxhash64("v"), F.col("_chunks")).cast("int"))
        right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        left, right = left.select(*keys, "vec_id", "v", "tau"), right.select(*keys, "v", "id", "times", "code", "over")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = stored(found_in(True, queries), "first")
    reached = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_tau"))
    queries = queries.join(reached, "vec_id", "left").select("vec_id", "v", F.coalesce("_tau", "tau").alias("tau"))
    found = first.unionByName(found_in(False, queries))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    vec_id = F.when(F.col("vec_id") == -(1 << 63), None).otherwise(F.col("vec_id"))
    return best.select("query_id", "rank", vec_id.alias("vec_id"), "score")


def op_query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
