"""Centroid clustering (k-means) on integer vectors with grouped bounds.

Each vector keeps an upper bound of its distance to its own centroid and, for each
group of centroids, one lower bound of its distance to the others of that group. The
groups are made once, by clustering the first centroids. When centroids have moved,
bounds are loosened by how far; a vector whose lower bounds all exceed its upper bound
keeps its centroid without a distance; of the others only groups whose bound does not
exceed it are looked at, and in these only centroids that could still be nearer, by
exact distances. Bounds are floats rounded to the safe side, distances and means exact
integers, so the result is that of comparing all.

A round is one pass over a table of vectors and their bounds in the shared folder: it
writes the next one, with a row of sums for each task and cluster, which executors add
up; the driver sees k centroids. The table before is deleted then. Nothing is grouped
by vector, so copies of a vector are as good as others.

Vectors that are null, have another number of components, or a null or non-finite one
are left out. Rows stay one to one: equal ids or vectors take part as often as they
stand there. Starts with equal ids are told apart by their components; a null id hashes
as null and starts last. With fewer vectors than k there are as many centroids; no
vectors, no rows. Components beyond 2^62 count as 2^62, and a distance or inertia
that exceeds a long is given as the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, stored

LARGEST = (1 << 63) - 1
_FAR = 1 << 62
#: Components below this in size give squared distances that fit 64 bits for up to 64 components.
_PLAIN = 1 << 27
#: A bound is moved by this share of itself to its safe side: far more than rounding can do to it.
_EPS = 1e-12
#: Distances held at once for a batch.
_CELLS = 1 << 22
_STATE = "vec_id long, v binary, cluster int, upper double, lower binary, near decimal(38,0), scans long, total array<decimal(38,0)>, n long"
_WHOLE = pa.decimal128(38, 0)
_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary()), ("near", _WHOLE), ("scans", pa.int64()), ("total", pa.list_(_WHOLE)), ("n", pa.int64())]
)


@dataclass
class Clustering:
    """vectors: vec_id, cluster, distance (decimal). centroids: k lists of integers. scans: exact distances a round took."""

    vectors: DataFrame
    centroids: list[list[int]]
    groups: list[int] = field(default_factory=list)
    scans: list[int] = field(default_factory=list)


def integers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, as bytes of 32-bit integers, or 64-bit ones if one does not fit."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            with np.errstate(over="ignore"):
                rows = np.floor(np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, dim) * scale)
            small = np.abs(rows).max(axis=1, initial=0) < (1 << 31)
            rows = np.where(np.abs(rows) >= _FAR, 0, rows).astype(np.int64) + np.where(rows >= _FAR, _FAR, 0) - np.where(rows <= -_FAR, _FAR, 0)
            v = [(r.astype("<i4") if s else r.astype("<i8")).tobytes() for r, s in zip(rows, small, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(v, pa.binary())], names=["vec_id", "v"])

    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary")


def _matrix(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of integers: int64 if distances between them fit, else Python's integers."""
    if all(len(x) == 4 * dim for x in data):
        m = np.frombuffer(b"".join(data), "<i4").reshape(-1, dim).astype(np.int64)
    else:
        m = np.array([np.frombuffer(x, "<i4" if len(x) == 4 * dim else "<i8").astype(np.int64) for x in data]).reshape(-1, dim)
    return m if np.abs(m).max(initial=0) < _PLAIN and dim <= 64 else m.astype(object)


def _squared(rows: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances."""
    if rows.dtype != object and max(map(abs, centroid), default=0) < _PLAIN:
        d = rows - np.array(centroid, np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = rows.astype(object) - np.array(centroid, object)
    return (d * d).sum(axis=1) if len(d) else np.zeros(0, object)


def _above(squared) -> np.ndarray:
    return np.sqrt(np.asarray(squared, np.float64)) * (1 + _EPS)


def _below(squared) -> np.ndarray:
    return np.sqrt(np.asarray(squared, np.float64)) * (1 - _EPS)


def grouped(centroids: list[list[int]], groups: int, rounds: int = 5) -> list[int]:
    """The group of each centroid, from a few rounds of clustering them; groups without centroids are left out."""
    points = np.array(centroids, np.float64)
    means, own = points[:groups].copy(), np.zeros(len(points), int)
    for _ in range(rounds):
        own = ((points[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in set(own):
            means[g] = points[own == g].mean(axis=0)
    names = {g: i for i, g in enumerate(sorted(set(own.tolist())))}
    return [names[g] for g in own.tolist()]


def assign(rows: np.ndarray, centroids: list[list[int]], groups: np.ndarray, own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, its bounds, and how many distances were computed. own: the centroids of the round
    before (None in the first), whose bounds are upper and lower (a column a group); moved: how far each centroid has moved."""
    n, k, m = len(rows), len(centroids), int(groups.max()) + 1
    scans = 0
    if own is None:
        near = np.full((n, k), np.inf)
        best, own = None, np.zeros(n, np.int64)
        for c in range(k):
            d = _squared(rows, centroids[c])
            scans += n
            near[:, c] = _below(d)
            if best is None:
                best = d.copy()
            else:
                closer = np.asarray(d < best, bool)
                best[closer], own[closer] = d[closer], c
        upper = _above(best) if k else np.zeros(n)
    else:
        most = np.array([moved[groups == g].max() for g in range(m)])
        upper = (upper + moved[own]) * (1 + _EPS)
        loose = lower
        lower = lower - most[None] - _EPS * (lower + most[None])
        lower[np.isinf(loose)] = np.inf
        left = np.flatnonzero(lower.min(axis=1) <= upper)
        best = np.zeros(n, rows.dtype)
        if len(left):  # the bound that has been loosened every round is drawn tight once
            for c in np.unique(own[left]):
                at = left[own[left] == c]
                best[at] = _squared(rows[at], centroids[c])
                scans += len(at)
            upper[left] = _above(best[left])
            left = left[lower[left].min(axis=1) <= upper[left]]
        if not len(left):
            return own, upper, lower, scans
        was, own = own, own.copy()
        near = np.full((len(left), k), np.inf)
        reach, mine = np.asarray(best[left]), was[left]
        look = lower[left] <= upper[left][:, None]  # groups to look at
        for c in range(k):
            g = groups[c]
            # a bound of this centroid alone: the group's of the round before, less its own move
            alone = loose[left, g] - moved[c] - _EPS * (np.where(np.isinf(loose[left, g]), 0, loose[left, g]) + moved[c])
            near[:, c] = np.where(look[:, g], alone, lower[left, g])
            self = mine == c
            near[self, c] = _below(reach[self])
        now = reach.copy()
        for c in range(k):
            at = np.flatnonzero(look[:, groups[c]] & (mine != c) & (near[:, c] <= _above(now)))
            if not len(at):
                continue
            d = _squared(rows[left[at]], centroids[c])
            scans += len(at)
            near[at, c] = _below(d)
            closer = np.asarray((d < now[at]) | ((d == now[at]) & (c < own[left[at]])), bool)
            now[at[closer]], own[left[at[closer]]] = d[closer], c
        upper[left] = _above(now)
        near[np.arange(len(left)), own[left]] = np.inf
        for g in range(m):
            lower[left, g] = near[:, groups == g].min(axis=1)
        return own, upper, lower, scans
    near[np.arange(n), own] = np.inf
    lower = np.stack([near[:, groups == g].min(axis=1) for g in range(m)], axis=1) if n else np.zeros((0, m))
    return own, upper, lower, scans


def _pass(table: DataFrame, centroids: list[list[int]], groups: list[int], moved: list[float] | None, dim: int, last: bool) -> DataFrame:
    """One round over the table; with `last` the distances to the own centroid go along instead of sums."""
    k, group = len(centroids), np.array(groups)
    step = max(1, _CELLS // max(k, dim))

    def batch(size: int, /, **columns) -> pa.RecordBatch:
        """Rows of the table; columns that are not given are null."""
        return pa.RecordBatch.from_arrays([x if isinstance(x := columns.get(f.name), pa.Array) else pa.nulls(size, f.type) if x is None else pa.array(x, f.type) for f in _ARROW], schema=_ARROW)

    def run(batches):
        totals, counts, scans = [[0] * dim for _ in range(k)], [0] * k, 0
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                data = b.column("v").to_pylist()
                rows = _matrix(data, dim)
                own = upper = lower = None
                if moved is not None:
                    own = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                    upper = b.column("upper").to_numpy(zero_copy_only=False).copy()
                    lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float64).reshape(len(rows), -1).copy()
                own, upper, lower, used = assign(rows, centroids, group, own, upper, lower, np.array(moved if moved is not None else [0.0] * k))
                scans += used
                near = [None] * len(rows)
                if last:
                    near = np.zeros(len(rows), object)
                    for c in np.unique(own):
                        near[own == c] = _squared(rows[own == c], centroids[c]).astype(object)
                    near = [int(x) for x in near]
                else:
                    for c in np.unique(own).tolist():
                        part = rows[own == c]
                        totals[c] = [x + int(y) for x, y in zip(totals[c], part.sum(axis=0), strict=True)]
                        counts[c] += len(part)
                yield batch(len(rows), vec_id=b.column("vec_id"), v=b.column("v"), cluster=own, upper=upper, lower=[x.tobytes() for x in lower], near=near)
        own = [c for c in range(k) if counts[c] or not c]
        yield batch(len(own), cluster=own, scans=[scans if not c else 0 for c in own], total=[totals[c] for c in own], n=[counts[c] for c in own])

    return stored(table.where("v is not null").mapInArrow(run, _STATE), "clustered")


def _added(table: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int], int]:
    """Sums and counts by cluster, added up by executors, and the distances computed."""
    own = table.where("n is not null")
    sums, counts, scans = [[0] * dim for _ in range(k)], [0] * k, 0
    for c, i, x in own.select("cluster", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("col")).collect():
        sums[c][i] = int(x)
    for c, n, s in own.groupBy("cluster").agg(F.sum("n"), F.sum("scans")).collect():
        counts[c], scans = n, scans + s
    return sums, counts, scans


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, groups: int | None = None) -> Clustering:
    """Clusters `vectors` (vec_id, embedding). k and the groups (a centroid in four, if not given) bound what the driver holds:
    k x dim integers. The first centroids are the k vectors with the smallest SHA-256 of `seed:vec_id`."""
    table = stored(integers(vectors, dim, scale), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = [[int(x) for x in _matrix([bytes(r[0])], dim)[0]] for r in first]
    if not centroids:
        return Clustering(table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("decimal(38,0)").alias("distance")), [])
    k = len(centroids)
    own = grouped(centroids, min(k, groups or math.ceil(k / 4)))
    out, moved = Clustering(table, centroids, own), None
    for _ in range(rounds):
        new = _pass(table, centroids, own, moved, dim, False)
        drop(table)
        table = new
        sums, counts, scans = _added(table, k, dim)
        out.scans.append(scans)
        was, centroids = centroids, [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
        moved = [math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) * (1 + _EPS) for a, b in zip(was, centroids, strict=True)]
    new = _pass(table, centroids, own, moved, dim, True)
    drop(table)
    out.scans.append(new.where("n is not null").agg(F.sum("scans")).first()[0] or 0)
    out.vectors, out.centroids = new.where("n is null").select("vec_id", "cluster", F.col("near").alias("distance")), centroids
    return out


def op_query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = cluster(vectors)
    long = lambda c: F.least(F.col(c), F.lit(LARGEST)).cast("long")
    sums = dict(found.vectors.groupBy("cluster").agg(F.sum("distance")).collect()) if found.centroids else {}
    name = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    few = [(c, sums.get(c, 0), sum(sums.values()), name(x)) for c, x in enumerate(found.centroids)]
    of = spark.createDataFrame(few, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")  # k rows
    out = found.vectors.join(F.broadcast(of), "cluster")
    return out.select("vec_id", "cluster", long("distance").alias("distance"), long("cluster_inertia").alias("cluster_inertia"), long("inertia").alias("inertia"), "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rows in DuckDB's SQL over a view named embeddings: all distances in every round."""
    steps = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as hugeint)) as v from embeddings
        where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})""",
        f"""c0 as materialized (select row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar)) nulls last, v) - 1 as c, v from v
        order by sha256('{seed}:' || cast(vec_id as varchar)) nulls last, v limit {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select v.r, v.vec_id, v.v, unnest(min({{'d': list_sum(list_transform(list_zip(v.v, n.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': n.c}})) from v, c{i} n group by v.r, v.vec_id, v.v)""")
        if i < rounds:
            steps.append(f"""s{i} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{i}) group by c, i)""")
            steps.append(f"""c{i + 1} as materialized (select o.c, coalesce(m.v, o.v) as v from c{i} o left join
            (select c, list(cast((s - ((s % n) + n) % n) as hugeint) // n order by i) as v from s{i} group by c) m on m.c = o.c)""")
    return f"""with {", ".join(steps)}
    select a.vec_id, cast(a.c as integer) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
           cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(n.v, ',')) as centroid_sha256
    from a{rounds} a join c{rounds} n on n.c = a.c"""


SQL = _sql()
