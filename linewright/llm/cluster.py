"""Centroid clustering of integer vectors, exact, with Ptolemaic pivots.

For a vector x, a centroid c and pivots p and q, Ptolemy's inequality gives

    d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|

The pivots are fixed: a vector's distances to them are computed once and kept in
a table with it; a round only computes the centroids' distances to them. The
largest bound over all pairs of pivots, rounded down beyond what floating point
can be wrong by, says which centroids can be nearest; those left are checked with
integers. A round's result is one row of sums for each cluster and task, so only
clusters x components numbers are shuffled and reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import apart, settle

#: Vectors compared at a time.
BLOCK_ROWS = 4096
#: Components beyond it have squared distances that a long can't hold.
MOST_COMPONENT = 1 << 27
#: Relative error allowed for in bounds; a double's is 2**-53 a step.
SLACK = 2.0**-44


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def far_apart(vectors: np.ndarray, most: int) -> np.ndarray:
    """Pivots: the first vector, then each time the one farthest from those chosen (first of equals); no two alike."""
    chosen = [0]
    near = squared(vectors, vectors[:1])
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(vectors, vectors[chosen[-1:]]))
    return vectors[chosen]


def distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(vectors, p[None]) for p in points], axis=1).astype(np.float64))


def bounds(of_vectors: np.ndarray, of_centroids: np.ndarray, of_pivots: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances (vectors x centroids) from distances to the pivots, rounded down."""
    best = np.zeros((len(of_vectors), len(of_centroids)))
    for p in range(len(of_pivots)):
        for q in range(p):
            one, other = np.outer(of_vectors[:, p], of_centroids[:, q]), np.outer(of_vectors[:, q], of_centroids[:, p])
            low = np.abs(one - other) - SLACK * (one + other)
            np.maximum(best, low * ((1 - SLACK) / of_pivots[p, q]), out=best)
    return np.square(best) * (1 - SLACK)


def nearest(vectors: np.ndarray, of_vectors: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray, of_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact checks made); of equals the smaller number."""
    low = bounds(of_vectors, of_centroids, of_pivots)
    cluster = low.argmin(axis=1)
    best = squared(vectors, centroids[cluster])
    first, checks = cluster.copy(), len(vectors)
    for k in range(len(centroids)):
        rows = np.flatnonzero((low[:, k] <= best) & (first != k))
        d = squared(vectors[rows], centroids[k : k + 1])
        better = (d < best[rows]) | ((d == best[rows]) & (k < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = k, d[better]
        checks += len(rows)
    return cluster, best, checks


def whole_vectors(table: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors with exactly ``size`` finite components, each floor(scale * x)."""
    v = F.col(vector_col)
    fits = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return table.filter(v.isNotNull() & fits).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, size: int, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), size).astype(kind, copy=False)


class Clusters:
    """Centroids with their distances to the pivots, for tasks."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, self.pivots = centroids, pivots
        self.of_centroids, self.of_pivots = distances(centroids, pivots), distances(pivots, pivots)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(ids, vectors, clusters, squared distances, exact checks) of each block."""
        size, pivots = self.centroids.shape[1], len(self.pivots)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors = _matrix(part.column("v"), size)
                yield part.column("id"), vectors, *nearest(vectors, _matrix(part.column("d"), pivots, np.float64), self.centroids, self.of_centroids, self.of_pivots)


def prepared(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, d): the vectors with their distances to the pivots."""
    size = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                held = _matrix(part.column("v"), size)
                if len(held) and max(int(held.max()), -int(held.min())) > MOST_COMPONENT:
                    raise ValueError(f"a component beyond {MOST_COMPONENT}: squared distances would not fit a long")
                d = distances(held, pivots)
                offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * len(pivots))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], ["id", "v", "d"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, v array<long>, d array<double>")


def sums(table: DataFrame, clusters: Clusters) -> DataFrame:
    """(cluster, n, total): a row for each cluster that a task saw; totals are exact whatever the number of rows."""
    k, size = clusters.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for _, vectors, found, _, _ in clusters.blocks(batches):
            n += np.bincount(found, minlength=k)
            np.add.at(total, found, vectors)
        seen = np.flatnonzero(n)
        offsets = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.ListArray.from_arrays(offsets, pa.array(total[seen].ravel()))], ["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    total = F.array(*(F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(size)))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("total"))


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2, pivots: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``size`` components, none null or not finite; null
    vectors and all others go. Centroids start as the vectors whose ids' hashes are
    least (a null id is hashed as an empty one; of equal ids the vector that sorts
    first); with fewer than ``k`` vectors there are fewer centroids. A vector goes to
    the nearest centroid, of equals the smaller number; then each centroid moves to
    the floor of its vectors' mean, and an empty one stays. Repeated rows are vectors
    each; an empty table stays empty; other columns are ignored. Components beyond
    2**27 after scaling are an error, as squared distances would not fit a long.
    """
    spark = table.sparkSession
    whole = whole_vectors(table, size, scale, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    starts = np.array([r.v for r in whole.orderBy(order, "v").limit(k).collect()], dtype=np.int64)  # k rows
    if not len(starts):
        return spark.createDataFrame([], f"`{id_col}` {whole.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    fixed = far_apart(starts, pivots)
    vectors = settle(prepared(whole, fixed), "vectors")
    centroids = starts
    for _ in range(rounds):
        moved = centroids.copy()
        for r in sums(vectors, Clusters(centroids, fixed)).collect():  # k rows at most
            moved[r.cluster] = [int(t) // r.n for t in r.total]
        if (moved == centroids).all():
            break  # every later round would give the same
        centroids = moved

    held = Clusters(centroids, fixed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found, distance, checks in held.blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    assigned = settle(vectors.mapInArrow(assign, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"), "assigned")
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).collect()  # k rows at most
    inertia = sum(int(r.t) for r in totals)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(r.cluster, int(r.t), inertia, digest[r.cluster]) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> str:
    """DuckDB SQL for ``cluster`` by plain comparison with every centroid."""
    distance = "list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"whole as materialized (select row_number() over (order by vec_id, embedding) as row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || coalesce(vec_id::varchar, '')), v) - 1 as k, v as c from whole qualify k < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select x.row, arg_min(c.k, ({distance}, c.k)) as k, min({distance}) as d from whole x cross join c{r} c group by x.row)")
        if r < rounds:
            steps += [
                f"s{r} as (select a.k, i.i, sum(x.v[i.i]) as s, count(*) as n from a{r} a join whole x using (row) cross join (select unnest(range(1, {size + 1})) as i) i group by all)",
                f"m{r} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from s{r} group by k)",
                f"c{r + 1} as materialized (select c.k, coalesce(m.m, c.c) as c from c{r} c left join m{r} m using (k))",
            ]
    return f"""
with {", ".join(steps)},
totals as (select k, sum(d)::bigint as t from a{rounds} group by k)
select x.vec_id, a.k::int as "cluster", a.d::bigint as distance, t.t as cluster_inertia, (select sum(t)::bigint from totals) as inertia,
       sha256(array_to_string(c.c, ',')) as centroid_sha256
from whole x join a{rounds} a using (row) join totals t on t.k = a.k join c{rounds} c on c.k = a.k
"""
