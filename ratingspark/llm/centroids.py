"""Exact k-means rounds over integer vectors by the threshold algorithm.

For each dimension the centroids' values form a sorted list. From a vector's
value the list is walked outward, nearest value first; each centroid met for
the first time has its exact distance taken. The values last met in all
dimensions form the frontier: no centroid that is still unmet can be nearer
than the sum of the squared frontier distances, so the walk of a vector stops
when that sum strictly exceeds its best exact distance. Strictly, because an
unmet centroid at the same distance could have the smaller number. All vectors
of a batch walk together; those that have stopped leave.

Each round reads the vectors once. A batch sends one row per centroid (count
and componentwise sums); these are added up exactly as decimals. Only the
centroids themselves, ``k`` rows of ``dims`` numbers, come to the driver.

Defined cases: a vector with another number of components, a null, NaN or
infinite component, or a null vector, is left out; a component beyond ``BOUND``
after scaling counts as ``BOUND`` of its sign, so that every distance is a
long; a null id is hashed as the text ``null`` and keeps its row; repeated rows
are vectors of their own; with fewer vectors than ``k`` each starts a centroid;
other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.llm.common import released, written

#: Largest absolute integer component: 64 squared differences of twice this size fit a long.
BOUND = 1 << 27
#: Vectors that walk together.
ROWS = 4096


def quantised(values: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, integers)``: the rows of a list column that are kept, and
    their components ``floor(scale * x)`` as a matrix."""
    sizes = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dims)
    flat = values.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    whole = np.isfinite(x).all(axis=1)
    scaled = np.clip(np.floor(x[whole] * scale), -BOUND, BOUND)
    return at[whole], scaled.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(numbers, squared distances, distances taken)`` of the nearest centroid
    of each row of ``x``; ties go to the smaller number."""
    n, k, dims = len(x), len(centroids), x.shape[1]
    number, best = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max)
    order = np.argsort(centroids, axis=0, kind="stable")
    ends = np.full((1, dims), np.iinfo(np.int64).max // 4)
    # the sorted lists between two ends that are never nearer than a value
    lists = np.concatenate([-ends, np.take_along_axis(centroids, order, 0), ends])
    order = np.concatenate([np.zeros((1, dims), np.int64), order, np.zeros((1, dims), np.int64)])
    column = np.arange(dims)
    walk = np.arange(n)
    right = np.empty((n, dims), np.int64)
    for d in range(dims):
        right[:, d] = np.searchsorted(lists[:, d], x[:, d])
    left, seen, taken = right - 1, np.zeros((n, k), bool), 0
    for _ in range(k):
        at = x[walk]
        below, above = at - lists[left, column], lists[right, column] - at
        down = below <= above
        met = np.where(down, order[left, column], order[right, column])
        frontier = np.where(down, below, above)
        left -= down
        right += ~down
        fresh = np.zeros_like(seen)
        fresh[np.arange(len(walk))[:, None], met] = True
        fresh &= ~seen
        seen |= fresh
        for c in range(k):
            rows = np.flatnonzero(fresh[:, c])
            if len(rows):
                taken += len(rows)
                who, apart = walk[rows], at[rows] - centroids[c]
                distance = np.einsum("ij,ij->i", apart, apart)
                nearer = (distance < best[who]) | ((distance == best[who]) & (c < number[who]))
                best[who[nearer]], number[who[nearer]] = distance[nearer], c
        on = np.einsum("ij,ij->i", frontier, frontier) <= best[walk]
        if not on.any():
            break
        walk, left, right, seen = walk[on], left[on], right[on], seen[on]
    return number, best, taken


def _first(vectors: DataFrame, k: int, dims: int, scale: int) -> np.ndarray:
    """The starting centroids: least hash of ``1:<id>`` first, equal ids by
    their components."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = quantised(batch.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(np.arange(0, len(x) * dims + 1, dims, dtype=np.int32),
                                                         pa.array(x.ravel()))], names=["id", "x"])
    schema = T.StructType([T.StructField("id", vectors.schema[0].dataType), T.StructField("x", T.ArrayType(T.LongType()))])
    text = F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    least = (vectors.mapInArrow(keep, schema).select(F.sha2(text.cast("binary"), 256).alias("hash"), "x")
             .orderBy("hash", "x").limit(k).collect())
    return np.array([r["x"] for r in least], np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray, dims: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                _, x = quantised(batch.column(1).slice(start, ROWS), dims, scale)
                if len(x):
                    number, _, _ = nearest(x, centroids)
                    for c in np.unique(number).tolist():
                        mine = x[number == c]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([c] * dims, pa.int32()), pa.array(range(dims), pa.int32()),
                             pa.array(mine.sum(axis=0)), pa.array([len(mine)] * dims, pa.int64())],
                            names=["cluster", "dim", "total", "n"])
    return run


def _assigned(centroids: np.ndarray, dims: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                at, x = quantised(part.column(1), dims, scale)
                if len(x):
                    number, best, _ = nearest(x, centroids)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(best)],
                        names=["id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3,
            dims: int = 64, scale: int = 64) -> DataFrame:
    """One row per kept vector: id, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("x"))
    centroids = _first(rows, k, dims, scale)
    schema = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    if not len(centroids):
        return (spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
                .selectExpr("*", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256"))
    for _ in range(rounds):
        added = (rows.mapInArrow(released(_sums(centroids, dims, scale)), "cluster int, dim int, total long, n long")
                 .groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"),
                                                F.sum("n").alias("n")).collect())
        moved = centroids.copy()
        for r in added:
            moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        centroids = moved
    done = written(rows.mapInArrow(released(_assigned(centroids, dims, scale)), schema), "centroids")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame([(c, d) for c, d in enumerate(digests)], "cluster int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    per_cluster = done.groupBy("cluster").agg(exact.cast("long").alias("cluster_inertia"))
    whole = done.agg(exact.cast("long").alias("inertia"))
    # at most k rows and one row
    per_cluster = per_cluster.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(whole))
    return (done.join(F.broadcast(per_cluster), "cluster")
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """The same by exhaustive distances, in DuckDB SQL."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = {dims}
        AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {dims})""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM
        (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, x FROM kept ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT v.vec_id, v.x, min({{'d': {apart}, 'c': c.c}}) AS best
            FROM (SELECT row_number() OVER () AS n, * FROM kept) v CROSS JOIN c{r} c GROUP BY v.n, v.vec_id, v.x)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT c, list(m ORDER BY i) AS x FROM
                (SELECT best.c AS c, i, CAST(floor(sum(CAST(x[i] AS HUGEINT)) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
                 FROM a{r}, unnest(range(1, {dims + 1})) t(i) GROUP BY best.c, i) GROUP BY c)""")
            parts.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
    CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c""")


ORACLE = _oracle()
