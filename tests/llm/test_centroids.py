import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """Exhaustive distances in plain integers."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.BOUND, min(centroids.BOUND, math.floor(scale * float(np.float32(x))))) for x in v]))
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(means)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for n in range(len(means)):
            mine = [v for (_, v), (_, m) in zip(kept, at) if m == n]
            if mine:
                means[n] = [sum(column) // len(mine) for column in zip(*mine)]
    at = assign()
    of = {n: sum(d for d, m in at if m == n) for _, n in at}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    order = lambda r: (r[0] is None, r)
    return sorted([(i, n, d, of[n], sum(of.values()), digest[n]) for (i, _), (d, n) in zip(kept, at)], key=order)


def ran(df, **kw):
    return sorted([tuple(r) for r in centroids.cluster(df, **kw).collect()], key=lambda r: (r[0] is None, r))


def test_equal_to_exhaustive_search_with_ties_and_repeats(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 64) / 8], 0) for i in range(300)]
    rows += [(7, rows[7][1], 0)] * 5 + [(1000 + i, rows[3][1], 0) for i in range(200)]  # one value holds a third
    rows += [(5000, [0.0] * 63, 0), (5001, None, 0), (5002, [None] + [0.0] * 63, 0), (5003, [math.nan] * 64, 0),
             (5004, [math.inf] * 64, 0), (5005, [], 0), (None, rows[9][1], 0), (5006, [3e38, -3e38] * 32, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ran(df) == brute(rows)
    assert ran(df.repartition(7)) == ran(df)


def test_other_sizes_and_clashing_columns(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.normal(size=3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("id", "x", "cluster", "distance", "total", "n")])
    assert ran(df, k=5, rounds=4, dims=3, scale=10) == brute(rows, 5, 4, 3, 10)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5] * 64, 0), (2, [-0.5] * 64, 0)]
    assert ran(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert ran(spark.createDataFrame([], SCHEMA)) == []
    assert ran(spark.createDataFrame([(1, None, 0)], SCHEMA)) == []


def test_walk_stops_early_and_keeps_ties():
    draw = np.random.default_rng(3)
    means = draw.integers(-500, 500, (64, 2))
    x = means[draw.integers(0, 64, 500)] + draw.integers(-3, 4, (500, 2))
    number, best, taken = centroids.nearest(x, means)
    every = ((x[:, None] - means[None]) ** 2).sum(-1)
    assert (best == every.min(1)).all() and (number == every.argmin(1)).all()
    assert taken < every.size / 4
    twice = np.array([[4, 4], [0, 0], [0, 0]])
    assert centroids.nearest(np.array([[0, 0], [2, 2]]), twice)[0].tolist() == [1, 0]


@pytest.mark.parametrize("dims", [1, 64])
def test_bound_keeps_distances_in_range(dims):
    far = np.full((1, dims), centroids.BOUND)
    assert centroids.nearest(far, -far)[1][0] == dims * (2 * centroids.BOUND) ** 2
