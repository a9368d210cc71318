"""The neighbour join (J8) and resampling (M5) against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingspark.operators import neighbours as nb
from ratingspark.operators import resample as rs


def table(spark, x, labels, keys=None):
    keys = keys or [f"k{i:05d}" for i in range(len(x))]
    return spark.createDataFrame([(k, c, [float(v) for v in r]) for k, c, r in zip(keys, labels, x)],
                                 "key string, label string, vector array<double>"), keys


def brute(x, labels, keys, k):
    out = set()
    for i, key in enumerate(keys):
        d = sorted((float(sum((a - b) ** 2 for a, b in zip(x[i], x[j]))), keys[j]) for j in range(len(x)) if j != i and labels[j] == labels[i])
        out |= {(key, r + 1, n, round(v ** 0.5, 9)) for r, (v, n) in enumerate(d[:k])}
    return out


def got(df):
    return {(r.key, r["rank"], r.neighbour, round(r.distance, 9)) for r in df.collect()}


def test_nearest_equals_all_pairs_with_ties_duplicates_and_a_huge_class(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(0, 6, (420, 3))  # many ties
    x[100:160] = x[7]  # one vector holds a part of the class
    labels = ["big"] * 330 + ["mid"] * 80 + ["few"] * 3 + ["one"] + ["two"] * 6
    df, keys = table(spark, x, labels)
    want = brute(x, labels, keys, 5)
    assert got(nb.nearest(df, 5, cell=40)) == want  # many cells, split ones
    assert got(nb.nearest(df.repartition(5), 5, cell=40, pivots=2)) == want  # cells of several chunks
    assert got(nb.nearest(df, 5)) == want  # a single cell each


def test_nearest_of_all_rows_and_edge_rows(spark):
    draw = np.random.default_rng(2)
    x, labels = draw.normal(size=(150, 4)), ["a", "b", "c"] * 50
    df, keys = table(spark, x, labels)
    assert got(nb.nearest(df, 1, label=None, cell=30)) == brute(x, [""] * 150, keys, 1)
    odd = spark.createDataFrame([("n1", None, [0.0] * 4), ("n2", "a", None), ("n3", "a", [None, 0.0, 0.0, 0.0])], df.schema)
    assert got(nb.nearest(df.unionByName(odd), 2, cell=30)) == brute(x, labels, keys, 2)
    assert got(nb.nearest(df.where("false"), 2)) == set()


def test_bounds_prune_and_rows_of_a_task_stay_bounded(spark, monkeypatch):
    """Separate clusters: few chunks are visited, and none grows with its class."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 2)) * 100
    x = np.concatenate([c + draw.normal(size=(60, 2)) for c in centres])
    df, _ = table(spark, x, ["a"] * len(x))
    written = {}
    keep = nb.materialize
    monkeypatch.setattr(nb, "materialize", lambda d, name: written.setdefault(name, keep(d, name)))
    nb.nearest(df, 3, cell=60).count()
    assert written["neighbour-visits"].count() < 4 * len(x)
    assert written["neighbour-chunks"].groupBy("class", "cell", "chunk").count().agg(F.max("count")).first()[0] < 120


def sample(spark, sizes):
    draw = np.random.default_rng(4)
    rows = [(f"{c}{i:03d}", c, 1.5, *[float(v) for v in draw.normal(size=3) + k]) for k, (c, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "id string, grade string, w double, x double, y double, z double")


def test_smote_fills_classes_between_neighbours(spark):
    df = sample(spark, {"a": 40, "b": 9, "c": 25}).withColumn("x", F.when(F.col("id") != "b003", F.col("x")))  # a null counts as 0
    made = rs.synthetic(df, "id", "grade", ["x", "y", "z"])
    rows = made.collect()
    assert {c: sum(r.grade == c for r in rows) for c in "abc"} == {"a": 0, "b": 31, "c": 15}
    points = {r.id: np.array([r.x or 0.0, r.y, r.z]) for r in df.collect()}
    for r in rows:  # on the line from the base row to one of its five neighbours
        base, at = points[r.id.split("~")[0]], np.array([r.x, r.y, r.z])
        others = sorted((v for i, v in points.items() if i[0] == r.grade and i != r.id.split("~")[0]), key=lambda v: ((v - base) ** 2).sum())[:5]
        assert any(np.linalg.norm(at - base) + np.linalg.norm(at - o) - np.linalg.norm(o - base) < 1e-9 for o in others)
    again = rs.synthetic(df.repartition(7), "id", "grade", ["x", "y", "z"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("sizes", [{"a": 9, "b": 2}, {"a": 10, "b": 8}, {"a": 30, "b": 1}])
def test_trigger(spark, sizes):
    """Too few rows, no rare class, a class of one row: nothing changes."""
    df = sample(spark, sizes)
    out = rs.smote_tomek(df, "id", "grade", ["x", "y", "z"], weight="w")
    assert out.count() == sum(sizes.values()) and out.where("is_synthetic or w is null").count() == 0


def test_plan():
    assert rs.plan({"a": 40, "b": 9, "c": 25}) == (5, {"b": 31, "c": 15})
    assert rs.plan({"a": 40, "b": 3}) == (2, {"b": 37}) and rs.plan({"a": 40, "b": 2}) == (1, {"b": 38})


def test_tomek_links_and_weights(spark):
    rows = [("a1", "a", 0.0), ("b1", "b", 0.1), ("a2", "a", 5.0), ("a3", "a", 5.1), ("b2", "b", 9.0), ("b3", "b", 9.1), ("a4", "a", 9.15)]
    df = spark.createDataFrame(rows, "id string, grade string, x double")
    assert {r.id for r in rs.tomek_links(df, "id", "grade", ["x"]).collect()} == {"a1", "b1", "a4", "b3"}
    out = rs.smote_tomek(sample(spark, {"a": 30, "b": 6}), "id", "grade", ["x", "y", "z"], weight="w")
    assert out.where("w is not null").count() == 0 and 0 < out.where("is_synthetic").count() <= 24


def test_visits_do_not_grow_with_copies_nor_with_the_rows_of_a_cell(spark, monkeypatch):
    """Copies are searched once, and a large class has more cells instead of more chunks a cell."""
    draw = np.random.default_rng(5)
    x = np.concatenate([np.ones((600, 2)), draw.normal(size=(900, 2)) * 50])
    df, keys = table(spark, x, ["a"] * len(x))
    written = {}
    keep = nb.materialize
    monkeypatch.setattr(nb, "materialize", lambda d, name: written.setdefault(name, keep(d, name)))
    assert got(nb.nearest(df, 3, cell=60)) == brute(x, ["a"] * len(x), keys, 3)
    assert written["neighbour-visits"].count() < len(x)


def test_search_of_leaves_equals_all_pairs():
    """Far from zero the matrix product is rough; the distances are exact all the same."""
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(size=(300, 5)) + 1e6, draw.integers(0, 3, (300, 5)) + 1e6])
    number = np.arange(600)
    found, place = nb.best(x, number, np.full(600, np.inf), x, number, 4, leaf=32)
    for n in range(600):
        d = sum((x[n, f] - x[:, f]) ** 2 for f in range(5))
        order = [j for j in np.lexsort((number, d)) if j != n][:4]
        assert place[n].tolist() == order and found[n].tolist() == d[order].tolist()
