import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ratingspark.operators import quantiles as qt


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, a double, b double")


def check(df, pdf, probabilities, by):
    got = {(r.g if by else None, r.feature, r.k): r.value
           for r in qt.exact_quantiles(df, ["a", "b"], probabilities, by).collect()}
    groups = pdf[pdf.g.notna()].groupby("g") if by else [(None, pdf)]
    want = {(g, c, k): np.quantile(x[c].dropna(), p) for g, x in groups for c in "ab" if x[c].notna().any()
            for k, p in enumerate(probabilities)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


@pytest.mark.parametrize("by", [None, "g"])
def test_matches_numpy(spark, by):
    rng = np.random.default_rng(1)
    n = 60_000  # the sketch's brackets do not hold all values
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", None], n, p=[0.9, 0.05, 0.05]),
                        "a": np.where(rng.random(n) < 0.3, 0.0, rng.normal(size=n)), "b": rng.integers(0, 5, n) * 1.0})
    pdf.loc[rng.random(n) < 0.1, "a"] = None
    check(frame(spark, pdf), pdf, [0.0, 0.25, 0.5, 0.75, 0.999, 1.0], by)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["x", "y"]), st.one_of(st.none(), st.integers(-3, 3))), max_size=12))
def test_small_groups(spark, rows):
    pdf = pd.DataFrame({"g": [r[0] for r in rows], "a": [r[1] for r in rows], "b": None}, dtype=object)
    pdf[["a", "b"]] = pdf[["a", "b"]].astype(float)
    check(frame(spark, pdf), pdf, [0.25, 0.5, 0.75], "g")


def test_wide_form_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, a double, b double")
    row = qt.wide_quantiles(df, {"m": ("a", 0.5)}, counts={"n": "a"}).collect()
    assert [(r.m, r.n) for r in row] == [(None, 0)]
    assert qt.wide_quantiles(df, {"m": ("a", 0.5)}, "g").count() == 0


def test_few_and_many_brackets_agree(spark, monkeypatch):
    """Brackets sent to the values, or met by group and column: equal results;
    sent ones leave the values where they are."""
    from pyspark.sql import functions as F
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"),
                                  F.when(F.col("id") % 3 == 0, F.col("id")).alias("b"))
    get = lambda: sorted(map(tuple, qt.exact_quantiles(df, ["a", "b"], [0.1, 0.5], "g").collect()))
    few = qt.exact_quantiles(df, ["a", "b"], [0.1, 0.5], "g")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    first = get()
    monkeypatch.setattr(qt, "FEW_BRACKETS", 0)
    monkeypatch.setattr(qt.F, "broadcast", lambda x: pytest.fail("hinted"))
    assert get() == first and len(first) == 28
