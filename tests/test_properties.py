"""Property tests (hypothesis): clip bounds, fill completeness, unpivot round trip."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratingspark.functions import scalars as sc
from ratingspark.operators import clean as cl
from ratingspark.sources import ingest

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
vals = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=30)


@SETTINGS
@given(xs=vals, lo=st.floats(-10, 0), width=st.floats(0, 10))
def test_winsorize_within_bounds_and_keeps_nulls(spark, xs, lo, width):
    hi = lo + width
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(sc.winsorize(F.col("x"), lo, hi)).collect()]
    for x, y in zip(xs, got):
        assert (y is None) == (x is None)
        if y is not None:
            assert lo <= y <= hi


@SETTINGS
@given(xs=vals, sectors=st.lists(st.sampled_from(["Banking", "Retail", None]), min_size=30, max_size=30))
def test_group_fill_leaves_no_nulls(spark, xs, sectors):
    feats = cl.ALL_FEATURES
    rows = [(f"t{i}", sectors[i], *([x] * len(feats))) for i, x in enumerate(xs)]
    schema = "ticker string, sector string, " + ", ".join(f"{f} double" for f in feats)
    out = cl.group_fill(spark.createDataFrame(rows, schema))
    assert out.count() == len(xs)
    nulls = out.select(*[F.sum(F.col(f).isNull().cast("int")).alias(f) for f in feats]).first()
    assert all(v == 0 for v in nulls)


@SETTINGS
@given(cells=st.lists(st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["2023", "2024", "2024-Q1"]),
                                st.sampled_from(["x", "y", "z"]), st.one_of(st.none(), st.floats(-5, 5))),
                      min_size=1, max_size=20, unique_by=lambda c: (c[0], c[1], c[2])))
def test_unpivot_round_trip(spark, cells):
    pos = {"x": 1, "y": 2, "z": 3}
    rows = [(t, "balance", p, pos[i], i, v) for t, p, i, v in cells]
    items = spark.createDataFrame(rows, "ticker string, statement string, period string, item_pos int, "
                                        "item_id string, value double")
    back = ingest.unpivot_statement(ingest.statement_wide(items)).filter(F.col("value").isNotNull())
    want = sorted((t, p, i, v) for t, p, i, v in cells if v is not None)
    got = sorted((r["ticker"], r["period"], r["item_id"], r["value"])
                 for r in back.select("ticker", "period", "item_id", "value").collect())
    assert got == want
