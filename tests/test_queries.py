"""queries() vs oracle_sql() on the smallest driver tables (a fast subset;
scripts/check_oracle.py runs every query)."""
import hashlib
import math

import duckdb
import pytest

SF_SMALL = "/root/testdata/sf0.001"

FAST = ["a1_latest_rating", "x6_x7_x15_grade_fold", "firm_feature_rows", "a5_a6_sector_stats", "w5_group_fill",
        "x4_iqr_clip", "i4_clean", "n_sector_investment_grade", "q1_q2_ordinal_metrics", "q5_confusion_matrix",
        "m3_stratified_split", "w1_period_rank", "p14_resolver_b", "s16_item_catalogue"]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted("|".join(norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return len(rows), cols, hashlib.md5("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    from ratingspark.sources.tables import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as e
    sp = e.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(e.oracle_sql()[name]).fetchdf()
    assert digest(sp) == digest(dd)


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert set(["sector", "n_firms", "avg_investment_grade_score"]) <= set(df.columns)
    assert df.count() >= 0
