import datetime as dt

from pyspark.sql import functions as F

from ratingspark.operators import merge as mg
from ratingspark.sources.firms import latest_per_key


def test_latest_per_key_nulls_last_and_tiebreak(spark):
    d = dt.date
    rows = [("A", 1, d(2024, 1, 1), "AA"), ("A", 2, d(2024, 1, 1), "BB"), ("A", 3, None, "CC"),
            ("B", 4, None, "D"), ("B", 5, None, "C")]
    df = spark.createDataFrame(rows, "ticker string, event_id long, rated_on date, g string")
    got = {r["ticker"]: (r["event_id"], r["g"]) for r in
           latest_per_key(df, "ticker", F.col("rated_on"), F.col("event_id")).collect()}
    assert got == {"A": (2, "BB"), "B": (5, "C")}


def test_upweight_copies(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(200)], "ticker string")
    assert mg.upweight(df, 3.0).count() == 600
    n = mg.upweight(df, 2.5).count()
    assert 400 < n < 600  # two whole copies plus a seeded hash share of about half


def test_split_local_null_safe(spark):
    df = spark.createDataFrame([("a", True, "AA"), ("b", True, "NR"), ("c", False, None), ("d", None, "A")],
                               "ticker string, has_rating boolean, credit_rating string")
    rated, unrated = mg.split_local(df)
    assert sorted(r[0] for r in rated.select("ticker").collect()) == ["a"]
    assert sorted(r[0] for r in unrated.select("ticker").collect()) == ["b", "c", "d"]
