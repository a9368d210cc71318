import math

from pyspark.sql import functions as F

from ratingspark.functions import scalars as sc


def one(spark, expr, value, typ="double"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_safe_div_small_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1e-12), (1.0, 2.0), (None, 2.0)], "n double, d double")
    got = [r[0] for r in df.select(sc.safe_div(F.col("n"), F.col("d"))).collect()]
    assert got == [None, None, 0.5, None]


def test_winsorize_keeps_null(spark):
    assert one(spark, lambda c: sc.winsorize(c, 0.0, 1.0), None) is None
    assert one(spark, lambda c: sc.winsorize(c, 0.0, 1.0), 5.0) == 1.0
    assert one(spark, lambda c: sc.winsorize(c, 0.0, 1.0), -5.0) == 0.0


def test_fold_grade_modes(spark):
    df = spark.createDataFrame([("AA-",), ("SD",), ("CCC+",), (" bbb ",), ("NR",), (None,)], "g string")
    drop = [r[0] for r in df.select(sc.fold_grade(F.col("g"), "drop")).collect()]
    keep = [r[0] for r in df.select(sc.fold_grade(F.col("g"), "keep")).collect()]
    upper = [r[0] for r in df.select(sc.fold_grade(F.col("g"), "upper")).collect()]
    assert drop == ["AA", "D", "CCC", None, None, None]
    assert keep == ["AA", "D", "CCC", "bbb", "NR", None]
    assert upper == ["AA", "D", "CCC", "BBB", "NR", ""]


def test_grade_ordinal_and_band(spark):
    df = spark.createDataFrame([("AAA",), ("BBB",), ("D",), ("XX",), (None,)], "g string")
    rows = df.select(sc.grade_ordinal(F.col("g")), sc.risk_band(F.col("g"))).collect()
    assert [r[0] for r in rows] == [0, 3, 9, 99, 99]
    assert [r[1] for r in rows] == ["green", "yellow", "red", "white", "white"]


def test_percent_heuristic_leaves_small_percent(spark):
    # the parity heuristic only divides when |x| > 1, so 0.99 % stays 0.99
    assert one(spark, lambda c: sc.percent_to_ratio(c, heuristic=True), 0.99) == 0.99
    assert one(spark, lambda c: sc.percent_to_ratio(c, heuristic=True), 12.0) == 0.12
    assert math.isclose(one(spark, lambda c: sc.percent_to_ratio(c), 0.99), 0.0099)


def test_sector_normaliser_blank_and_unknown(spark):
    df = spark.createDataFrame([(None,), ("",), ("zzzz",)], "s string")
    got = [r[0] for r in df.select(sc.normalize_sector(F.col("s"))).collect()]
    assert got == ["Other", "Other", "Other"]


def test_strip_parens_and_log(spark):
    assert one(spark, sc.strip_parens, " Total Assets (Bn. VND) ", "string") == "total assets"
    assert math.isclose(one(spark, sc.log_size, -math.e + 1), 1.0, rel_tol=1e-12)
