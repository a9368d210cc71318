from ratingspark.operators import items as it

SCHEMA = "ticker string, statement string, period string, item_pos int, item_id string, value double"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_period_rank_quarters_above_years(spark):
    df = rows(spark, [("T", "balance", "2024", 1, "a", 1.0), ("T", "balance", "2023-Q4", 1, "a", 2.0),
                      ("T", "balance", "2023", 1, "a", 3.0)])
    r = {x["period"]: x["period_rank"] for x in it.rank_periods(df).collect()}
    assert r == {"2023-Q4": 0, "2024": 1, "2023": 2}


def test_resolver_a_keeps_chosen_item_even_if_null(spark):
    lk = [("bs_x", "balance", ["first_name", "second_name"])]
    df = rows(spark, [("T", "balance", "2024", 1, "first_name", None), ("T", "balance", "2023", 1, "first_name", 5.0),
                      ("T", "balance", "2024", 2, "second_name", 7.0), ("T", "balance", "2023", 2, "second_name", 8.0)])
    ranked = it.rank_periods(df)
    res = it.resolve_items_a(ranked, lk)
    v = it.values_at(ranked, res, 0).first()
    assert v["item_id"] == "first_name" and v["value"] is None


def test_resolver_a_exact_beats_substring_and_strips_parens(spark):
    lk = [("bs_y", "balance", ["total assets"])]
    df = rows(spark, [("T", "balance", "2024", 1, "current total assets extra", 1.0),
                      ("T", "balance", "2024", 2, "Total Assets (Bn. VND)", 2.0)])
    res = it.resolve_items_a(it.rank_periods(df), lk).first()
    # normalised key match (parens removed) wins over the earlier substring hit
    assert res["item_id"] == "Total Assets (Bn. VND)"


def test_resolver_b_first_non_null(spark):
    lk = [("x", "balance", ["first_name", "second_name"], 0)]
    df = rows(spark, [("T", "balance", "2024", 1, "first_name", None), ("T", "balance", "2024", 2, "second_name", 7.0)])
    v = it.resolve_values_b(it.rank_periods(df), lk).first()
    assert v["value"] == 7.0


def test_yoy_growth_clip_and_guard(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(100.0, 10.0), (5.0, 0.0), (1.0, 100.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(it.yoy_growth(F.col("a"), F.col("b"))).collect()]
    assert got == [5.0, None, -0.9, None]
