import math

from ratingspark.operators import features as fe

GOLD_ROW = dict(ticker="M1", sector="RealEstate", data_source="vietnam", roa=0.05, roe=0.12, roce=0.08,
                ebit_margin=0.1, current_ratio=1.5, debt_to_assets=0.45, debt_to_equity=1.2,
                net_debt_to_ebitda=3.0, asset_turnover=0.8, wcta=0.15, reta=0.2, market_to_book=0.0,
                revenue_growth_yoy=None, log_revenue=None, market_cap=None)
SCHEMA = ("ticker string, sector string, data_source string, roa double, roe double, roce double, "
          "ebit_margin double, current_ratio double, debt_to_assets double, debt_to_equity double, "
          "net_debt_to_ebitda double, asset_turnover double, wcta double, reta double, market_to_book double, "
          "revenue_growth_yoy double, log_revenue double, market_cap double")


def test_manual_firm_goldens(spark):
    df = spark.createDataFrame([tuple(GOLD_ROW.values())], SCHEMA)
    r = fe.engineer(df).first().asDict()
    close = lambda a, b: math.isclose(a, b, abs_tol=1e-6)
    assert close(r["altman_z"], 1.59)
    assert close(r["coverage_proxy"], 0.222222)
    assert close(r["equity_ratio"], 0.55)
    assert close(r["financial_strength_index"], 0.223333)
    assert close(r["debt_safety_margin"], 0.3)
    assert close(r["investment_grade_score"], 0.425556)
    assert close(r["roa_sector_ratio"], 1.315789)
    assert close(r["roe_sector_ratio"], 1.363636)
    assert close(r["debt_to_assets_sector_ratio"], 0.725806)
    assert close(r["current_ratio_sector_ratio"], 1.2)
    assert close(r["ebit_margin_sector_ratio"], 0.512821)
    assert close(r["asset_turnover_sector_ratio"], 2.962963)
    assert r["signal_low_debt"] == 1.0 and r["signal_high_debt"] == 0.0
    assert r["signal_good_liquidity"] == 0.0 and r["signal_high_roe"] == 0.0
    assert r["signal_altman_grey"] == 0.0 and r["signal_altman_distress"] == 1.0
    assert all(r[k] == 0.0 for k in r if k.endswith("_sector_z"))


def test_null_sector_defaults(spark):
    row = dict(GOLD_ROW, ticker="M2", sector=None)
    df = spark.createDataFrame([tuple(GOLD_ROW.values()), tuple(row.values())], SCHEMA)
    r = [x.asDict() for x in fe.engineer(df).orderBy("ticker").collect()][1]
    assert r["roa_sector_ratio"] == 1.0
    assert r["debt_to_assets_sector_z"] == 0.0
