"""Fallback chains of the adapter under dealt vocabularies."""
import pytest
from pyspark.sql import functions as F

from ratingspark.operators import fundamentals as fd
from ratingspark.sources import bindings as b
from ratingspark.sources import vocabularies as v

SF = "/root/testdata/sf0.01"
SCHEMA = "ticker string, statement string, period string, item_pos int, item_id string, value double"
FIRMS = "ticker string, sector string, company_name string, exchange string"


@pytest.fixture(scope="module")
def dealt(spark):
    return fd.adapter_features(v.dealt_statements(spark, SF), b.firm(spark, SF), gate=False, paths=True).cache()


def test_every_path_of_every_chain_is_taken(dealt):
    rows = fd.path_coverage(dealt).collect()
    assert {(r.chain, r.path) for r in rows} == {(c, p) for c, ps in fd.CHAIN_PATHS.items() for p in [*ps, "none"]}
    assert {(r.chain, r.path) for r in rows if r.n_firms == 0} == set()
    n = dealt.count()
    for chain in fd.CHAIN_PATHS:
        assert sum(r.n_firms for r in rows if r.chain == chain) == n
    banks = {(r.chain, r.path): r.n_banks for r in rows}
    for path in ("bank_operating_profit", "bank_net_interest_income"):
        assert banks["ebit", path] > 0
    assert banks["ebit", "net_income"] == banks["current_ratio", "ca_cl"] == 0


def test_tags_do_not_change_the_features(spark, dealt):
    plain = fd.adapter_features(v.dealt_statements(spark, SF), b.firm(spark, SF), gate=False)
    assert plain.exceptAll(dealt.select(plain.columns)).isEmpty()


def test_late_lines_lack_the_newest_cell_alone(spark):
    rows = v.dealt_statements(spark, SF).filter(F.col("item_id") == "a.short_term_assets")
    filed = (v.dealt_statements(spark, SF).filter(F.col("item_id") == "SHORT-TERM ASSETS (Bn. VND)")
             .select("ticker", "period", F.col("value").alias("filed")))
    got = rows.join(filed, ["ticker", "period"]).groupBy("ticker").agg(
        F.max("period").alias("newest"), F.max_by("value", "period").alias("last"),
        F.count_if(F.col("value").isNull() & F.col("filed").isNotNull()).alias("late"),
        F.max_by("filed", "period").isNotNull().cast("int").alias("due")).collect()
    assert got and all(r.last is None and r.late == r.due for r in got)


def adapt(spark, cells, sector="Manufacturing"):
    rows = [("A", s, p, k, i, x) for k, (s, p, i, x) in enumerate(cells)]
    firms = spark.createDataFrame([("A", sector, None, None)], FIRMS)
    return fd.adapter_features(spark.createDataFrame(rows, SCHEMA), firms, gate=False, paths=True).first()


def test_paths_by_hand(spark):
    r = adapt(spark, [("balance", "2024", "total_assets", 200.0), ("balance", "2024", "equity", 50.0),
                      ("income", "2024", "gross_profit", 30.0), ("income", "2024", "selling_expenses", 4.0),
                      ("income", "2024", "net_income", 0.0), ("ratio", "2024", "roa", 7.0),
                      ("cashflow", "2024", "depreciation", 0.0), ("income", "2024", "khau_hao", 6.0)])
    assert (r._ebit_path, r._ebit) == ("gross_minus_opex", 26.0)
    assert (r._roce_path, r.roce) == ("equity_plus_debt", 26.0 / 50.0)
    assert (r._roa_path, r.roa) == ("ratio_table", 0.07)  # a zero return falls to the ratio table
    assert r._roe_path is None and r.roe is None
    assert r._liabilities_path == "assets_less_equity" and r.debt_to_assets == 0.75
    assert r._depreciation_path == "income" and r.net_debt_to_ebitda == 0.0  # a zero is not a depreciation
    assert r._growth_path is None and r._revenue_path is None and r._current_ratio_path is None


def test_nothing_but_nulls_and_no_rows(spark):
    r = adapt(spark, [("balance", "2024", "total_assets", None)], "Banking")
    assert r._current_ratio_path == "bank_default" and r._ebit_path is None and r._roce_path is None
    none = fd.adapter_features(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], FIRMS), paths=True)
    rows = fd.path_coverage(none).collect()
    assert len(rows) == sum(len(p) + 1 for p in fd.CHAIN_PATHS.values()) and all(x.n_firms == 0 for x in rows)
