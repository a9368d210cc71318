"""Statements of firms that file under different vocabularies.

Filers name, leave out and delay their line items differently, and the fallback
chains of the adapter exist for that. ``dealt_statements`` lands the firm-year
amounts of the given tables under one vocabulary a firm, dealt by a digest of
its ticker, so that every path of every chain has firms that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingspark.sources import bindings as b

# A line: (statement, item id, amount) and, for a line whose newest cell is not
# filed yet, True as a fourth element.
COMPANY_VOCABULARIES = [
    # amounts and ratios both filed
    [("balance", "total_assets", "total_assets"), ("balance", "a.liabilities", "total_liabilities"),
     ("balance", "b.owners_equity", "total_equity"), ("balance", "a.short_term_assets", "short_term_assets"),
     ("balance", "i.short_term_liabilities", "short_term_liabilities"),
     ("income", "n_3.net_revenue", "net_revenue"), ("income", "n_11.operating_profit", "operating_profit"),
     ("income", "n_18.net_profit_after_tax", "net_profit_after_tax"),
     ("cashflow", "depreciation_and_amortization", "cash"),
     ("ratio", "roce", "percent"), ("ratio", "ebit_margin", "percent"), ("ratio", "Revenue YoY (%)", "percent"),
     ("ratio", "p_b", "multiple")],
    # short-term lines late under one name and filed under another, returns as ratios
    [("balance", "total_assets", "total_assets"), ("balance", "equity", "total_equity"),
     ("balance", "a.short_term_assets", "short_term_assets", True),
     ("balance", "SHORT-TERM ASSETS (Bn. VND)", "short_term_assets"),
     ("balance", "i.short_term_liabilities", "short_term_liabilities", True),
     ("balance", "SHORT-TERM LIABILITIES (Bn. VND)", "short_term_liabilities"),
     ("income", "revenue", "net_revenue"), ("income", "profit_before_tax", "net_profit_after_tax"),
     ("income", "interest_expense", "interest_expense"), ("income", "khau_hao", "cash"),
     ("ratio", "ROA", "percent"), ("ratio", "ROE", "percent")],
    # gross profit and costs, long-term assets in place of short-term ones
    [("balance", "totalAssets", "total_assets"), ("balance", "von_chu_so_huu", "total_equity"),
     ("balance", "b.long_term_assets", "long_term_assets"),
     ("balance", "current_liabilities", "short_term_liabilities"),
     ("income", "doanh_thu_thuan", "net_revenue"), ("income", "loi_nhuan_gop", "gross_profit"),
     ("income", "Selling Expenses", "cash"), ("income", "Administrative Expenses", "retained")],
    # net income and interest, no short-term liabilities
    [("balance", "total_assets", "total_assets"), ("balance", "total_liabilities", "total_liabilities"),
     ("balance", "owners_equity", "total_equity"), ("balance", "current_assets", "short_term_assets"),
     ("balance", "long_term_debt", "long_term_debt"),
     ("income", "net_sales", "net_revenue"), ("income", "net_profit", "net_profit_after_tax"),
     ("income", "Interest Expense", "interest_expense")],
    # assets and net income alone
    [("balance", "assets", "total_assets"), ("income", "netIncome", "net_profit_after_tax"),
     ("ratio", "currentRatio", "multiple")],
    # long-term debt above all liabilities
    [("balance", "total_assets", "total_assets"), ("balance", "total_liabilities", "total_liabilities"),
     ("balance", "short_term_assets", "short_term_assets"), ("balance", "long_term_borrowings", "total_assets"),
     ("income", "revenue", "net_revenue"), ("income", "ebit", "operating_profit")],
    # next to nothing
    [("income", "revenue", "net_revenue"), ("ratio", "p_b", "multiple")],
]
BANK_VOCABULARIES = [
    [("balance", "total_assets", "total_assets"), ("balance", "total_liabilities", "total_liabilities"),
     ("balance", "viii.capital_and_reserves", "total_equity"),
     ("balance", "iii.deposits_from_customers", "deposits"),
     ("balance", "vi.loans_advances_and_finance_leases_to_customers", "loans"),
     ("income", "i.net_interest_income", "net_revenue"), ("income", "xi.profit_before_tax", "net_profit_after_tax"),
     ("income", "n_2.interest_expense_and_similar_expenses", "interest_expense"),
     ("ratio", "net_interest_income", "percent")],
    # revenue late, its parts filed; deposits without loans
    [("balance", "total_assets", "total_assets"), ("balance", "deposits_from_customers", "deposits"),
     ("balance", "x.fixed_assets", "cash"),
     ("income", "n_3.net_revenue", "net_revenue", True), ("income", "i.net_interest_income", "net_revenue"),
     ("income", "ii.net_fee_and_commission_income", "gross_profit"),
     ("ratio", "operating_profit_before_provision_for_credit_losses", "percent")],
    # total operating income in place of revenue
    [("balance", "total_assets", "total_assets"), ("income", "total_operating_income", "net_revenue"),
     ("ratio", "current_ratio", "multiple")],
    # profits late, the profit before provision filed
    [("balance", "total_assets", "total_assets"), ("income", "n_11.operating_profit", "operating_profit", True),
     ("income", "n_15.profit_before_tax", "net_profit_after_tax", True),
     ("income", "Operating Profit before Provision", "net_profit_after_tax")],
    # revenue late, net interest income of either sign
    [("balance", "total_assets", "total_assets"), ("income", "n_3.net_revenue", "net_revenue", True),
     ("income", "net_interest_income", "net_profit_after_tax")],
]


def vocabulary_lines() -> list[tuple]:
    """(is_bank, vocabulary, statement, item_id, item_pos, amount, late) of every line."""
    return [(is_bank, number, line[0], line[1], pos, line[2], len(line) > 3)
            for is_bank, kind in ((False, COMPANY_VOCABULARIES), (True, BANK_VOCABULARIES))
            for number, lines in enumerate(kind) for pos, line in enumerate(lines, 1)]


def vocabulary_of(ticker: Column, is_bank: Column) -> Column:
    """Number of the vocabulary that a firm files under, from a digest of its ticker."""
    dealt = F.conv(F.substring(F.md5(ticker), 1, 7), 16, 10).cast("bigint")
    return F.when(is_bank, dealt % len(BANK_VOCABULARIES)).otherwise(dealt % len(COMPANY_VOCABULARIES)).cast("int")


def dealt_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, statement, period, item_pos, item_id, value) of every firm-year under
    its firm's vocabulary. A late line's cell of the firm's newest year is null; a
    firm-year without an amount keeps a null cell. The vocabularies are a fixed list,
    so their broadcast does not grow; the window holds the years of one firm."""
    f = b.firm(spark, sf_dir).select("firm_id", "ticker", "sector", "acctbal")
    lines = vocabulary_lines()
    amounts = {k: F.col(k).cast("double") for k in b.FIRM_YEAR_AMOUNTS}
    amounts["total_equity"] = (F.col("total_assets") - F.col("total_liabilities")).cast("double")
    amounts["long_term_assets"] = (F.col("total_assets") - F.col("short_term_assets")).cast("double")
    amounts["percent"] = F.col("acctbal") / 100.0
    amounts["multiple"] = F.col("acctbal") / 1000.0
    used = sorted({line[5] for line in lines})
    is_bank = F.col("sector") == b.SEGMENT_SECTOR_DEFAULT
    wide = (b.firm_year(spark, sf_dir).join(f, "firm_id")
            .withColumn("newest", F.max("period").over(Window.partitionBy("firm_id")) == F.col("period"))
            .select("ticker", F.col("period").cast("string").alias("period"), "newest", is_bank.alias("is_bank"),
                    vocabulary_of(F.col("ticker"), is_bank).alias("vocabulary"),
                    *[amounts[k].alias(k) for k in used]))
    cells = wide.unpivot(["ticker", "period", "newest", "is_bank", "vocabulary"], used, "amount", "filed")
    table = spark.createDataFrame(lines, "is_bank boolean, vocabulary int, statement string, item_id string, "
                                         "item_pos int, amount string, late boolean")
    return cells.join(F.broadcast(table), ["is_bank", "vocabulary", "amount"]).select(
        "ticker", "statement", "period", "item_pos", "item_id",
        F.when(~(F.col("late") & F.col("newest")), F.col("filed")).alias("value"))
