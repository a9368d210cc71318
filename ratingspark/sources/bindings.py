"""Binding views: the driver's TPC-H-ish tables re-read as the pipeline's
inputs (firms, firm-years of financials, rating events, landed statements).

All sums run on DECIMAL so both engines agree exactly; values turn into
DOUBLE only where the statement layer stores them. The joins and aggregations
are plain DataFrame operations: orders x lineitem is a shuffle join on the order
key with partial aggregation before the (firm, year) shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.sources.tables import read_table

# Market segment -> canonical sector of the firm binding.
SEGMENT_SECTOR = [
    ("MACHINERY", "Manufacturing"),
    ("BUILDING", "RealEstate"),
    ("AUTOMOBILE", "Transportation"),
    ("FURNITURE", "Retail"),
]
SEGMENT_SECTOR_DEFAULT = "Banking"

# Order total price -> raw agency grade of the rating-event binding (upper bounds).
PRICE_GRADES = [
    (1100, "AAA"), (20000, "AA-"), (80000, "A+"), (240000, "BBB"), (340000, "BB-"),
    (440000, "B+"), (490000, "CCC-"), (499000, "CC"), (499700, "NR"),
]
PRICE_GRADE_DEFAULT = "SD"

# (key, statement, item id for non-banks, item id for banks, row position).
# Firm-year columns land as statement line items under names the candidate
# lists know, banks getting bank names.
STATEMENT_ITEMS = [
    ("total_assets", "balance", "total_assets", "total_assets", 1),
    ("total_liabilities", "balance", "a.liabilities", "total_liabilities", 2),
    ("total_equity", "balance", "b.owners_equity", "viii.capital_and_reserves", 3),
    ("short_term_assets", "balance", "a.short_term_assets", None, 4),
    ("short_term_liabilities", "balance", "i.short_term_liabilities", None, 5),
    ("long_term_debt", "balance", "long_term_borrowings", None, 6),
    ("cash", "balance", "i.cash_and_cash_equivalents", "i.cash_gold_and_silver_precious_stones", 7),
    ("retained", "balance", "n_11.undistributed_earnings_after_tax", None, 8),
    ("deposits", "balance", None, "iii.deposits_from_customers", 9),
    ("loans", "balance", None, "vi.loans_advances_and_finance_leases_to_customers", 10),
    ("net_revenue", "income", "n_3.net_revenue", "i.net_interest_income", 1),
    ("gross_profit", "income", "n_5.gross_profit", "ii.net_fee_and_commission_income", 2),
    ("operating_profit", "income", "n_11.operating_profit", None, 3),
    ("interest_expense", "income", "of_which_interest_expenses",
     "n_2.interest_expense_and_similar_expenses", 4),
    ("net_profit_after_tax", "income", "n_18.net_profit_after_tax", "xiii.net_profit_after_tax", 5),
    ("market_cap", "ratio", "market_cap", "market_cap", 1),
    ("price_to_book", "ratio", "p_b", "p_b", 2),
]

FIRM_YEAR_AMOUNTS = [
    "total_assets", "total_liabilities", "short_term_assets", "short_term_liabilities",
    "net_profit_after_tax", "net_revenue", "interest_expense", "gross_profit",
    "operating_profit", "cash", "long_term_debt", "retained", "deposits", "loans",
]


def firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: firm id, ticker, raw and canonical sector, source
    tag, name and 'exchange' (its region)."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    seg = F.col("c_mktsegment")
    sector = F.lit(SEGMENT_SECTOR_DEFAULT)
    for s, name in reversed(SEGMENT_SECTOR):
        sector = F.when(seg == s, F.lit(name)).otherwise(sector)
    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                      .select("n_nationkey", F.col("r_name").alias("exchange")))
    return (
        c.join(geo, c.c_nationkey == geo.n_nationkey, "left")
        .select(
            F.col("c_custkey").alias("firm_id"),
            F.concat(F.lit("F"), F.col("c_custkey").cast("string")).alias("ticker"),
            seg.alias("sector_raw"),
            sector.alias("sector"),
            F.when(F.col("c_nationkey") < 12, F.lit("vietnam")).otherwise(F.lit("kaggle")).alias("data_source"),
            F.col("c_name").alias("company_name"),
            F.col("exchange"),
            F.col("c_acctbal").alias("acctbal"),
        )
    )


def firm_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financial amounts per (firm, year), DECIMAL. Null where no line matches."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    # exact sums of whole cents and hundredths of cents in longs; scaled once per group
    def hundredths(name: str, kind: str) -> Column:
        return (F.col(name).cast(kind) * 100).cast("long")

    p, d, t = hundredths("l_extendedprice", "decimal(18,2)"), hundredths("l_discount", "decimal(4,2)"), hundredths(
        "l_tax", "decimal(4,2)")
    lines = li.select("l_orderkey", "l_returnflag", "l_linestatus", p.alias("p"), d.alias("d"), t.alias("t"))
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    gross, net, off, tax = F.col("p"), F.col("p") * (100 - F.col("d")), F.col("p") * F.col("d"), F.col("p") * F.col("t")

    def fsum(expr, name, cond=None):
        return F.sum(expr if cond is None else F.when(cond, expr)).alias(name)

    sums = (o.join(lines, o.o_orderkey == lines.l_orderkey)
            .groupBy(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").cast("bigint").alias("period")).agg(
        fsum(gross, "total_assets"), fsum(gross, "total_liabilities", ls == "O"),
        fsum(gross, "short_term_assets", rf == "A"), fsum(gross, "short_term_liabilities", rf == "R"),
        fsum(off - tax, "net_profit_after_tax"), fsum(net, "net_revenue"), fsum(tax, "interest_expense", rf == "R"),
        fsum(net, "gross_profit", ls == "F"), fsum(off, "operating_profit", (rf == "A") & (ls == "F")),
        fsum(off, "cash", rf == "N"), fsum(tax, "long_term_debt", ls == "F"), fsum(off, "retained", ls == "F"),
        fsum(gross, "deposits", rf == "N"), fsum(net, "loans", ls == "O")))
    cents = {"total_assets", "total_liabilities", "short_term_assets", "short_term_liabilities", "deposits"}
    unit = {c: "0.01BD" if c in cents else "0.0001BD" for c in FIRM_YEAR_AMOUNTS}
    return sums.select("firm_id", "period", *[(F.col(c).cast("decimal(20,0)") * F.expr(unit[c])).alias(c)
                                              for c in FIRM_YEAR_AMOUNTS])


def rating_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agency observation per order: raw grade string with modifiers."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    price = F.col("o_totalprice")
    grade = F.lit(PRICE_GRADE_DEFAULT)
    for bound, g in reversed(PRICE_GRADES):
        grade = F.when(price < bound, F.lit(g)).otherwise(grade)
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("firm_id"),
        F.concat(F.lit("F"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.col("o_orderpriority").alias("agency"),
        F.to_date("o_orderdate").alias("rated_on"),
        grade.alias("raw_rating"),
    )


def _firm_year_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a firm-year: (ticker, period, is_bank, <key of STATEMENT_ITEMS>...). It is
    dealt by ticker, then joined and made long by arrays in its partition, so that
    whatever goes by ticker or statement moves no row again."""
    f = firm(spark, sf_dir).select("ticker", "sector", "acctbal")
    amounts = {k: F.col(k).cast("double") for k in FIRM_YEAR_AMOUNTS}
    amounts["total_equity"] = (F.col("total_assets") - F.col("total_liabilities")).cast("double")
    amounts["market_cap"] = (F.col("total_assets") * 2).cast("double")
    years = firm_year(spark, sf_dir).select(
        F.concat(F.lit("F"), F.col("firm_id").cast("string")).alias("ticker"), F.col("period").cast("string").alias("period"),
        *[c.alias(k) for k, c in amounts.items()]).repartition("ticker")
    return years.join(f, "ticker").select(
        "ticker", "period", (F.col("sector") == "Banking").alias("is_bank"),
        F.when(F.col("acctbal") > 0, F.col("acctbal") / 1000.0).alias("price_to_book"), *amounts)


def statement_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed statements in long form: (ticker, statement, period, item_pos,
    item_id, value). Null cells are kept (an all-null period still counts).
    This is the shape the statement unpivot (S4) produces from transposed
    statement files."""
    lines = [F.struct(F.lit(stmt).alias("statement"), F.lit(pos).alias("item_pos"),
                      F.when(F.col("is_bank"), F.lit(bank)).otherwise(F.lit(other)).alias("item_id"),
                      F.col(key).alias("value")) for key, stmt, other, bank, pos in STATEMENT_ITEMS]
    return _firm_year_amounts(spark, sf_dir).select("ticker", "period", F.inline(F.array(*lines))).where(
        "item_id is not null").select("ticker", "statement", "period", "item_pos", "item_id", "value")


def statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``statement_item``, those of a statement and period in one:
    (ticker, statement, period, cells), ``cells`` an array of (item_pos, item_id,
    value), never empty. Periods are ranked on far fewer rows of this form."""
    def cells(stmt: str, bank: bool) -> Column:
        own = [(key, of_bank if bank else other, pos) for key, s, other, of_bank, pos in STATEMENT_ITEMS if s == stmt]
        return F.array(*[F.struct(F.lit(pos).alias("item_pos"), F.lit(item).alias("item_id"), F.col(key).alias("value"))
                         for key, item, pos in own if item is not None])

    statements = [F.struct(F.lit(stmt).alias("statement"),
                           F.when(F.col("is_bank"), cells(stmt, True)).otherwise(cells(stmt, False)).alias("cells"))
                  for stmt in dict.fromkeys(s for _, s, *_ in STATEMENT_ITEMS)]
    return _firm_year_amounts(spark, sf_dir).select("ticker", "period", F.inline(F.array(*statements))).where(
        F.size("cells") > 0).select("ticker", "statement", "period", "cells")
