"""Resolver A over one row per statement: one shuffle, the values of the plain path."""
import re

from pyspark.sql import functions as F

from ratingspark.operators import fundamentals as fd
from ratingspark.operators import items as it

ROWS = [("A", "income", "2023", 1, "n_3.net_revenue", 9.0), ("A", "income", "2022", 1, "n_3.net_revenue", 7.0),
        ("A", "income", "2022", 1, "n_3.net_revenue", 8.0), ("A", "balance", "2024", 2, "total_assets", None),
        ("A", "balance", "2023", 2, "total_assets", 5.0), ("B", "income", "2024", 1, "n_3.net_revenue", None),
        ("B", "income", "2020", 3, "n_18.net_profit_after_tax", 4.0), ("B", "income", "2024", 4, None, 3.0),
        (None, "income", "2024", 1, "n_3.net_revenue", 2.0), ("C", "income", None, 1, "n_3.net_revenue", 6.0),
        ("C", "income", "2021", 1, "n_3.net_revenue", 1.0), ("D", "ratio", "2021", 1, "p_b", None)]


def items(spark, position="int"):
    return spark.createDataFrame(ROWS, f"ticker string, statement string, period string, item_pos {position}, item_id string, value double")


def test_values_equal_the_plain_path(spark):
    for position in ("int", "long"):
        own = items(spark, position)
        got = {r["ticker"]: r.asDict() for r in fd.resolved_values_a(own).collect()}
        ranked = it.rank_periods(own)
        resolved = it.resolve_items_a(ranked, it.lookups_variant_a())
        want = {}
        for idx in (0, 1):
            for r in it.values_at(ranked, resolved, idx).collect():
                if idx == 0 or r["lookup"] == "is_revenue":
                    at = (r["ticker"], f"{r['lookup']}@{idx}")
                    want[at] = max((v for v in (want.get(at), r["value"]) if v is not None), default=None)
        assert set(got) == {"A", "B", "C", "D"}
        assert {(t, c): v for t, row in got.items() for c, v in row.items() if c != "ticker" and v is not None} == {
            at: v for at, v in want.items() if v is not None}
        assert got["A"]["is_revenue@0"] == 9.0 and got["A"]["is_revenue@1"] == 8.0 and got["A"]["bs_total_assets@0"] is None


def test_the_long_table_is_shuffled_once(spark, capsys):
    own = items(spark)
    it.statement_rows(own).explain("simple")
    plan = capsys.readouterr().out
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert it.statement_rows(own).where(F.size("layout") == 0).count() >= 1


def test_round_trip_takes_one_shuffle(spark, capsys):
    from ratingspark.sources import ingest
    own = items(spark).where("ticker is not null").repartition("ticker")
    back = ingest.unpivot_statement(ingest.statement_wide(own)).where("value is not null")
    back.explain("simple")
    assert len(re.findall(r"Exchange hashpartitioning", capsys.readouterr().out)) == 1
    assert sorted((r["ticker"], r["period"], r["value"]) for r in back.collect() if r["item_id"] == "n_3.net_revenue") == [
        ("A", "2022", 8.0), ("A", "2023", 9.0), ("C", "2021", 1.0), ("C", "null", 6.0)]


def test_long_statements_stay_in_the_partitions_of_their_ticker(spark, tmp_path):
    from ratingspark.sources import bindings as b
    firms = [(1, "A", 1, -5.0, "BUILDING"), (2, "B", 1, 2000.0, "HOUSEHOLD"), (2, "B2", 1, 3000.0, None)]
    tables = {"customer": (firms, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
              "nation": ([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
              "region": ([(0, "R")], "r_regionkey int, r_name string"),
              "orders": ([(7, 1, "2020-05-01"), (8, 2, "2021-05-01"), (9, None, "2021-05-01")],
                         "o_orderkey long, o_custkey long, o_orderdate string"),
              "lineitem": ([(7, 100.0, 0.1, 0.02, "A", "F"), (8, 50.0, None, 0.0, "N", "O"), (9, 1.0, 0.0, 0.0, "R", "F")],
                           "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, "
                           "l_returnflag string, l_linestatus string")}
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    items = b.statement_item(spark, str(tmp_path))
    got = [(r.ticker, r.period, r.statement, r.item_pos, r.item_id) for r in items.collect()]
    kept = {(False, "F1", "2020", 1), (True, "F2", "2021", 2)}  # a firm that comes twice has its rows twice
    want = [(ticker, year, stmt, pos, bank if is_bank else other)
            for is_bank, ticker, year, times in kept for _, stmt, other, bank, pos in b.STATEMENT_ITEMS
            if (bank if is_bank else other) is not None for _ in range(times)]
    assert sorted(got) == sorted(want)
    ratio = {(r.ticker, r.value) for r in items.where("item_id = 'p_b'").collect()}
    assert ratio == {("F1", None), ("F2", 2.0), ("F2", 3.0)}
    plan = it.statement_rows(items)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any(re.match(r"ticker#\d+, \d+$", keys) for keys in dealt)
    assert not [keys for keys in dealt if "statement#" in keys]


def test_rows_of_cells_equal_the_long_rows(spark, capsys):
    """Cells of a period in one row, some of them in another: ranked as rows, the same values."""
    own = items(spark)
    cells = own.withColumn("_part", F.col("item_pos") % 2).groupBy("ticker", "statement", "period", "_part").agg(
        F.collect_list(F.struct("item_pos", "item_id", "value")).alias("cells")).drop("_part")
    rows = lambda df: sorted(map(str, it.statement_rows(df).collect()))
    assert rows(cells) == rows(own)
    it.statement_rows(cells).explain("simple")
    plan = capsys.readouterr().out
    assert plan.index("Generate inline") < plan.index("Window")  # the printed plan ends with its sources


def test_a_firm_year_is_dealt_once_by_ticker(spark, tmp_path):
    from ratingspark.sources import bindings as b
    tables = {"customer": ([(1, "A", 1, -5.0, "BUILDING"), (2, "B", 1, 2000.0, "HOUSEHOLD"), (2, "B2", 1, 3000.0, None),
                            (None, "C", 1, 1.0, "BUILDING")],
                           "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
              "nation": ([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
              "region": ([(0, "R")], "r_regionkey int, r_name string"),
              "orders": ([(7, 1, "2020-05-01"), (8, 2, "2021-05-01"), (9, None, "2021-05-01")],
                         "o_orderkey long, o_custkey long, o_orderdate string"),
              "lineitem": ([(7, 100.0, 0.1, 0.02, "A", "F"), (8, 50.0, None, 0.0, "N", "O"), (9, 1.0, 0.0, 0.0, "R", "F")],
                           "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, "
                           "l_returnflag string, l_linestatus string")}
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    long, cells = b.statement_item(spark, str(tmp_path)), b.statement_cells(spark, str(tmp_path))
    assert sorted(map(str, cells.select("ticker", "statement", "period", F.inline("cells")).collect())) == sorted(
        map(str, long.collect()))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # firms as many as on a large set
    try:
        plans = [it.statement_rows(df.select("*"))._jdf.queryExecution().executedPlan().toString() for df in (long, cells)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    for plan in plans:
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        # the years by firm and year, then by ticker: not by firm alone in between
        assert not [keys for keys in dealt if re.match(r"(o_custkey|firm_id)#\d+L?, \d+$", keys)]
