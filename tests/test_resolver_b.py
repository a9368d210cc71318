"""Resolver B from one row a statement against its long form."""
import random

import pytest
from pyspark.sql import functions as F

from ratingspark.operators import fundamentals as fd
from ratingspark.operators import items as it

SCHEMA = "ticker string, statement string, period string, item_pos int, item_id string, value double"


@pytest.fixture(scope="module")
def items(spark):
    """Statements in layouts of their own: null cells and whole null periods, names in other
    cases and inside longer names, names that are null, periods of several kinds."""
    draw = random.Random(3)
    names = {}
    for _, stmt, keys, _ in fd.lookups_variant_b():
        names.setdefault(stmt, []).extend([k for k in keys] + [k.upper() for k in keys[:2]] + [f"of {k} (x)" for k in keys[:2]])
    rows = []
    for t in range(60):
        for stmt, known in names.items():
            own = list(dict.fromkeys(draw.sample(sorted(set(known)), min(12, len(set(known)))))) + ["other", None]
            for period in draw.sample(["2019", "2020", "2021", "2021-Q2", "odd"], draw.choice([1, 2, 3])):
                empty = draw.random() < 0.15
                for pos, item in enumerate(own):
                    value = None if empty or draw.random() < 0.4 else float(draw.randint(-9, 9))
                    rows.append((f"T{t}", stmt, period, pos, item, value))
    rows += [("blank", "balance", "2020", 1, "cash", None), (None, "balance", "2020", 1, "cash", 1.0),
             ("undated", "balance", None, 1, "cash", 1.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def long_form(items):
    lookups = fd.lookups_variant_b()
    ranked = it.rank_periods(items)
    found = it.resolve_values_b(ranked, lookups).groupBy("ticker").pivot("lookup", [n for n, *_ in lookups]).agg(F.max("value"))
    return ranked.select("ticker").distinct().join(found, "ticker", "left")


def test_values_equal_the_long_form(items):
    names = ["ticker", *[n for n, *_ in fd.lookups_variant_b()]]
    got = sorted(it.values_b(it.statement_rows(items), fd.lookups_variant_b()).select(*names).collect())
    want = sorted(long_form(items).select(*names).collect(), key=lambda r: r.ticker)
    assert got == want and {"blank", "T1"} <= {r.ticker for r in got} and len(got) == 61


def test_no_long_rows_are_written(items, monkeypatch):
    """Scratch tables hold a row a statement, a layout or a ticker, never one a cell."""
    written = []

    def kept(df, name="stage"):
        written.append(df.count())
        return df

    monkeypatch.setattr(fd, "materialize", kept)
    monkeypatch.setattr(it, "materialize", kept)
    firms = items.select("ticker").distinct().withColumn("sector", F.lit("Retail"))
    assert fd.crawl_features(items, firms, gate=False).count() == 61
    assert max(written) <= items.select("ticker", "statement").distinct().count() < items.count() / 10


def test_statements_of_one_row_a_period(items, spark):
    cells = (items.where("ticker is not null and period is not null")
             .groupBy("ticker", "statement", "period").agg(F.collect_list(F.struct("item_pos", "item_id", "value")).alias("cells")))
    firms = items.select("ticker").distinct().withColumn("sector", F.lit("Retail"))
    one, many = (sorted(map(str, fd.crawl_features(x, firms, gate=False).collect())) for x in (cells, items))
    assert one == many
