"""Firm-level inputs of the modelling half of the pipeline, derived from the
binding views: the latest agency grade per firm (A1 + X6) and one canonical
feature row per firm (the shape of the crawled / merged feature files).

The feature row is computed straight from ``firm_year`` at the newest period
(and the previous one for growth); it is the cheap, fully-populated stand-in
for the statement adapter's output, so that cleaning, feature engineering,
merging and metrics can be checked on every firm without paying for the
line-item resolver each time. ``feature_rows(..., from_statements=True)``
feeds them from the real adapter output (D15) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.functions.scalars import fold_grade, safe_div
from ratingspark.operators.asof import asof_latest
from ratingspark.operators.items import yoy_growth
from ratingspark.sources import bindings as b

FEATURES = list(fv.FEATURE_NAMES.values())


# ---------------------------------------------------------------- A1
def latest_per_key(df: DataFrame, key: str, order: Column, tiebreak: Column) -> DataFrame:
    """A1: newest row per key (nulls last), ties broken by ``tiebreak`` desc.

    One ``max_by`` aggregate over a struct of the row: it combines map-side
    before the shuffle, so a key holding a third of all rows never sorts or
    lands whole in one task (a window would). ``max`` orders nulls first, which
    is exactly "descending, nulls last"."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order.alias("o"), tiebreak.alias("t"))).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def latest_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, event_id, rated_on, agency, raw_rating, credit_rating): newest
    observation per firm; grade folded to the 10-step scale, unmapped -> null."""
    ev = b.rating_event(spark, sf_dir)
    latest = latest_per_key(ev, "ticker", F.col("rated_on"), F.col("event_id"))
    return latest.select("ticker", "event_id", "rated_on", "agency", "raw_rating",
                         fold_grade(F.col("raw_rating"), "drop").alias("credit_rating"))


#: Days after which an observation no longer rates a firm.
RATING_MAX_AGE = 365


def current_rows(spark: SparkSession, sf_dir: str, feats: DataFrame, max_age: int = RATING_MAX_AGE) -> DataFrame:
    """``feats`` as of the day of the newest observation of all: a firm is rated
    by its newest observation if that is at most ``max_age`` days old and its
    grade is on the scale; the other firms are to be scored."""
    ev = b.rating_event(spark, sf_dir)
    today = ev.agg(F.max("rated_on").alias("_today"))
    graded = ev.withColumn("credit_rating", fold_grade(F.col("raw_rating"), "drop"))
    rows = feats.crossJoin(F.broadcast(today))  # one-row table
    out = asof_latest(rows, graded, "ticker", "_today", "rated_on", "event_id", ["credit_rating"], max_age)
    return out.withColumn("has_rating", F.col("credit_rating").isNotNull()).select(*feats.columns)


def yearly_ratings(spark: SparkSession, sf_dir: str, max_age: int = RATING_MAX_AGE) -> DataFrame:
    """(ticker, period, event_id, rated_on, credit_rating): what rated a firm in
    the middle of each year it has statements for, null if nothing did."""
    firms = b.firm(spark, sf_dir).select("firm_id", "ticker")
    years = b.firm_year(spark, sf_dir).select("firm_id", "period").join(firms, "firm_id").select(
        "ticker", "period", F.make_date(F.col("period").cast("int"), F.lit(6), F.lit(30)).alias("_at"))
    graded = b.rating_event(spark, sf_dir).withColumn("credit_rating", fold_grade(F.col("raw_rating"), "drop"))
    return asof_latest(years, graded, "ticker", "_at", "rated_on", "event_id", ["event_id", "rated_on", "credit_rating"],
                       max_age).drop("_at")


def rating_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per firm: latest folded grade (truth) and the grade before it
    (prediction) — a model-free prediction/truth pair for the metrics.

    Two ``max_by`` passes instead of a ranking window: the second runs on the
    events minus each firm's latest one (an anti-join on the unique event id,
    so no key is hot)."""
    ev = b.rating_event(spark, sf_dir).withColumn("grade", fold_grade(F.col("raw_rating"), "drop"))
    ev = ev.filter(F.col("grade").isNotNull()).select("ticker", "event_id", "rated_on", "grade")
    first = latest_per_key(ev, "ticker", F.col("rated_on"), F.col("event_id"))
    rest = ev.join(first.select("event_id"), "event_id", "left_anti")
    second = latest_per_key(rest, "ticker", F.col("rated_on"), F.col("event_id"))
    return first.select("ticker", F.col("grade").alias("truth")).join(
        second.select("ticker", F.col("grade").alias("pred")), "ticker")


# ---------------------------------------------------------------- feature rows
def _d(c: str) -> Column:
    return F.col(c).cast("double")


def feature_rows(spark: SparkSession, sf_dir: str, from_statements: bool = False) -> DataFrame:
    """One canonical feature row per firm with (ticker, sector, data_source,
    credit_rating, has_rating, <15 features>)."""
    firms = b.firm(spark, sf_dir).select("firm_id", "ticker", "sector", "data_source", "acctbal")
    rating = latest_rating(spark, sf_dir).select("ticker", "credit_rating")
    if from_statements:
        from ratingspark.operators.fundamentals import adapter_features
        feats = adapter_features(b.statement_cells(spark, sf_dir), b.firm(spark, sf_dir))
        base = feats.select("ticker", *FEATURES).join(
            firms.select("ticker", "sector", "data_source"), "ticker")
    else:
        fy = b.firm_year(spark, sf_dir)
        # one pass over firm_year: the previous year's revenue is the next row
        # of the same newest-first window (a firm's years: a bounded partition)
        w = Window.partitionBy("firm_id").orderBy(F.col("period").desc())
        fy = (fy.withColumn("_rn", F.row_number().over(w))
              .withColumn("_rev1", F.lead(_d("net_revenue")).over(w)))
        cur = fy.filter("_rn = 1").join(firms, "firm_id")
        ta, tl = _d("total_assets"), _d("total_liabilities")
        eq = (F.col("total_assets") - F.col("total_liabilities")).cast("double")
        op, rev = _d("operating_profit"), _d("net_revenue")
        exprs = {
            "roa": safe_div(_d("net_profit_after_tax"), ta),
            "roe": safe_div(_d("net_profit_after_tax"), eq),
            "roce": safe_div(op, (F.col("total_assets") - F.col("short_term_liabilities")).cast("double")),
            "ebit_margin": safe_div(op, rev),
            "current_ratio": safe_div(_d("short_term_assets"), _d("short_term_liabilities")),
            "debt_to_assets": safe_div(tl, ta),
            "debt_to_equity": safe_div(tl, eq),
            "net_debt_to_ebitda": safe_div((F.col("long_term_debt") - F.col("cash")).cast("double"), op),
            "asset_turnover": safe_div(rev, ta),
            "wcta": safe_div((F.col("short_term_assets") - F.col("short_term_liabilities")).cast("double"), ta),
            "reta": safe_div(_d("retained"), ta),
            "market_to_book": F.when(F.col("acctbal") > 0, F.col("acctbal") / 1000.0),
            "revenue_growth_yoy": yoy_growth(rev, F.col("_rev1")),
            "log_revenue": F.when(rev > 0, F.log(rev)),
            "market_cap": ta * 2.0,
        }
        base = cur.select("ticker", "sector", "data_source", *[exprs[k].alias(k) for k in FEATURES])
    out = base.join(rating, "ticker", "left")
    return out.select("ticker", "sector", "data_source", "credit_rating",
                      F.col("credit_rating").isNotNull().alias("has_rating"), *FEATURES)
