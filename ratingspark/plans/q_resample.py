"""Registered queries of the neighbour join (J8) and of resampling (M5), on the
cleaned rows. The oracle compares all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.operators.neighbours import nearest
from ratingspark.operators.resample import smote_tomek
from ratingspark.plans.q_model import cleaned
from ratingspark.plans.registry import ORACLES, finalize, register, rnd

#: The ratios; amounts of another scale would decide every distance.
RATIOS = ["roa", "roe", "roce", "ebit_margin", "current_ratio", "debt_to_assets", "debt_to_equity", "net_debt_to_ebitda",
          "asset_turnover", "wcta", "reta", "market_to_book", "revenue_growth_yoy", "log_revenue"]
APART = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in RATIOS)


def _rows(spark, sf):
    """Cleaned rows as the oracle sees them, rounded; the ends of the scale join
    their neighbour class."""
    band = F.expr("CASE credit_rating WHEN 'AAA' THEN 'AA' WHEN 'D' THEN 'CC' ELSE credit_rating END")
    return finalize(cleaned(spark, sf).select("ticker", "copy_no", "credit_rating", *RATIOS)).select(
        F.concat_ws("#", "ticker", F.col("copy_no").cast("string")).alias("firm"), band.alias("band"), *RATIOS)


_ROWS = f"""clean_rows AS ({ORACLES["i4_clean"]}),
firms AS (SELECT ticker || '#' || CAST(copy_no AS VARCHAR) AS firm,
    CASE credit_rating WHEN 'AAA' THEN 'AA' WHEN 'D' THEN 'CC' ELSE credit_rating END AS band, {", ".join(RATIOS)}
    FROM clean_rows WHERE credit_rating IS NOT NULL)"""


def _near(name: str, rows: str, same: str) -> str:
    return f"""{name} AS (SELECT a.firm, b.firm AS neighbour, a.band, b.band AS other, sqrt({APART}) AS distance,
    row_number() OVER (PARTITION BY a.firm ORDER BY {APART}, b.firm) AS rank
    FROM {rows} a JOIN {rows} b ON {same} a.firm <> b.firm)"""


@register("j8_class_neighbours", sql=f"""WITH {_ROWS}, {_near("near", "firms", "a.band = b.band AND")}
SELECT firm, band, CAST(rank AS BIGINT) AS rank, neighbour, {rnd("distance", "distance")} FROM near WHERE rank <= 5""")
def j8_class_neighbours(spark, sf):
    """The five nearest firms of the same rating band."""
    rows = _rows(spark, sf)
    near = nearest(rows.select("firm", "band", F.array(*RATIOS).alias("vector")), 5, "firm", "vector", "band")
    return (near.withColumnRenamed("key", "firm").join(rows.select("firm", "band"), "firm")
            .select("firm", "band", "rank", "neighbour", "distance"))


def _digest(what: str) -> str:
    return f"CAST('0x' || substr(md5(d.firm || '#' || CAST(copy AS VARCHAR) || '#{what}{fv.SEED}'), 1, 8) AS BIGINT)"


_SMOTE = f"""sizes AS (SELECT band, count(*) AS n FROM firms GROUP BY band),
trigger AS (SELECT max(n) AS most, greatest(1, least(5, min(n) - 1)) AS k FROM sizes
    HAVING sum(n) >= 15 AND min(n) >= 2 AND min(n) < avg(n) / 2),
need AS (SELECT band, n, most - n AS need, k FROM sizes, trigger WHERE n < most),
{_near("near", "firms", "a.band = b.band AND")},
dealt AS (SELECT f.*, need, n, k, row_number() OVER (PARTITION BY f.band ORDER BY md5(firm || '#{fv.SEED}'), firm) AS r
    FROM firms f JOIN need ON need.band = f.band),
drawn AS (SELECT d.*, copy FROM dealt d, unnest(range(need // n + CASE WHEN r <= need % n THEN 1 ELSE 0 END)) t(copy)),
made AS (SELECT d.firm || '~' || CAST(copy AS VARCHAR) AS firm, d.band,
    {", ".join(f"d.{f} + {_digest('l')} / 4294967296.0::DOUBLE * (o.{f} - d.{f}) AS {f}" for f in RATIOS)}
    FROM drawn d JOIN near x ON x.firm = d.firm AND x.rank = {_digest('n')} % d.k + 1 JOIN firms o ON o.firm = x.neighbour),
both_rows AS (SELECT firm, band, {", ".join(RATIOS)}, false AS is_synthetic FROM firms
    UNION ALL SELECT firm, band, {", ".join(RATIOS)}, true FROM made),
{_near("closest", "both_rows", "")},
links AS (SELECT a.firm FROM closest a JOIN closest b ON b.firm = a.neighbour AND b.neighbour = a.firm
    WHERE a.rank = 1 AND b.rank = 1 AND a.band <> a.other AND (SELECT count(*) FROM trigger) > 0)"""


@register("m5_smote_tomek", sql=f"""WITH {_ROWS}, {_SMOTE}
SELECT firm, band, is_synthetic, {", ".join(rnd(f, f) for f in RATIOS)},
    CASE WHEN (SELECT count(*) FROM trigger) = 0 THEN 1.0 END AS weight
FROM both_rows WHERE firm NOT IN (SELECT firm FROM links)""")
def m5_smote_tomek(spark, sf):
    """The rated rows, resampled: synthetic rows of the rare bands, no Tomek
    links, and no weights afterwards."""
    rows = _rows(spark, sf).where("band is not null").withColumn("weight", F.lit(1.0))
    return smote_tomek(rows, "firm", "band", RATIOS, weight="weight").select("firm", "band", "is_synthetic", *RATIOS, "weight")
