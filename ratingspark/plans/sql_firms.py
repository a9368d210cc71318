"""Oracle SQL (DuckDB) for the firm-level bindings: latest rating, rating
pairs and canonical feature rows. Independent set-based restatement of
``ratingspark.sources.firms``."""

from __future__ import annotations

from ratingspark.functions import fixed_values as fv
from ratingspark.plans.sql_bindings import base_ctes, q

FEATURES = list(fv.FEATURE_NAMES.values())


def fold_sql(x: str) -> str:
    whens = " ".join(f"WHEN {x} = {q(k)} THEN {q(v)}" for k, v in fv.RATING_NORMALIZE.items())
    return f"CASE {whens} END"


def ordinal_sql(x: str) -> str:
    whens = " ".join(f"WHEN {x} = {q(g)} THEN {i}" for i, g in enumerate(fv.RATING_SCALE))
    return f"CASE {whens} ELSE {fv.UNKNOWN_ORDINAL} END"


def sdiv(n: str, d: str) -> str:
    return f"(CASE WHEN ({n}) IS NOT NULL AND ({d}) IS NOT NULL AND abs({d}) >= 1e-9 THEN ({n}) / ({d}) END)"


def clip(x: str, lo, hi) -> str:
    """Null-preserving clip; bound None = open."""
    out = f"({x})"
    if hi is not None:
        out = f"least({out}, {hi})"
    if lo is not None:
        out = f"greatest({out}, {lo})"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {out} END)"


LATEST_RATING = f"""
latest_rating AS (
  SELECT ticker, event_id, rated_on, agency, raw_rating, {fold_sql('raw_rating')} AS credit_rating
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rated_on DESC NULLS LAST, event_id DESC) AS rn
        FROM rating_event) t
  WHERE rn = 1
)"""

RATING_PAIR = f"""
rating_pair AS (
  SELECT ticker, max(CASE WHEN rn = 1 THEN grade END) AS truth, max(CASE WHEN rn = 2 THEN grade END) AS pred
  FROM (SELECT ticker, grade,
               row_number() OVER (PARTITION BY ticker ORDER BY rated_on DESC NULLS LAST, event_id DESC) AS rn
        FROM (SELECT *, {fold_sql('raw_rating')} AS grade FROM rating_event) e
        WHERE grade IS NOT NULL) t
  WHERE rn <= 2
  GROUP BY ticker
  HAVING max(CASE WHEN rn = 2 THEN grade END) IS NOT NULL
)"""


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


_EXPRS = {
    "roa": sdiv(_d("y.net_profit_after_tax"), _d("y.total_assets")),
    "roe": sdiv(_d("y.net_profit_after_tax"), _d("y.total_assets - y.total_liabilities")),
    "roce": sdiv(_d("y.operating_profit"), _d("y.total_assets - y.short_term_liabilities")),
    "ebit_margin": sdiv(_d("y.operating_profit"), _d("y.net_revenue")),
    "current_ratio": sdiv(_d("y.short_term_assets"), _d("y.short_term_liabilities")),
    "debt_to_assets": sdiv(_d("y.total_liabilities"), _d("y.total_assets")),
    "debt_to_equity": sdiv(_d("y.total_liabilities"), _d("y.total_assets - y.total_liabilities")),
    "net_debt_to_ebitda": sdiv(_d("y.long_term_debt - y.cash"), _d("y.operating_profit")),
    "asset_turnover": sdiv(_d("y.net_revenue"), _d("y.total_assets")),
    "wcta": sdiv(_d("y.short_term_assets - y.short_term_liabilities"), _d("y.total_assets")),
    "reta": sdiv(_d("y.retained"), _d("y.total_assets")),
    "market_to_book": "CASE WHEN f.acctbal > 0 THEN f.acctbal / 1000.0 END",
    "revenue_growth_yoy": (
        "CASE WHEN y.net_revenue IS NOT NULL AND p.rev1 IS NOT NULL AND abs(p.rev1) >= 1e-9 THEN "
        + clip(f"({_d('y.net_revenue')} - p.rev1) / abs(p.rev1)", -0.9, 5.0) + " END"),
    "log_revenue": f"CASE WHEN {_d('y.net_revenue')} > 0 THEN ln({_d('y.net_revenue')}) END",
    "market_cap": f"{_d('y.total_assets')} * 2.0",
}

FEATS = f"""
fy_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY period DESC) AS rn FROM firm_year
),
feats AS (
  SELECT f.ticker, f.sector, f.data_source, r.credit_rating, r.credit_rating IS NOT NULL AS has_rating,
    {", ".join(f"{_EXPRS[k]} AS {k}" for k in FEATURES)}
  FROM fy_ranked y
  JOIN firm f ON f.firm_id = y.firm_id
  LEFT JOIN (SELECT firm_id, {_d('net_revenue')} AS rev1 FROM fy_ranked WHERE rn = 2) p ON p.firm_id = y.firm_id
  LEFT JOIN latest_rating r ON r.ticker = f.ticker
  WHERE y.rn = 1
)"""


def current_sql(max_age: int) -> str:
    """CTE ``feats_now``: the feature rows with the newest grade, if it is
    recent enough on the day of the newest observation of all."""
    return f"""
feats_now AS (
  SELECT f.* REPLACE (r.credit_rating AS credit_rating, r.credit_rating IS NOT NULL AS has_rating)
  FROM feats f LEFT JOIN (
    SELECT l.ticker, l.credit_rating FROM latest_rating l CROSS JOIN (SELECT max(rated_on) AS today FROM rating_event) t
    WHERE date_diff('day', CAST(l.rated_on AS DATE), CAST(today AS DATE)) <= {max_age}) r ON r.ticker = f.ticker
)"""


def firm_ctes(*extra: str) -> str:
    """Base CTEs plus latest_rating, rating_pair and feats."""
    return ",\n".join([base_ctes("firm", "firm_year", "rating_event"), LATEST_RATING.strip(),
                       RATING_PAIR.strip(), FEATS.strip(), *[e.strip() for e in extra]])
