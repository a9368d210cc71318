"""Registered queries: item catalogue (S16), required-statement gate (C6),
manual-input fill gate (C7), rated-list loader (S7 / A4), grade-dedup (A3),
class counts (A13), weight summary (A14), foreign proxies (G1) and scalar
helpers (X10-X14, X16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.functions import scalars as sc
from ratingspark.operators import features as fe
from ratingspark.operators import labels as lb
from ratingspark.operators import mapping as mp
from ratingspark.plans import q_model as qm
from ratingspark.plans import sql_model as sm
from ratingspark.plans.registry import register
from ratingspark.plans.sql_bindings import base_ctes, q
from ratingspark.plans.sql_firms import clip, fold_sql, ordinal_sql
from ratingspark.sources import bindings as b
from ratingspark.sources import firms as fr
from ratingspark.sources import ingest

W = qm.W
FN = fv.FEATURE_NAMES


def WS(*extra: str) -> str:
    return "WITH " + ",\n".join([base_ctes("statement_item"), *extra])


@register("s16_item_catalogue", sql=WS() + """
SELECT statement, item_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(value) AS BIGINT) AS n_values,
       CAST(count(DISTINCT ticker) AS BIGINT) AS n_tickers, CAST(count(DISTINCT period) AS BIGINT) AS n_periods,
       max(CASE WHEN value IS NOT NULL THEN period END) AS newest_period,
       round(max(CASE WHEN value IS NOT NULL THEN {'p': period, 't': ticker, 'v': value} END).v, 6) + 0.0 AS newest_value
FROM statement_item GROUP BY statement, item_id""")
def s16_item_catalogue(spark, sf):
    return ingest.item_catalogue(b.statement_item(spark, sf))


@register("s16_item_search", sql=WS() + """
SELECT statement, item_id, CAST(count(value) AS BIGINT) AS n_values FROM statement_item
WHERE lower(item_id) LIKE '%revenue%' OR lower(item_id) LIKE '%asset%' GROUP BY statement, item_id""")
def s16_item_search(spark, sf):
    """Catalogue entries by keyword."""
    found = ingest.search_items(ingest.item_catalogue(b.statement_item(spark, sf)), ["Revenue", "asset"])
    return found.select("statement", "item_id", "n_values")


@register("s6_directory_scan", sql=W() + "\nSELECT " + qm.rsel(qm.META + qm.FEATURES, set(qm.FEATURES))
          + ", 1 AS n_files FROM feats")
def s6_directory_scan(spark, sf):
    """Feature rows landed as a directory of small CSV files, read back as one
    table; each row comes from exactly one of the files."""
    import uuid

    from ratingspark.session import scratch_path
    f = qm.feats(spark, sf)
    path = scratch_path(spark, f"export/cache-{uuid.uuid4().hex}")
    ingest.write_stage(f.repartition(20, "ticker"), path, fmt="csv")
    rows = ingest.read_directory(spark, path, f.schema)
    return rows.withColumn("n_files", (F.length("source_file") > 0).cast("int")).drop("source_file")


@register("c6_required_statements", sql=WS() + """
SELECT ticker FROM statement_item WHERE statement IN ('balance', 'income')
GROUP BY ticker HAVING count(DISTINCT statement) = 2""")
def c6_required_statements(spark, sf):
    """Tickers whose landed statements include both balance and income."""
    s = b.statement_item(spark, sf).filter(F.col("statement").isin("balance", "income"))
    return s.groupBy("ticker").agg(F.count_distinct("statement").alias("_n")).filter("_n = 2").select("ticker")


_MANUAL = [FN[n] for n in fv.MANUAL_INPUT_FEATURES]


@register("c7_min_filled", sql=W() + "\nSELECT ticker, CAST(" + " + ".join(
    f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _MANUAL) + " AS BIGINT) AS n_filled, ("
    + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _MANUAL)
    + f") < {fv.MIN_FILLED_MANUAL} AS too_sparse FROM feats")
def c7_min_filled(spark, sf):
    return mp.filled_count(qm.feats(spark, sf), _MANUAL)


def _upper_fold_sql(x: str) -> str:
    t = f"upper(trim(coalesce({x}, '')))"
    return f"coalesce({fold_sql(t)}, {t})"


@register("s7_a4_rated_list", sql=W() + f"""
SELECT upper(trim(ticker)) AS ticker, arg_max({_upper_fold_sql('raw_rating')}, event_id) AS credit_rating
FROM rating_event WHERE upper(trim(ticker)) <> '' GROUP BY upper(trim(ticker))""")
def s7_a4_rated_list(spark, sf):
    """Rated list: normalised ticker, folded grade, last row (by input
    position) wins."""
    events = b.rating_event(spark, sf)
    return ingest.rated_list(events.select(F.col("ticker").alias("Symbol"), F.col("raw_rating").alias("Rating"),
                                           "event_id"), "event_id")


@register("a3_dedup_ticker_grade", sql=W() + f"""
SELECT ticker, {fold_sql('raw_rating')} AS grade, CAST(count(*) AS BIGINT) AS n_events,
       CAST(max(event_id) AS BIGINT) AS last_event
FROM rating_event GROUP BY ticker, {fold_sql('raw_rating')}""")
def a3_dedup_ticker_grade(spark, sf):
    """One row per (ticker, folded grade) with its multiplicity."""
    ev = b.rating_event(spark, sf).withColumn("grade", sc.fold_grade(F.col("raw_rating")))
    return ev.groupBy("ticker", "grade").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))


_LBL = f"lbl AS (SELECT ticker, {ordinal_sql('credit_rating')} AS rating_ordinal FROM train_clean)"


@register("a13_class_counts", sql=W(qm.MERGE, qm.CLEAN, _LBL) + f"""
SELECT CAST(rating_ordinal AS BIGINT) AS rating_ordinal, CAST(n AS BIGINT) AS n,
       round(avg(n) OVER (), 6) + 0.0 AS mean_size, n < {fv.MIN_CLASS_SIZE} AS is_rare,
       n < 0.5 * avg(n) OVER () AS is_minority
FROM (SELECT rating_ordinal, count(*) AS n FROM lbl GROUP BY rating_ordinal) t""")
def a13_class_counts(spark, sf):
    """Class sizes, mean class size, rare (< 3) and minority (< half the mean)
    flags — the inputs of the rare-class merge and the resampling trigger."""
    from pyspark.sql import Window
    c = lb.encode(qm.cleaned(spark, sf)).groupBy("rating_ordinal").agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # <= 10 class rows
    m = F.avg("n").over(w)
    return c.select("rating_ordinal", "n", m.alias("mean_size"), (F.col("n") < fv.MIN_CLASS_SIZE).alias("is_rare"),
                    (F.col("n") < m * 0.5).alias("is_minority"))


_DW = []
for _name, _mu in fv.LOCAL_MARKET_PROFILE.items():
    _DW.append(f"power((coalesce({FN[_name]}, {_mu!r}) - {_mu!r}) / {fv.LOCAL_MARKET_STD[_name]!r}, 2)")
_DWEIGHT = (f"{fv.DOMAIN_BASE_WEIGHT!r} + {fv.DOMAIN_MAX_WEIGHT - fv.DOMAIN_BASE_WEIGHT!r} * "
            f"exp(-sqrt(({' + '.join(_DW)}) / {len(_DW)}))")


@register("a14_weight_summary", sql=W(qm.MERGE, qm.CLEAN) + f"""
SELECT round(min(w), 6) + 0.0 AS min_weight, round(max(w), 6) + 0.0 AS max_weight, round(avg(w), 6) + 0.0 AS mean_weight,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT {_DWEIGHT} AS w FROM train_clean WHERE coalesce(data_source, '') <> 'vietnam') t""")
def a14_weight_summary(spark, sf):
    c = qm.cleaned(spark, sf)
    w = c.filter(F.coalesce(F.col("data_source"), F.lit("")) != "vietnam").select(fe.domain_weight(c).alias("w"))
    return w.agg(F.min("w").alias("min_weight"), F.max("w").alias("max_weight"), F.avg("w").alias("mean_weight"),
                 F.count("*").alias("n"))


def _growth_sql() -> str:
    whens = " ".join(f"WHEN sector = {q(k)} THEN {v!r}" for k, v in fv.FOREIGN_SECTOR_GROWTH.items())
    return f"CASE {whens} ELSE {fv.FOREIGN_SECTOR_GROWTH_DEFAULT!r} END"


_G1 = [
    ("net_debt_to_ebitda_proxy", clip("debt_to_assets * 3 / (CASE WHEN ebit_margin IS NOT NULL THEN "
                                      "greatest(ebit_margin, 0.01) END)", -5.0, 30.0)),
    ("wcta_proxy", clip("(cr - 1) / cr * 0.3", -0.5, 0.8)),
    ("reta_proxy", clip("roe * 0.6", -1.0, 1.0)),
    ("market_to_book_proxy", "2.0"),
    ("revenue_growth_proxy", _growth_sql()),
    ("log_revenue_proxy", "8.5"),
    ("market_cap_proxy", "1e9"),
]


@register("g1_foreign_proxies", sql=W() + "\nSELECT ticker, " + ", ".join(
    f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}" for n, e in _G1)
    + " FROM (SELECT *, CASE WHEN current_ratio IS NOT NULL THEN greatest(current_ratio, 0.1) END AS cr FROM feats)"
      " t WHERE data_source = 'kaggle'")
def g1_foreign_proxies(spark, sf):
    """Proxies a foreign ratio file would get, computed for the foreign rows."""
    f = qm.feats(spark, sf).filter(F.col("data_source") == "kaggle")
    return mp.foreign_proxies(f)


@register("x10_x16_scalars", sql=W() + f"""
SELECT f.ticker, f.sector IN ({", ".join(q(s) for s in fv.FINANCIAL_SECTORS)}) AS is_financial,
       coalesce(trim(f.company_name), '') AS safe_name,
       replace(upper(substr(f.company_name, 1, 6)), ' ', '') AS name_id,
       lower(trim(regexp_replace(f.company_name || ' (' || f.sector_raw || ')', '\\s*\\(.*?\\)\\s*', '', 'g'))) AS stripped,
       round(CASE WHEN x.roa IS NOT NULL AND abs(x.roa * 100) > 1 THEN x.roa * 100 / 100.0 ELSE x.roa * 100 END, 6) + 0.0
         AS roa_from_percent,
       round(ln(1 + abs(x.market_cap)), 6) + 0.0 AS log_size
FROM firm f JOIN feats x ON x.ticker = f.ticker""")
def x10_x16_scalars(spark, sf):
    """Financial flag (X10), safe string (X11), percent heuristic (X12),
    log size (X13), id from name (X14), label normaliser (X16)."""
    f = b.firm(spark, sf).select("ticker", "sector", "company_name", "sector_raw")
    x = qm.feats(spark, sf).select("ticker", "roa", "market_cap")
    j = f.join(x, "ticker")
    label = F.concat(F.col("company_name"), F.lit(" ("), F.col("sector_raw"), F.lit(")"))
    return j.select(
        "ticker", sc.is_financial(F.col("sector")).alias("is_financial"),
        sc.safe_str(F.col("company_name")).alias("safe_name"),
        sc.id_from_name(F.col("company_name")).alias("name_id"),
        sc.strip_parens(label).alias("stripped"),
        sc.percent_to_ratio(F.col("roa") * 100, heuristic=True).alias("roa_from_percent"),
        sc.log_size(F.col("market_cap")).alias("log_size"))


@register("s5_streaming_ingest", sql=WS() + """
SELECT ticker, statement, period, CAST(item_pos AS BIGINT) AS item_pos, item_id, round(value, 6) + 0.0 AS value
FROM statement_item""")
def s5_streaming_ingest(spark, sf):
    """Two drops of the landed statements streamed through the cached ingest:
    every ticker's rows end up in the store exactly once."""
    from ratingspark.streaming.ingest import ingest_statements
    return ingest_statements(spark, b.statement_item(spark, sf)).select(
        "ticker", "statement", "period", "item_pos", "item_id", "value")


# ---------------------------------------------------------------- S1 / S2, S8, S10-S12
@register("s1_s2_csv_roundtrip", sql=W() + "\nSELECT " + qm.rsel(qm.META + qm.FEATURES, set(qm.FEATURES))
          + " FROM feats")
def s1_s2_csv_roundtrip(spark, sf):
    """Feature rows exported as header CSV (stage sink) under the shared
    folder and read back with an explicit schema (no inference pass)."""
    import uuid

    from ratingspark.session import scratch_path
    f = qm.feats(spark, sf)
    path = scratch_path(spark, f"export/features-{uuid.uuid4().hex}")
    ingest.write_stage(f, path, fmt="csv")
    return ingest.read_csv(spark, path, f.schema)


@register("s8_rating_history", sql=W() + """
SELECT ticker, CAST(event_id AS BIGINT) AS event_id, CAST(rated_on AS VARCHAR) AS rated_on FROM latest_rating""")
def s8_rating_history(spark, sf):
    """Rating history with day-first date text: parse (bad text -> null) and
    keep the newest observation per ticker."""
    ev = b.rating_event(spark, sf).select("ticker", "event_id",
                                          F.date_format("rated_on", "dd/MM/yyyy").alias("date_text"))
    parsed = ev.withColumn("rated_on", ingest.parse_day_first(F.col("date_text")))
    latest = fr.latest_per_key(parsed, "ticker", F.col("rated_on"), F.col("event_id"))
    return latest.select("ticker", "event_id", F.col("rated_on").cast("string").alias("rated_on"))


@register("s10_s11_profile_by_exchange", sql=W() + """
SELECT ticker, exchange, company_name FROM firm WHERE upper(exchange) = 'ASIA'""")
def s10_s11_profile_by_exchange(spark, sf):
    """Company profile (first non-blank name / exchange) and the universe of
    one exchange, matched case-insensitively."""
    prof = ingest.company_profile(b.firm(spark, sf))
    return ingest.universe_by_exchange(prof, "asia")


@register("s12_ticker_list", sql=W() + """
SELECT DISTINCT upper(ticker) AS ticker FROM firm""")
def s12_ticker_list(spark, sf):
    """Ticker lists typed as text (``" f1 ,, F1"``) parsed to upper-cased,
    trimmed, non-empty tickers."""
    txt = b.firm(spark, sf).select(F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ,, "), F.col("ticker")).alias("t"))
    return txt.select(F.explode(ingest.parse_ticker_list(F.col("t"))).alias("ticker")).distinct()


# ---------------------------------------------------------------- P1, P2, P6, P8, P12
_DISPLAY = {v: k for k, v in FN.items()}


def _file_like(df):
    """The feature rows as an unknown file would carry them: display names in
    upper case, meta names with blanks, one canonical column missing."""
    cols = [F.col("ticker").alias("TICKER"), F.col("sector").alias("sector"),
            F.col("credit_rating").alias("credit rating")]
    cols += [F.col(c).alias(_DISPLAY[c].upper()) for c in qm.FEATURES if c != "market_cap"]
    return df.select(*cols)


_P_OUT = ["Ticker", "Sector", "Credit_Rating"] + [_DISPLAY[c] for c in qm.FEATURES]


@register("p1_p2_p6_p8_generic_mapping", sql=W() + "\nSELECT ticker AS \"Ticker\", sector AS \"Sector\", "
          + "credit_rating AS \"Credit_Rating\", " + ", ".join(
              f"round({c}, 6) + 0.0 AS \"{_DISPLAY[c]}\"" for c in qm.FEATURES if c != "market_cap")
          + ", CAST(NULL AS DOUBLE) AS \"Market_Cap\", 'unknown' AS data_source FROM feats")
def p1_p2_p6_p8_generic_mapping(spark, sf):
    """A feature file of unknown origin: detected by column signature (P1),
    dispatched (P2) to the generic mapper (P6), missing canonical columns
    added as null (P8)."""
    raw = _file_like(qm.feats(spark, sf))
    mapped = mp.add_missing(mp.map_any(raw), [_DISPLAY[c] for c in qm.FEATURES])
    return mp.with_identity_defaults(mapped).select(*[F.col(f"`{c}`") for c in _P_OUT], "data_source")


def _a11_sql() -> str:
    present = [c for c in qm.FEATURES if c != "market_cap"]
    parts = ["SELECT 'n_records' AS item, CAST(count(*) AS VARCHAR) AS value FROM feats",
             "SELECT 'missing_feature_cols', 'Market_Cap'",
             "SELECT 'missing_meta_cols', ''",
             "SELECT 'is_valid', 'false'"]
    for c in present:
        pct = f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 1)"
        parts.append(f"SELECT 'null_pct:{_DISPLAY[c]}', CAST(CAST({pct} AS DOUBLE) AS VARCHAR) FROM feats "
                     f"HAVING {pct} > 0")
    return W() + "\n" + "\nUNION ALL ".join(parts)


@register("a11_validation_report", sql=_a11_sql())
def a11_validation_report(spark, sf):
    """Validation report of the mapped file of unknown origin (one canonical
    feature column is absent)."""
    return mp.validation_report(mp.map_any(_file_like(qm.feats(spark, sf))))


# ---------------------------------------------------------------- X5, S9, S15
@register("x5_numeric_coercion", sql=W() + """
SELECT ticker, TRY_CAST(CAST(acctbal AS VARCHAR) AS DOUBLE) AS acctbal_num,
       TRY_CAST(company_name AS DOUBLE) AS name_num FROM firm""")
def x5_numeric_coercion(spark, sf):
    """Text cells coerced to numbers; text that does not parse becomes null."""
    f = b.firm(spark, sf)
    return f.select("ticker", sc.to_double(F.col("acctbal").cast("string")).alias("acctbal_num"),
                    sc.to_double(F.col("company_name")).alias("name_num"))


@register("s9_sector_listing", sql=W() + """
SELECT upper(ticker) AS ticker, arg_max(trim(sector_raw), firm_id) AS sector_vn FROM firm
WHERE trim(sector_raw) IS NOT NULL AND trim(sector_raw) NOT IN ('', 'nan', 'None') GROUP BY upper(ticker)""")
def s9_sector_listing(spark, sf):
    """Listing file with aliased columns (symbol / industry name): blank and
    'nan' sectors dropped, ticker upper-cased, last row wins."""
    listing = b.firm(spark, sf).select(F.col("ticker").alias("symbol"), F.col("sector_raw").alias("industry_name"),
                                       "firm_id")
    return ingest.sector_listing(listing, "firm_id")


@register("s15_flatten_columns", sql=W() + """
SELECT ticker, round(roa, 6) + 0.0 AS ratios_roa, round(roe, 6) + 0.0 AS ratios_roe,
       round(debt_to_assets, 6) + 0.0 AS ratios_leverage_debt_to_assets FROM feats""")
def s15_flatten_columns(spark, sf):
    """Nested (multi-level) column names flattened by joining the path."""
    f = qm.feats(spark, sf)
    nested = f.select("ticker", F.struct("roa", "roe", F.struct("debt_to_assets").alias("leverage")).alias("ratios"))
    return ingest.flatten_columns(nested)


# ---------------------------------------------------------------- P3, P4, X3, X8, G1 (foreign ratio file)
#: Sector names of the foreign file for the binding's sectors.
_FOREIGN_SECTOR = {"Manufacturing": "Capital Goods", "RealEstate": "Miscellaneous", "Transportation": "Transportation",
                   "Retail": "Consumer Services"}
_FOREIGN_COLUMNS = {"returnOnAssets": "roa", "returnOnEquity": "roe", "returnOnCapitalEmployed": "roce",
                    "currentRatio": "current_ratio", "debtRatio": "debt_to_assets", "debtEquityRatio": "debt_to_equity",
                    "assetTurnover": "asset_turnover"}


def foreign_file(spark, sf, sectors=None, unlisted="unlisted"):
    """The foreign firms as a ratio file: one row per rating, camel-case
    ratios, no operating margin, an equity multiplier and cash per share."""
    f = qm.feats(spark, sf).where("data_source = 'kaggle'")
    e = b.rating_event(spark, sf).select("ticker", "event_id", "raw_rating", "rated_on")
    sector = F.coalesce(F.try_element_at(sc._map(sectors or _FOREIGN_SECTOR), F.col("sector")), F.lit(unlisted))
    return e.join(f, "ticker").select(
        F.col("raw_rating").alias("Rating"), F.col("ticker").alias("Symbol"), sector.alias("Sector"),
        F.col("rated_on").alias("Date"), "event_id",
        *[F.col(c).alias(name) for name, c in _FOREIGN_COLUMNS.items()],
        F.col("ebit_margin").alias("ebitPerRevenue"), (F.col("debt_to_equity") + 1).alias("companyEquityMultiplier"),
        (F.col("log_revenue") * 100).alias("cashPerShare"))


def _p4_sql() -> str:
    bound = {k: clip(k2, *fv.FOREIGN_CLIP_BOUNDS[k]) for k, k2 in (
        ("ROA", "roa"), ("ROE", "roe"), ("ROCE", "roce"), ("Current_Ratio", "current_ratio"),
        ("Debt/Assets", "debt_to_assets"), ("Debt/Equity", "debt_to_equity"), ("Asset_Turnover", "asset_turnover"))}
    sector = "CASE " + " ".join(f"WHEN f.sector = {q(k)} THEN {q(fv.FOREIGN_SECTOR_MAP[v])}"
                                for k, v in _FOREIGN_SECTOR.items()) + " ELSE 'Other' END"
    da, cr, roe = bound["Debt/Assets"], bound["Current_Ratio"], bound["ROE"]
    low_cr = f"(CASE WHEN {cr} IS NOT NULL THEN greatest({cr}, 0.1) END)"
    margin = "(CASE WHEN ebit_margin IS NOT NULL THEN greatest(ebit_margin, 0.01) END)"
    cash = "(CASE WHEN log_revenue IS NOT NULL THEN greatest(log_revenue * 100, 0.01) END)"
    cols = [*[(k, v) for k, v in bound.items()], ("EBIT_Margin", "ebit_margin"),
            ("Net_Debt/EBITDA", clip(f"{da} * 3 / {margin}", -5.0, 30.0)),
            ("WCTA", clip(f"({low_cr} - 1) / {low_cr} * 0.3", -0.5, 0.8)), ("RETA", clip(f"{roe} * 0.6", -1.0, 1.0)),
            ("Market_to_Book", clip("debt_to_equity + 1 - 1", 0.0, 20.0)),
            ("Revenue_Growth_YoY", _growth_sql().replace("sector =", f"{sector} =")),
            ("Log_Revenue", clip(f"ln(1 + {cash})", 2.0, 14.0)), ("Market_Cap", "1e9")]
    return W() + f"""
SELECT f.ticker AS "Ticker", {fold_sql('l.raw_rating')} AS "Credit_Rating", {sector} AS "Sector", """ + ", ".join(
        f'round(CAST({v} AS DOUBLE), 6) + 0.0 AS "{k}"' for k, v in cols) + f""", 'kaggle' AS data_source
FROM feats f JOIN (SELECT ticker, max({{'d': rated_on, 'e': event_id, 'r': raw_rating}}).r AS raw_rating
                   FROM rating_event GROUP BY ticker) l ON l.ticker = f.ticker
WHERE f.data_source = 'kaggle' AND {fold_sql('l.raw_rating')} IS NOT NULL"""


@register("p4_foreign_mapping", sql=_p4_sql())
def p4_foreign_mapping(spark, sf):
    """The full mapping of a foreign ratio file."""
    out = mp.foreign_mapping(foreign_file(spark, sf), "event_id")
    return out.select("Ticker", "Credit_Rating", "Sector", *[F.col(f"`{_DISPLAY[c]}`") for c in qm.FEATURES], "data_source")


_SECOND_SECTOR = {"Manufacturing": "Materials", "RealEstate": "Real Estate", "Transportation": "Transportation",
                  "Retail": "Consumer Discretionary"}
_P7_OUT = [*fv.SECTOR_MEDIANS_IMPUTE_B[fv.IMPUTE_DEFAULT_SECTOR], "Market_to_Book", "Revenue_Growth_YoY", "Log_Revenue",
           "Market_Cap"]


def _p7_sql() -> str:
    sector = "CASE " + " ".join(f"WHEN f.sector = {q(k)} THEN {q(fv.FOREIGN_SECTOR_MAP_B.get(v, v))}"
                                for k, v in _SECOND_SECTOR.items()) + " ELSE 'Banking' END"
    safe = "(CASE WHEN {0} IS NOT NULL THEN greatest({0}, {1}) END)"
    cols = {"ROA": "roa", "ROE": "roe", "ROCE": "roce", "EBIT_Margin": "ebit_margin", "Current_Ratio": "current_ratio",
            "Debt/Assets": "debt_to_assets", "Debt/Equity": "debt_to_equity", "Asset_Turnover": "asset_turnover",
            "Market_to_Book": "debt_to_equity + 1", "Revenue_Growth_YoY": "0.08",
            "Log_Revenue": "ln(1 + abs(log_revenue * 100))", "Market_Cap": "1e9",
            "WCTA": f"(current_ratio - 1) / {safe.format('current_ratio', 0.1)} * 0.3", "RETA": "roe * 0.5",
            "Net_Debt/EBITDA": f"debt_to_assets / {safe.format('ebit_margin', 0.01)}"}
    table, default = fv.SECTOR_MEDIANS_IMPUTE_B, fv.SECTOR_MEDIANS_IMPUTE_B[fv.IMPUTE_DEFAULT_SECTOR]
    half = {c: v for c, v in cols.items()}
    for c in default:
        whens = " ".join(f"WHEN sector = {q(s)} THEN {float(v[c])!r}" for s, v in table.items() if c in v)
        half[c] = f"coalesce(\"{c}\", CASE {whens} END)"
    return W() + f""", raw AS (SELECT e.event_id, f.ticker, e.raw_rating, {sector} AS sector, {", ".join(
        f'CAST({v} AS DOUBLE) AS "{c}"' for c, v in cols.items())}
  FROM feats f JOIN rating_event e ON e.ticker = f.ticker WHERE f.data_source = 'kaggle'),
half AS (SELECT event_id, ticker, raw_rating, sector, {", ".join(
        f'{half[c]} AS "{c}"' if c in default else f'"{c}"' for c in cols)} FROM raw),
mid AS (SELECT {", ".join(f'quantile_cont("{c}", 0.5) AS "m {c}"' for c in default)} FROM half)
SELECT CAST(event_id AS BIGINT) AS event_id, ticker AS "Ticker", raw_rating AS "Credit_Rating", sector AS "Sector", {", ".join(
        (f'round(coalesce("{c}", "m {c}", {float(default[c])!r}), 6) + 0.0 AS "{c}"' if c in default
         else f'round("{c}", 6) + 0.0 AS "{c}"') for c in _P7_OUT)}
FROM half CROSS JOIN mid"""


@register("p7_g2_i2_second_mapping", sql=_p7_sql())
def p7_g2_i2_second_mapping(spark, sf):
    """The second foreign mapper (P7) with its proxies (G2), then its
    imputation (I2), over the rating rows of the foreign firms."""
    from ratingspark.session import materialize
    file = foreign_file(spark, sf, _SECOND_SECTOR, "Banking")
    out = mp.impute_second(materialize(mp.second_foreign_mapping(file), "second-mapping"))
    return out.select("event_id", "Ticker", "Credit_Rating", "Sector", *[F.col(f"`{c}`") for c in _P7_OUT])


# ---------------------------------------------------------------- W6, C4, X7
@register("w6_batch_sector_z", sql=W() + """
SELECT ticker, """ + ", ".join(
    f"round(CASE WHEN sector IS NOT NULL THEN ({c} - avg({c}) OVER (PARTITION BY sector)) / "
    f"(stddev_samp({c}) OVER (PARTITION BY sector) + 1e-8) END, 6) + 0.0 AS {c}_batch_z" for c in ("roa", "debt_to_assets"))
    + " FROM feats")
def w6_batch_sector_z(spark, sf):
    """Sector z-scores of a batch without fitted statistics."""
    return fe.batch_sector_z(qm.feats(spark, sf), ["roa", "debt_to_assets"]).select(
        "ticker", "roa_batch_z", "debt_to_assets_batch_z")


_REQUIRED = [FN[c] for c in fv.REQUIRED_FEATURES]


@register("c4_missing_features", sql=W() + """
SELECT ticker, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN {c} IS NULL THEN {q(c)} END" for c in _REQUIRED)
          + "], lambda x: x IS NOT NULL), ',') AS missing, CAST(" + " + ".join(
              f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _REQUIRED) + """ AS BIGINT) AS n_missing FROM feats""")
def c4_missing_features(spark, sf):
    """The required features that each firm lacks, by name, and their number."""
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in _REQUIRED]))
    return qm.feats(spark, sf).select("ticker", F.array_join(absent, ",").alias("missing"),
                                      F.size(absent).alias("n_missing"))


@register("x7_extended_scale", sql=W() + """
SELECT raw_rating, CAST(coalesce(list_position(""" + "[" + ", ".join(q(g) for g in fv.RATING_SCALE_EXTENDED)
          + f"""], raw_rating) - 1, {fv.UNKNOWN_ORDINAL}) AS BIGINT) AS step, CASE raw_rating """
          + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.EXTENDED_TO_STANDARD.items())
          + """ END AS standard, CAST(count(*) AS BIGINT) AS n FROM rating_event GROUP BY ALL""")
def x7_extended_scale(spark, sf):
    """Rating events on the 20-step scale: the step and its standard grade."""
    ev = b.rating_event(spark, sf).groupBy("raw_rating").agg(F.count("*").alias("n"))
    return ev.select("raw_rating", sc.grade_ordinal(F.col("raw_rating"), fv.RATING_SCALE_EXTENDED).alias("step"),
                     F.try_element_at(sc._map(fv.EXTENDED_TO_STANDARD), F.col("raw_rating")).alias("standard"), "n")
