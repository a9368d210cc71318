"""Oracle SQL for the derived fundamentals (D15 adapter rows, B crawl rows)."""

from __future__ import annotations

from ratingspark.functions import fixed_values as fv
from ratingspark.plans.sql_bindings import normalize_sector_sql, q

FEATURES = list(fv.FEATURE_NAMES.values())


def sdiv(n: str, d: str) -> str:
    return f"(CASE WHEN ({n}) IS NOT NULL AND ({d}) IS NOT NULL AND abs({d}) >= 1e-9 THEN ({n}) / ({d}) END)"


def zdiv(n: str, d: str) -> str:
    return f"(CASE WHEN ({n}) IS NOT NULL AND ({d}) IS NOT NULL AND ({d}) <> 0 THEN ({n}) / ({d}) END)"


def truthy(x: str) -> str:
    return f"(({x}) IS NOT NULL AND ({x}) <> 0)"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {lo} THEN {lo} WHEN ({x}) > {hi} THEN {hi} ELSE ({x}) END)"


def fin_list() -> str:
    return ", ".join(q(s) for s in fv.FINANCIAL_SECTORS)


def adapter_sql(gate: bool = True) -> str:
    """CTE ``adapter`` over ``wide_a`` and ``firm``."""
    bank_lines = ["is_net_interest_income_0", "is_bank_fee_income_0", "is_bank_fx_income_0",
                  "is_bank_trading_income_0", "is_bank_investment_income_0", "is_bank_other_income_0",
                  "is_bank_dividend_income_0"]
    total_income = " + ".join(f"coalesce({c}, 0.0)" for c in bank_lines)
    ebit_paths = [
        ("is_ebit_0 IS NOT NULL", "is_ebit_0", "direct"),
        ("is_profit_before_tax_0 IS NOT NULL", "is_profit_before_tax_0 + ie", "pbt_plus_interest"),
        ("is_gross_profit_0 IS NOT NULL",
         "is_gross_profit_0 - coalesce(is_selling_expenses_0, 0.0) - coalesce(is_admin_expenses_0, 0.0)",
         "gross_minus_opex"),
        ("is_net_income_0 IS NOT NULL AND ie <> 0", "is_net_income_0 + ie", "ni_plus_interest"),
        ("is_net_income_0 IS NOT NULL AND NOT _is_bank", "is_net_income_0", "net_income"),
        ("_is_bank AND is_bank_operating_profit_0 IS NOT NULL", "is_bank_operating_profit_0",
         "bank_operating_profit"),
        ("_is_bank AND is_net_interest_income_0 IS NOT NULL", "is_net_interest_income_0",
         "bank_net_interest_income"),
    ]
    ebit = "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e, _ in ebit_paths) + " END"
    ebit_path = "CASE " + " ".join(f"WHEN {c} THEN {q(n)}" for c, _, n in ebit_paths) + " END"
    ta, te, cl, ca = "bs_total_assets_0", "bs_total_equity_0", "bs_short_term_liabilities_0", "bs_short_term_assets_0"
    loans, dep = "bs_loans_to_customers_0", "bs_customer_deposits_0"
    ca_alt, cl_alt = "bs_short_term_assets_alt_0", "bs_short_term_liabilities_alt_0"
    cr_rt = "rt_current_ratio_direct_0"
    bank_paths = [
        (f"{loans} IS NOT NULL AND {dep} IS NOT NULL AND {dep} > 0", f"{loans} / {dep}", loans, dep,
         "loans_to_deposits"),
        (f"{ta} IS NOT NULL AND {dep} IS NOT NULL AND {dep} > 0",
         f"least(({ta} - coalesce(bs_fixed_assets_0, 0.0)) / {dep}, 5.0)",
         f"{ta} - coalesce(bs_fixed_assets_0, 0.0)", dep, "liquid_to_deposits"),
        (f"{cr_rt} IS NOT NULL", cr_rt, "NULL", "NULL", "ratio_table"),
        ("TRUE", "0.85", "NULL", "NULL", "bank_default"),
    ]
    other_paths = [
        (f"{ca} IS NOT NULL AND {cl} IS NOT NULL AND {cl} > 0", f"{ca} / {cl}", ca, cl, "ca_cl"),
        (f"{ca_alt} IS NOT NULL AND {cl_alt} IS NOT NULL AND {cl_alt} > 0", f"{ca_alt} / {cl_alt}",
         ca_alt, cl_alt, "alt_names"),
        ("ca_ind IS NOT NULL AND cl_best IS NOT NULL AND cl_best > 0", "ca_ind / cl_best", "ca_ind",
         "cl_best", "assets_less_long_term"),
        ("ca_best IS NOT NULL AND cl_ind IS NOT NULL", "ca_best / cl_ind", "ca_best", "cl_ind",
         "liabilities_less_long_debt"),
        (f"{cr_rt} IS NOT NULL", cr_rt, "NULL", "NULL", "ratio_table"),
        ("ca_best IS NOT NULL AND tl IS NOT NULL AND tl > 0", "ca_best / (tl * 0.6)", "ca_best", "tl * 0.6",
         "liabilities_proxy"),
    ]

    def cr_case(i: int) -> str:
        def one(paths):
            return "CASE " + " ".join(
                f"WHEN {p[0]} THEN {q(p[i]) if i == 4 else '(' + p[i] + ')'}" for p in paths) + " END"
        return f"CASE WHEN _is_bank THEN {one(bank_paths)} ELSE {one(other_paths)} END"

    required = [fv.FEATURE_NAMES[f] for f in fv.REQUIRED_FEATURES]
    n_missing = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in required)
    roce = (f"CASE WHEN rt_roce_direct_0 IS NOT NULL THEN rt_roce_direct_0 / 100.0 "
            f"WHEN ebit IS NULL THEN NULL "
            f"WHEN {ta} IS NOT NULL AND {cl} IS NOT NULL AND {ta} - {cl} > 0 THEN {sdiv('ebit', f'{ta} - {cl}')} "
            f"WHEN {ta} IS NOT NULL AND bs_short_term_liabilities_alt_roce_0 IS NOT NULL "
            f"AND {ta} - bs_short_term_liabilities_alt_roce_0 > 0 "
            f"THEN {sdiv('ebit', f'{ta} - bs_short_term_liabilities_alt_roce_0')} "
            f"WHEN {te} IS NOT NULL AND {te} + ltd > 0 THEN {sdiv('ebit', f'{te} + ltd')} "
            f"WHEN {ta} > 0 THEN {sdiv('ebit', f'{ta} * 0.6')} END")
    em = "rt_ebit_margin_direct_0"
    ebit_margin = (f"coalesce(CASE WHEN {em} IS NOT NULL THEN CASE WHEN abs({em}) > 1.0 THEN {em} / 100.0 ELSE {em} END END, "
                   f"CASE WHEN {truthy('rev')} AND abs(rev) > 1e-9 AND ebit IS NOT NULL THEN {sdiv('ebit', 'rev')} END, "
                   f"CASE WHEN _is_bank AND {truthy('is_net_interest_income_0')} AND {truthy(ta)} "
                   f"THEN {sdiv('is_net_interest_income_0', ta)} END)")
    nim = sdiv("is_net_interest_income_0", ta)
    ebitda = "(CASE WHEN ebit IS NOT NULL THEN ebit + dep END)"
    nd = (f"CASE WHEN _is_bank AND {truthy('is_net_interest_income_0')} AND {truthy(ta)} AND {nim} IS NOT NULL "
          f"THEN {nim} ELSE {sdiv('(ltd + std) - cash', ebitda)} END")
    v0, v1 = "is_revenue_0", "is_revenue_1"
    growth = (f"coalesce(CASE WHEN rt_revenue_growth_pct_0 IS NOT NULL THEN {clip('rt_revenue_growth_pct_0 / 100.0', -0.9, 5.0)} END, "
              f"CASE WHEN _is_bank AND rt_bank_growth_nii_0 IS NOT NULL THEN {clip('rt_bank_growth_nii_0 / 100.0', -0.9, 5.0)} END, "
              f"CASE WHEN _is_bank AND rt_bank_growth_opp_0 IS NOT NULL THEN {clip('rt_bank_growth_opp_0 / 100.0', -0.9, 5.0)} END, "
              f"CASE WHEN {v0} IS NOT NULL AND {v1} IS NOT NULL AND abs({v1}) >= 1e-9 "
              f"THEN {clip(f'({v0} - {v1}) / abs({v1})', -0.9, 5.0)} END)")
    feats = {
        "roa": f"coalesce(nullif({sdiv('is_net_income_0', ta)}, 0.0), rt_roa_0 / 100.0)",
        "roe": f"coalesce(nullif({sdiv('is_net_income_0', te)}, 0.0), rt_roe_0 / 100.0)",
        "roce": roce,
        "ebit_margin": ebit_margin,
        "current_ratio": "cr_ratio",
        "debt_to_assets": sdiv("tl", ta),
        "debt_to_equity": sdiv("tl", te),
        "net_debt_to_ebitda": nd,
        "asset_turnover": sdiv("rev", ta),
        "wcta": f"CASE WHEN cr_ca IS NOT NULL AND cr_cl IS NOT NULL AND {truthy(ta)} THEN {sdiv('cr_ca - cr_cl', ta)} END",
        "reta": sdiv("bs_retained_earnings_0", ta),
        "market_to_book": "rt_price_to_book_0",
        "revenue_growth_yoy": growth,
        "log_revenue": f"CASE WHEN {truthy('rev')} THEN ln(1 + abs(rev)) END",
        "market_cap": "coalesce(rt_market_cap_0, 0.0)",
    }
    nii, no_rev = "is_net_interest_income_0", "(is_revenue_0 IS NULL OR is_revenue_0 = 0)"
    cases = {
        "roce": [("rt_roce_direct_0 IS NOT NULL", "ratio_table"), ("ebit IS NULL", None),
                 (f"{ta} - {cl} > 0", "assets_less_liabilities"),
                 (f"{ta} - bs_short_term_liabilities_alt_roce_0 > 0", "alt_names"),
                 (f"{te} + ltd > 0", "equity_plus_debt"), (f"{ta} > 0", "assets_proxy")],
        "revenue": [(f"_is_bank AND {no_rev} AND total_income > 0", "bank_income_lines"),
                    (f"_is_bank AND {no_rev} AND is_total_operating_income_0 > 0", "bank_operating_income"),
                    ("is_revenue_0 IS NOT NULL", "reported")],
        "liabilities": [("bs_total_liabilities_0 IS NOT NULL", "reported"), ("tl IS NOT NULL", "assets_less_equity")],
        "roa": [(f"{sdiv('is_net_income_0', ta)} <> 0", "statements"), ("rt_roa_0 IS NOT NULL", "ratio_table")],
        "roe": [(f"{sdiv('is_net_income_0', te)} <> 0", "statements"), ("rt_roe_0 IS NOT NULL", "ratio_table")],
        "ebit_margin": [(f"abs({em}) > 1.0", "ratio_percent"), (f"{em} IS NOT NULL", "ratio_fraction"),
                        ("abs(rev) > 1e-9 AND ebit IS NOT NULL", "ebit_over_revenue"),
                        (f"_is_bank AND {nii} <> 0 AND {nim} IS NOT NULL", "bank_interest_over_assets")],
        "net_debt": [(f"_is_bank AND {nii} <> 0 AND {nim} IS NOT NULL", "bank_interest_over_assets"),
                     (f"{sdiv('(ltd + std) - cash', ebitda)} IS NOT NULL", "net_debt_over_ebitda")],
        "growth": [("rt_revenue_growth_pct_0 IS NOT NULL", "ratio_table"),
                   ("_is_bank AND rt_bank_growth_nii_0 IS NOT NULL", "bank_interest_ratio"),
                   ("_is_bank AND rt_bank_growth_opp_0 IS NOT NULL", "bank_operating_ratio"),
                   (f"{v0} IS NOT NULL AND abs({v1}) >= 1e-9", "periods")],
        "depreciation": [("cf_depreciation_0 <> 0", "cash_flow"), ("is_depreciation_0 <> 0", "income")],
    }
    tags = ",\n    ".join(
        "CASE " + " ".join(f"WHEN {c} THEN {q(t) if t else 'NULL'}" for c, t in whens) + f" END AS _{chain}_path"
        for chain, whens in cases.items())
    feat_sel = ",\n    ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in feats.items())
    gate_sql = f"WHERE _n_missing <= {fv.MAX_MISSING_REQUIRED}" if gate else ""
    return f"""
ad_base AS (
  SELECT w.*, f.company_name, f.exchange, {normalize_sector_sql('f.sector')} AS sector
  FROM wide_a w LEFT JOIN firm f USING (ticker)
),
ad_s1 AS (
  SELECT *, sector IN ({fin_list()}) AS _is_bank,
    coalesce(bs_total_liabilities_0,
             CASE WHEN {truthy(ta)} AND {truthy(te)} THEN {ta} - {te} END) AS tl,
    coalesce(nullif(cf_depreciation_0, 0.0), nullif(is_depreciation_0, 0.0), 0.0) AS dep,
    coalesce(bs_long_term_debt_0, 0.0) AS ltd,
    coalesce(bs_short_term_debt_0, 0.0) AS std,
    coalesce(bs_cash_0, 0.0) AS cash,
    coalesce(is_interest_expense_0, 0.0) AS ie,
    {total_income} AS total_income
  FROM ad_base
),
ad_s2 AS (
  SELECT *,
    CASE WHEN _is_bank AND (is_revenue_0 IS NULL OR is_revenue_0 = 0) AND total_income > 0 THEN total_income
         WHEN _is_bank AND (is_revenue_0 IS NULL OR is_revenue_0 = 0) AND is_total_operating_income_0 > 0
           THEN is_total_operating_income_0
         ELSE is_revenue_0 END AS rev,
    {ebit} AS ebit,
    {ebit_path} AS ebit_path,
    CASE WHEN {ta} IS NOT NULL AND bs_long_term_assets_0 IS NOT NULL AND {ta} - bs_long_term_assets_0 >= 0
         THEN {ta} - bs_long_term_assets_0 END AS ca_ind,
    coalesce(nullif({cl}, 0.0), {cl_alt}) AS cl_best,
    CASE WHEN tl IS NOT NULL AND tl - ltd > 0 THEN tl - ltd END AS cl_ind
  FROM ad_s1
),
ad_s3 AS (
  SELECT *, coalesce(nullif({ca}, 0.0), nullif({ca_alt}, 0.0), ca_ind) AS ca_best FROM ad_s2
),
ad_s4 AS (
  SELECT *, {cr_case(1)} AS cr_ratio, {cr_case(2)} AS cr_ca, {cr_case(3)} AS cr_cl, {cr_case(4)} AS cr_path
  FROM ad_s3
),
ad_s5 AS (
  SELECT ticker, sector, coalesce(company_name, ticker) AS company_name, coalesce(exchange, '') AS exchange,
    {feat_sel},
    rev AS _revenue, is_net_income_0 AS _net_income, ebit AS _ebit, {ta} AS _total_assets,
    {te} AS _total_equity, ltd + std AS _total_debt, {ca} AS _current_assets, {cl} AS _current_liabilities,
    _is_bank, ebit_path AS _ebit_path, cr_path AS _current_ratio_path,
    {tags}
  FROM ad_s4
),
adapter AS (
  SELECT * FROM (SELECT *, {n_missing} AS _n_missing FROM ad_s5) x {gate_sql}
)"""


def crawl_sql(gate: bool = True) -> str:
    """CTE ``crawl`` over ``wide_b`` and ``firm``."""
    def pct(x):
        return f"(CASE WHEN ({x}) IS NOT NULL AND abs({x}) > 1 THEN ({x}) / 100.0 ELSE ({x}) END)"
    td = ("(CASE WHEN long_term_debt IS NOT NULL AND short_term_debt IS NOT NULL "
          "THEN long_term_debt + short_term_debt ELSE total_liabilities END)")
    dep_est = "greatest(0.0, coalesce(nullif(gross_profit, 0.0), ebit) - ebit)"
    ebitda = f"(CASE WHEN ebit IS NOT NULL THEN ebit + {dep_est} END)"
    nd = f"(CASE WHEN {truthy(td)} AND {truthy('cash')} THEN {td} - cash ELSE {td} END)"
    feats = {
        "roa": pct(f"coalesce(roa_direct, {zdiv('net_profit', 'total_assets')})"),
        "roe": pct(f"coalesce(roe_direct, {zdiv('net_profit', 'total_equity')})"),
        "roce": zdiv("ebit", f"CASE WHEN {truthy('total_assets')} AND {truthy('current_liabilities')} "
                             f"THEN total_assets - current_liabilities END"),
        "ebit_margin": zdiv("ebit", "revenue"),
        "current_ratio": zdiv("current_assets", "current_liabilities"),
        "debt_to_assets": f"coalesce(nullif({zdiv(td, 'total_assets')}, 0.0), {zdiv('total_liabilities', 'total_assets')})",
        "debt_to_equity": f"coalesce(nullif({zdiv(td, 'total_equity')}, 0.0), {zdiv('total_liabilities', 'total_equity')})",
        "net_debt_to_ebitda": zdiv(nd, ebitda),
        "asset_turnover": zdiv("revenue", "total_assets"),
        "wcta": (f"CASE WHEN {truthy('current_assets')} AND {truthy('current_liabilities')} AND {truthy('total_assets')} "
                 f"THEN (current_assets - current_liabilities) / total_assets END"),
        "reta": (f"CASE WHEN {truthy('retained')} AND {truthy('total_assets')} THEN retained / total_assets "
                 f"WHEN {truthy('net_profit')} AND {truthy('prev_equity')} AND {truthy('total_assets')} "
                 f"THEN (net_profit + prev_equity) / total_assets END"),
        "market_to_book": "NULL",
        "revenue_growth_yoy": (f"CASE WHEN {truthy('revenue')} AND {truthy('prev_revenue')} "
                               f"THEN (revenue - prev_revenue) / abs(prev_revenue) END"),
        "log_revenue": f"CASE WHEN {truthy('revenue')} AND revenue > 0 THEN ln(revenue) END",
        "market_cap": "NULL",
    }
    sel = ",\n    ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in feats.items())
    n_ok = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in FEATURES)
    gate_sql = f"WHERE _n_ok >= {fv.MIN_FEATURES_VARIANT_B}" if gate else ""
    return f"""
cr_s1 AS (
  SELECT w.ticker, coalesce(f.sector, 'Other') AS sector,
    {sel}
  FROM wide_b w LEFT JOIN firm f USING (ticker)
),
crawl AS (
  SELECT * FROM (SELECT *, {n_ok} AS _n_ok FROM cr_s1) x {gate_sql}
)"""
