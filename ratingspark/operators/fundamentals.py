"""Derived fundamentals from resolved statement values.

Variant A (D1-D15): the statement adapter with its fallback chains.
Variant B (B1-B7): the rated-list crawl's simpler formulas.

Resolution yields one value per (ticker, lookup); a single pivot with a fixed
name list turns them into columns, and every metric is then a column expression
in one ``select`` — no per-firm Python. Python-style truthiness (``a or b``
skips zero as well as null) is written as ``coalesce(nullif(a, 0), b)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.functions.scalars import normalize_sector, safe_div, zero_div_null
from ratingspark.operators import items as it
from ratingspark.session import materialize

FEATURE_COLS = list(fv.FEATURE_NAMES.values())

# Paths of each fallback chain, in the order in which they are tried; a firm for
# which none fires counts as ``none``.
CHAIN_PATHS = {
    "ebit": ["direct", "pbt_plus_interest", "gross_minus_opex", "ni_plus_interest", "net_income",
             "bank_operating_profit", "bank_net_interest_income"],
    "roce": ["ratio_table", "assets_less_liabilities", "alt_names", "equity_plus_debt", "assets_proxy"],
    "current_ratio": ["loans_to_deposits", "liquid_to_deposits", "bank_default", "ca_cl", "alt_names",
                      "assets_less_long_term", "liabilities_less_long_debt", "ratio_table", "liabilities_proxy"],
    "revenue": ["bank_income_lines", "bank_operating_income", "reported"],
    "liabilities": ["reported", "assets_less_equity"],
    "roa": ["statements", "ratio_table"],
    "roe": ["statements", "ratio_table"],
    "ebit_margin": ["ratio_percent", "ratio_fraction", "ebit_over_revenue", "bank_interest_over_assets"],
    "net_debt": ["bank_interest_over_assets", "net_debt_over_ebitda"],
    "growth": ["ratio_table", "bank_interest_ratio", "bank_operating_ratio", "periods"],
    "depreciation": ["cash_flow", "income"],
}


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def resolved_values_a(items: DataFrame) -> DataFrame:
    """Wide table: one row per ticker, one column ``<lookup>@<idx>`` per
    resolved line item (resolver A)."""
    # one written row per statement feeds every resolver pass (layouts, values)
    rows = materialize(it.statement_rows(items), "statements")
    lookups = it.lookups_variant_a()
    wanted = [(n, 0) for n, _, _ in lookups] + [("is_revenue", 1)]
    return materialize(it.values_a(rows, lookups, wanted))


def adapter_features(items: DataFrame, firms: DataFrame, gate: bool = True, paths: bool = False) -> DataFrame:
    """The full adapter feature row per ticker, audit columns and the
    completeness gate C4 (drop when more than 7 of the 14 required features
    are missing). ``firms`` supplies (ticker, sector text, company_name,
    exchange). With ``paths`` each chain of ``CHAIN_PATHS`` also tells the path
    that fired (column ``_<chain>_path``, null where none did).

    Written as three projections (inputs -> intermediate amounts -> ratios) so
    each intermediate is computed once; a single nested expression would
    repeat the fallback chains inside every ratio."""
    w = resolved_values_a(items)
    info = firms.select("ticker", F.col("sector").alias("_sector_in"), "company_name", "exchange")
    # X9 runs once per distinct sector text, not once per firm
    info = info.withColumn("_skey", F.coalesce(F.col("_sector_in"), F.lit("")))
    sectors = (info.select("_skey").distinct()
               .select("_skey", normalize_sector(F.col("_skey")).alias("sector")))
    info = info.join(sectors, "_skey", "left").drop("_skey")
    base = w.join(info, "ticker", "left").select(
        "ticker", "company_name", "exchange", "_sector_in",
        F.coalesce(F.col("sector"), F.lit(fv.SECTOR_OTHER)).alias("sector"),
        *[F.col(f"`{c}`").alias(c.replace("@", "_")) for c in w.columns if "@" in c])
    g = lambda k: F.col(f"{k}_0")

    # ---- stage 1: resolved inputs -> intermediate amounts
    sector = F.col("sector")
    is_bank = F.col("_is_bank")
    ta, tl0, te = g("bs_total_assets"), g("bs_total_liabilities"), g("bs_total_equity")
    lines = [g("is_net_interest_income"), g("is_bank_fee_income"), g("is_bank_fx_income"),
             g("is_bank_trading_income"), g("is_bank_investment_income"), g("is_bank_other_income"),
             g("is_bank_dividend_income")]
    total_income = sum((F.coalesce(x, F.lit(0.0)) for x in lines[1:]), F.coalesce(lines[0], F.lit(0.0)))
    rev_in, toi = g("is_revenue"), g("is_total_operating_income")
    rev_missing = rev_in.isNull() | (rev_in == 0)
    s1 = base.select(
        "*",
        sector.isin(fv.FINANCIAL_SECTORS).alias("_is_bank"),
        # Liabilities fall back to assets - equity when both are truthy
        F.coalesce(tl0, F.when(_truthy(ta) & _truthy(te), ta - te)).alias("tl"),
        # D14
        F.coalesce(_nz(g("cf_depreciation")), _nz(g("is_depreciation")), F.lit(0.0)).alias("dep"),
        F.coalesce(g("bs_long_term_debt"), F.lit(0.0)).alias("ltd"),
        F.coalesce(g("bs_short_term_debt"), F.lit(0.0)).alias("std"),
        F.coalesce(g("bs_cash"), F.lit(0.0)).alias("cash"),
        F.coalesce(g("is_interest_expense"), F.lit(0.0)).alias("ie"),
        total_income.alias("_total_income"),
        rev_missing.alias("_rev_missing"),
    )
    # Bank revenue = sum of the seven income lines if positive, else total operating income
    s1 = s1.withColumn("rev", F.when(is_bank & F.col("_rev_missing") & (F.col("_total_income") > 0),
                                     F.col("_total_income"))
                       .when(is_bank & F.col("_rev_missing") & _truthy(toi) & (toi > 0), toi)
                       .otherwise(rev_in))

    rev, tl, ie = F.col("rev"), F.col("tl"), F.col("ie")
    ni, nii = g("is_net_income"), g("is_net_interest_income")
    pbt, gp = g("is_profit_before_tax"), g("is_gross_profit")
    sell = F.coalesce(g("is_selling_expenses"), F.lit(0.0))
    admin = F.coalesce(g("is_admin_expenses"), F.lit(0.0))
    bank_op, ebit_direct = g("is_bank_operating_profit"), g("is_ebit")
    # EBIT fallback chain with the path that fired
    ebit_paths = [
        (ebit_direct.isNotNull(), ebit_direct, "direct"),
        (pbt.isNotNull(), pbt + ie, "pbt_plus_interest"),
        (gp.isNotNull(), gp - sell - admin, "gross_minus_opex"),
        (ni.isNotNull() & (ie != 0), ni + ie, "ni_plus_interest"),
        (ni.isNotNull() & ~is_bank, ni, "net_income"),
        (is_bank & bank_op.isNotNull(), bank_op, "bank_operating_profit"),
        (is_bank & nii.isNotNull(), nii, "bank_net_interest_income"),
    ]
    ca, cl = g("bs_short_term_assets"), g("bs_short_term_liabilities")
    ca_alt, cl_alt = g("bs_short_term_assets_alt"), g("bs_short_term_liabilities_alt")
    lta, ltd = g("bs_long_term_assets"), F.col("ltd")
    ca_ind = F.when(ta.isNotNull() & lta.isNotNull() & ((ta - lta) >= 0), ta - lta)
    s2 = s1.select(
        "*",
        _chain([(c, e) for c, e, _ in ebit_paths]).alias("ebit"),
        _chain([(c, F.lit(n)) for c, _, n in ebit_paths]).alias("_ebit_path"),
        ca_ind.alias("ca_ind"),
        F.coalesce(_nz(cl), cl_alt).alias("cl_best"),
        F.when(tl.isNotNull() & ((tl - ltd) > 0), tl - ltd).alias("cl_ind"),
    ).withColumn("ca_best", F.coalesce(_nz(ca), _nz(ca_alt), F.col("ca_ind")))

    # ---- stage 2: current-ratio path (D3/D4) as one struct
    s3 = s2.withColumn("_cr", _current_ratio(g, is_bank, ca, cl, ta, tl))
    # write the per-ticker intermediate amounts: the fallback chains and the
    # ratio chains then compile as two stages, each within the JVM's method
    # size limit (one fused stage falls back to interpreted evaluation)
    s3 = materialize(s3, "adapter_amounts")

    # ---- stage 3: ratios
    ebit = F.col("ebit")
    total_debt = F.col("ltd") + F.col("std")
    ebitda = F.when(ebit.isNotNull(), ebit + F.col("dep"))
    roce_direct, cl_alt_roce = g("rt_roce_direct"), g("bs_short_term_liabilities_alt_roce")
    # ROCE
    roce = [
        (roce_direct.isNotNull(), roce_direct / 100.0, "ratio_table"),
        (ebit.isNull(), F.lit(None), None),
        (ta.isNotNull() & cl.isNotNull() & ((ta - cl) > 0), safe_div(ebit, ta - cl), "assets_less_liabilities"),
        (ta.isNotNull() & cl_alt_roce.isNotNull() & ((ta - cl_alt_roce) > 0),
         safe_div(ebit, ta - cl_alt_roce), "alt_names"),
        (te.isNotNull() & ((te + ltd) > 0), safe_div(ebit, te + ltd), "equity_plus_debt"),
        (ta > 0, safe_div(ebit, ta * 0.6), "assets_proxy"),
    ]
    # EBIT margin
    em = g("rt_ebit_margin_direct")
    ebit_margin = [
        (F.when(F.abs(em) > 1.0, em / 100.0), "ratio_percent"),
        (em, "ratio_fraction"),
        (F.when(_truthy(rev) & (F.abs(rev) > 1e-9) & ebit.isNotNull(), safe_div(ebit, rev)), "ebit_over_revenue"),
        (F.when(is_bank & _truthy(nii) & _truthy(ta), safe_div(nii, ta)), "bank_interest_over_assets"),
    ]
    # Banks replace net debt / EBITDA by NII / TA
    nd_ebitda = [
        (F.when(is_bank & _truthy(nii) & _truthy(ta), safe_div(nii, ta)), "bank_interest_over_assets"),
        (safe_div(total_debt - F.col("cash"), ebitda), "net_debt_over_ebitda"),
    ]
    ca_res, cl_res = F.col("_cr.ca"), F.col("_cr.cl")
    # Revenue growth: ratio % -> bank proxies -> W2 on the revenue line
    rg, bg1, bg2 = g("rt_revenue_growth_pct"), g("rt_bank_growth_nii"), g("rt_bank_growth_opp")
    growth = [
        (F.when(rg.isNotNull(), it.clip(rg / 100.0, -0.9, 5.0)), "ratio_table"),
        (F.when(is_bank & bg1.isNotNull(), it.clip(bg1 / 100.0, -0.9, 5.0)), "bank_interest_ratio"),
        (F.when(is_bank & bg2.isNotNull(), it.clip(bg2 / 100.0, -0.9, 5.0)), "bank_operating_ratio"),
        (it.yoy_growth(F.col("is_revenue_0"), F.col("is_revenue_1")), "periods"),
    ]
    # Zero or null ratio -> ratio table / 100
    roa = [(_nz(safe_div(ni, ta)), "statements"), (g("rt_roa") / 100.0, "ratio_table")]
    roe = [(_nz(safe_div(ni, te)), "statements"), (g("rt_roe") / 100.0, "ratio_table")]
    feats = {
        "roa": _first_value(roa),
        "roe": _first_value(roe),
        "roce": _chain([(c, e) for c, e, _ in roce]),
        "ebit_margin": _first_value(ebit_margin),
        "current_ratio": F.col("_cr.ratio"),
        # D9
        "debt_to_assets": safe_div(tl, ta),
        "debt_to_equity": safe_div(tl, te),
        "net_debt_to_ebitda": _first_value(nd_ebitda),
        # D11, D12
        "asset_turnover": safe_div(rev, ta),
        "wcta": F.when(ca_res.isNotNull() & cl_res.isNotNull() & _truthy(ta), safe_div(ca_res - cl_res, ta)),
        "reta": safe_div(g("bs_retained_earnings"), ta),
        "market_to_book": g("rt_price_to_book"),
        "revenue_growth_yoy": _first_value(growth),
        "log_revenue": F.when(_truthy(rev), F.log1p(F.abs(rev))),
        "market_cap": F.coalesce(g("rt_market_cap"), F.lit(0.0)),
    }
    tags = {}
    if paths:
        tags = {
            "roce": _chain([(c, F.lit(n)) for c, _, n in roce]),
            "revenue": F.when(is_bank & F.col("_rev_missing") & (F.col("_total_income") > 0), "bank_income_lines")
            .when(is_bank & F.col("_rev_missing") & (toi > 0), "bank_operating_income")
            .when(rev_in.isNotNull(), "reported"),
            "liabilities": F.when(tl0.isNotNull(), "reported").when(tl.isNotNull(), "assets_less_equity"),
            "roa": _first_path(roa), "roe": _first_path(roe), "ebit_margin": _first_path(ebit_margin),
            "net_debt": _first_path(nd_ebitda), "growth": _first_path(growth),
            "depreciation": _first_path([(_nz(g("cf_depreciation")), "cash_flow"),
                                         (_nz(g("is_depreciation")), "income")]),
        }
    out = s3.select(
        "ticker", "sector",
        F.coalesce(F.col("company_name"), F.col("ticker")).alias("company_name"),
        F.coalesce(F.col("exchange"), F.lit("")).alias("exchange"),
        *[c.cast("double").alias(k) for k, c in feats.items()],
        rev.alias("_revenue"), ni.alias("_net_income"), ebit.alias("_ebit"),
        ta.alias("_total_assets"), te.alias("_total_equity"), total_debt.alias("_total_debt"),
        ca.alias("_current_assets"), cl.alias("_current_liabilities"), "_is_bank",
        "_ebit_path", F.col("_cr.path").alias("_current_ratio_path"),
        *[tag.alias(f"_{chain}_path") for chain, tag in tags.items()],
    )
    required = [fv.FEATURE_NAMES[f] for f in fv.REQUIRED_FEATURES]
    n_missing = sum((F.col(c).isNull().cast("int") for c in required[1:]),
                    F.col(required[0]).isNull().cast("int"))
    out = out.withColumn("_n_missing", n_missing)
    if gate:
        out = out.filter(F.col("_n_missing") <= fv.MAX_MISSING_REQUIRED)
    return out


def path_coverage(features: DataFrame) -> DataFrame:
    """Firms by the path that each chain took: (chain, path, n_firms, n_banks), a row
    for every path of ``CHAIN_PATHS`` and for ``none``, with zeros where no firm took
    it. ``features`` are rows of ``adapter_features`` with ``paths``; the tags combine
    before the shuffle to one row a path and partition."""
    cols = {chain: f"_{chain}_path" for chain in CHAIN_PATHS}
    taken = (features.select("_is_bank", *[F.coalesce(F.col(c), F.lit("none")).alias(chain) for chain, c in cols.items()])
             .unpivot(["_is_bank"], list(cols), "chain", "path")
             .groupBy("chain", "path")
             .agg(F.count("*").alias("n"), F.count_if("_is_bank").alias("banks")))
    every = features.sparkSession.createDataFrame(
        [(chain, path) for chain, tags in CHAIN_PATHS.items() for path in [*tags, "none"]],
        "chain string, path string")
    return every.join(taken, ["chain", "path"], "left").select(
        "chain", "path", F.coalesce("n", F.lit(0)).alias("n_firms"), F.coalesce("banks", F.lit(0)).alias("n_banks"))


def _first_value(options: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[value for value, _ in options])


def _first_path(options: list[tuple[Column, str]]) -> Column:
    return _chain([(value.isNotNull(), F.lit(name)) for value, name in options])


def _chain(pairs: list[tuple[Column, Column]]) -> Column:
    expr = None
    for cond, val in pairs:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def _current_ratio(g, is_bank, ca, cl, ta, tl) -> Column:
    """D3 (banks) and D4 (others); each path yields (ratio, ca, cl, path)."""
    def path(cond, ratio, a, b, name):
        return (cond, F.struct(ratio.cast("double").alias("ratio"), a.cast("double").alias("ca"),
                               b.cast("double").alias("cl"), F.lit(name).alias("path")))

    none = F.lit(None).cast("double")
    loans, deposits = g("bs_loans_to_customers"), g("bs_customer_deposits")
    fixed = F.coalesce(g("bs_fixed_assets"), F.lit(0.0))
    cr_rt = g("rt_current_ratio_direct")
    bank = [
        path(loans.isNotNull() & deposits.isNotNull() & (deposits > 0), loans / deposits, loans, deposits,
             "loans_to_deposits"),
        path(ta.isNotNull() & deposits.isNotNull() & (deposits > 0),
             F.least((ta - fixed) / deposits, F.lit(5.0)), ta - fixed, deposits, "liquid_to_deposits"),
        path(cr_rt.isNotNull(), cr_rt, none, none, "ratio_table"),
        path(F.lit(True), F.lit(0.85), none, none, "bank_default"),
    ]
    ca_alt, cl_alt = g("bs_short_term_assets_alt"), g("bs_short_term_liabilities_alt")
    ca_ind, cl_best, cl_ind, ca_best = F.col("ca_ind"), F.col("cl_best"), F.col("cl_ind"), F.col("ca_best")
    other = [
        path(ca.isNotNull() & cl.isNotNull() & (cl > 0), ca / cl, ca, cl, "ca_cl"),
        path(ca_alt.isNotNull() & cl_alt.isNotNull() & (cl_alt > 0), ca_alt / cl_alt, ca_alt, cl_alt,
             "alt_names"),
        path(ca_ind.isNotNull() & cl_best.isNotNull() & (cl_best > 0), ca_ind / cl_best, ca_ind, cl_best,
             "assets_less_long_term"),
        path(ca_best.isNotNull() & cl_ind.isNotNull(), ca_best / cl_ind, ca_best, cl_ind,
             "liabilities_less_long_debt"),
        path(cr_rt.isNotNull(), cr_rt, none, none, "ratio_table"),
        path(ca_best.isNotNull() & tl.isNotNull() & (tl > 0), ca_best / (tl * 0.6), ca_best, tl * 0.6,
             "liabilities_proxy"),
    ]
    return F.when(is_bank, _chain(bank)).otherwise(_chain(other))


# ---------------------------------------------------------------- variant B
def lookups_variant_b() -> list[tuple[str, str, list[str], int]]:
    return [(name, stmt, keys, idx) for (stmt, name, idx), keys in fv.CANDIDATES_B.items()]


def crawl_features(items: DataFrame, firms: DataFrame, gate: bool = True) -> DataFrame:
    """B1-B7 plus gate C5 (at least 4 non-null features). Sector comes from a
    left lookup by ticker with default ``Other`` (J3)."""
    # one written row per statement feeds every resolver pass (layouts, values)
    w = materialize(it.values_b(materialize(it.statement_rows(items), "statements"), lookups_variant_b()))
    df = w.join(firms.select("ticker", F.col("sector").alias("_sec")), "ticker", "left")
    g = lambda k: F.col(k)
    ta, tl, te = g("total_assets"), g("total_liabilities"), g("total_equity")
    ca, cl = g("current_assets"), g("current_liabilities")
    ltd, std, re, cash, pe = g("long_term_debt"), g("short_term_debt"), g("retained"), g("cash"), g("prev_equity")
    rev, ebit, np_, gp, prev = g("revenue"), g("ebit"), g("net_profit"), g("gross_profit"), g("prev_revenue")

    def pct(x):  # B2: a ratio-table value above 1 in magnitude is a percent
        return F.when(x.isNotNull() & (F.abs(x) > 1), x / 100.0).otherwise(x)

    roa = pct(F.coalesce(g("roa_direct"), zero_div_null(np_, ta)))
    roe = pct(F.coalesce(g("roe_direct"), zero_div_null(np_, te)))
    cap_emp = F.when(_truthy(ta) & _truthy(cl), ta - cl)
    total_debt = F.when(ltd.isNotNull() & std.isNotNull(), ltd + std).otherwise(tl)
    dep_est = F.greatest(F.lit(0.0), F.coalesce(_nz(gp), ebit) - ebit)
    ebitda = F.when(ebit.isNotNull(), ebit + dep_est)
    net_debt = F.when(_truthy(total_debt) & _truthy(cash), total_debt - cash).otherwise(total_debt)
    reta = (F.when(_truthy(re) & _truthy(ta), re / ta)
            .when(_truthy(np_) & _truthy(pe) & _truthy(ta), (np_ + pe) / ta))
    feats = {
        "roa": roa, "roe": roe,
        "roce": zero_div_null(ebit, cap_emp),
        "ebit_margin": zero_div_null(ebit, rev),
        "current_ratio": zero_div_null(ca, cl),
        "debt_to_assets": F.coalesce(_nz(zero_div_null(total_debt, ta)), zero_div_null(tl, ta)),
        "debt_to_equity": F.coalesce(_nz(zero_div_null(total_debt, te)), zero_div_null(tl, te)),
        "net_debt_to_ebitda": zero_div_null(net_debt, ebitda),
        "asset_turnover": zero_div_null(rev, ta),
        "wcta": F.when(_truthy(ca) & _truthy(cl) & _truthy(ta), (ca - cl) / ta),
        "reta": reta,
        "market_to_book": F.lit(None).cast("double"),
        "revenue_growth_yoy": F.when(_truthy(rev) & _truthy(prev), (rev - prev) / F.abs(prev)),
        "log_revenue": F.when(_truthy(rev) & (rev > 0), F.log(rev)),
        "market_cap": F.lit(None).cast("double"),
    }
    out = df.select("ticker", F.coalesce(F.col("_sec"), F.lit(fv.SECTOR_OTHER)).alias("sector"),
                    *[c.cast("double").alias(k) for k, c in feats.items()])
    n_ok = sum((F.col(c).isNotNull().cast("int") for c in FEATURE_COLS[1:]),
               F.col(FEATURE_COLS[0]).isNotNull().cast("int"))
    out = out.withColumn("_n_ok", n_ok)
    if gate:
        out = out.filter(F.col("_n_ok") >= fv.MIN_FEATURES_VARIANT_B)
    return out
