"""Oracle SQL (DuckDB) for cleaning, merging and feature engineering over the
firm feature rows (CTE ``feats`` of ``sql_firms``). Each function returns CTE
text ``name AS (...)`` reading a named source CTE."""

from __future__ import annotations

from ratingspark.functions import fixed_values as fv
from ratingspark.plans.sql_bindings import q
from ratingspark.plans.sql_firms import FEATURES, clip

FN = fv.FEATURE_NAMES
DISPLAY = {v: k for k, v in FN.items()}
SECTOR_DEPENDENT = [FN[n] for n in fv.SECTOR_DEPENDENT]
DYNAMIC_MEDIAN = [FN[n] for n in fv.DYNAMIC_MEDIAN_FEATURES]
SECTOR_RATIO = [FN[n] for n in fv.SECTOR_RATIO_FEATURES]
INTERACTIONS = [FN[n] for n in fv.INTERACTION_FEATURES]
MERGE_RATIO = [FN[n] for n in fv.MERGE_RATIO_FEATURES]
BANK_LEVERAGE = [FN[n] for n in fv.BANKING_LEVERAGE]
ALL_FEATURES = [FN[n] for n in fv.UNIVERSAL_FEATURES + fv.SECTOR_DEPENDENT]
META = ["ticker", "sector", "data_source", "credit_rating", "has_rating"]


def ref_median_sql(sector: str, feat: str, table: dict, default_sector: str | None) -> str:
    name = DISPLAY[feat]
    whens = " ".join(f"WHEN {sector} = {q(s)} THEN {float(v[name])!r}" for s, v in table.items() if name in v)
    d = table.get(default_sector, {}).get(name) if default_sector else None
    dflt = "CAST(NULL AS DOUBLE)" if d is None else repr(float(d))
    return f"(CASE {whens} ELSE {dflt} END)" if whens else dflt


def _rest(cols: list[str], feats: list[str]) -> str:
    return ", ".join(c for c in cols if c not in feats)


# ---------------------------------------------------------------- merge
def merge_sql(src: str = "feats", weight: float = fv.MERGE_LOCAL_WEIGHT) -> str:
    """CTEs rated_local, unrated_local, foreign_rated, train_raw, train_imp,
    train_merged, predict_merged."""
    valid = ", ".join(q(g) for g in fv.RATING_SCALE)
    copies = int(weight)
    imp = impute_ref_sql
    return f"""
split_local AS (
  SELECT *, coalesce(has_rating AND credit_rating IN ({valid}), FALSE) AS is_rated FROM {src}
  WHERE data_source = 'vietnam'
),
rated_local AS (SELECT {", ".join(META + FEATURES)} FROM split_local WHERE is_rated),
unrated_local AS (SELECT {", ".join(META + FEATURES)} FROM split_local WHERE NOT is_rated),
foreign_rated AS (
  SELECT {", ".join(META + FEATURES)} FROM {src}
  WHERE data_source = 'kaggle' AND credit_rating IN ({valid})
),
upweighted AS (
  SELECT r.*, c.copy_no FROM rated_local r CROSS JOIN (SELECT unnest(range(1, {copies + 1})) AS copy_no) c
),
train_raw AS (
  SELECT *, 0 AS copy_no FROM foreign_rated
  UNION ALL SELECT * FROM upweighted
),
{imp("train_raw", "train_imp", META + ["copy_no"])},
{ref_ratio_sql("train_imp", "train_merged", META + ["copy_no"] + FEATURES)},
{imp("unrated_local", "predict_imp", META)},
{ref_ratio_sql("predict_imp", "predict_merged", META + FEATURES)}"""


def impute_ref_sql(src: str, out: str, meta: list[str]) -> str:
    table = fv.SECTOR_MEDIANS_IMPUTE
    s1 = ", ".join(f"coalesce({f}, {ref_median_sql('sector', f, table, None)}) AS {f}" for f in FEATURES)
    gm = ", ".join(f"quantile_cont({f}, 0.5) AS {f}__gmed" for f in FEATURES)
    fills = []
    for f in FEATURES:
        d = table[fv.IMPUTE_DEFAULT_SECTOR].get(DISPLAY[f], 0.0)
        fills.append(f"coalesce({f}, {f}__gmed, {float(d)!r}) AS {f}")
    return f"""{out}_s1 AS (SELECT {", ".join(meta)}, {s1} FROM {src}),
{out}_gm AS (SELECT {gm} FROM {out}_s1),
{out} AS (SELECT {", ".join(meta)}, {", ".join(fills)} FROM {out}_s1 CROSS JOIN {out}_gm)"""


def ref_ratio_sql(src: str, out: str, cols: list[str]) -> str:
    table = fv.SECTOR_MEDIANS_IMPUTE
    parts = []
    for f in MERGE_RATIO:
        med = ref_median_sql("sector", f, table, None)
        parts.append(f"coalesce(CASE WHEN {med} IS NOT NULL AND abs({med}) >= 1e-9 THEN "
                     f"{clip(f'{f} / {med}', 0.0, 10.0)} END, 1.0) AS {f}_ref_ratio")
    return f"{out} AS (SELECT {', '.join(cols)}, {', '.join(parts)} FROM {src})"


# ---------------------------------------------------------------- clean
def dedup_sql(src: str, out: str, key: str = "ticker", tiebreak: str = "copy_no") -> str:
    return f"""{out} AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY {key}
      ORDER BY CASE WHEN data_source = 'vietnam' THEN 0 ELSE 1 END, {tiebreak}) AS _rn FROM {src}) t
  WHERE _rn = 1)"""


def group_fill_sql(src: str, out: str, cols: list[str], feats: list[str] = ALL_FEATURES) -> str:
    smed = ", ".join(f"quantile_cont({f}, 0.5) AS {f}__smed" for f in feats)
    s1 = ", ".join(f"coalesce(s.{f}, m.{f}__smed) AS {f}" for f in feats)
    rest = ", ".join(f"s.{c}" for c in cols if c not in feats)
    gm = ", ".join(f"quantile_cont({f}, 0.5) AS {f}__gmed" for f in feats)
    fills = []
    for f in feats:
        d = fv.SECTOR_MEDIANS_REFERENCE[fv.REFERENCE_DEFAULT_SECTOR].get(DISPLAY[f], 0.0)
        fills.append(f"coalesce({f}, {f}__gmed, {float(d)!r}) AS {f}")
    return f"""{out}_smed AS (SELECT sector, {smed} FROM {src} WHERE sector IS NOT NULL GROUP BY sector),
{out}_s1 AS (SELECT {rest}, {s1} FROM {src} s LEFT JOIN {out}_smed m ON s.sector = m.sector),
{out}_gm AS (SELECT {gm} FROM {out}_s1),
{out} AS (SELECT {_rest(cols, feats)}, {", ".join(fills)} FROM {out}_s1 CROSS JOIN {out}_gm)"""


def iqr_clip_sql(src: str, out: str, cols: list[str], feats: list[str] = ALL_FEATURES) -> str:
    qs = ", ".join(f"quantile_cont({f}, 0.25) AS {f}__q1, quantile_cont({f}, 0.75) AS {f}__q3" for f in feats)
    parts = []
    for f in feats:
        lo = f"({f}__q1 - ({f}__q3 - {f}__q1) * 1.5)"
        hi = f"({f}__q3 + ({f}__q3 - {f}__q1) * 1.5)"
        e = f"CASE WHEN {f} IS NOT NULL AND {lo} IS NOT NULL THEN greatest(least({f}, {hi}), {lo}) ELSE {f} END"
        if f in BANK_LEVERAGE:
            e = f"CASE WHEN coalesce(sector = 'Banking', FALSE) THEN {f} ELSE {e} END"
        parts.append(f"{e} AS {f}")
    return f"""{out}_q AS (SELECT {qs} FROM {src}),
{out} AS (SELECT {_rest(cols, feats)}, {", ".join(parts)} FROM {src} CROSS JOIN {out}_q)"""


def clean_sql(src: str, out: str, cols: list[str]) -> str:
    return ",\n".join([dedup_sql(src, f"{out}_dd"), group_fill_sql(f"{out}_dd", f"{out}_gf", cols),
                       iqr_clip_sql(f"{out}_gf", out, cols)])


def fitted_clean_sql(fitted: str, src: str, out: str, cols: list[str]) -> str:
    """I4 of ``src`` with the statistics that ``clean_sql(.., fitted, ..)``
    computed on its own rows."""
    parts = {}
    for f in ALL_FEATURES:
        d = fv.SECTOR_MEDIANS_REFERENCE[fv.REFERENCE_DEFAULT_SECTOR].get(DISPLAY[f], 0.0)
        v = f"coalesce(p.{f}, m.{f}__smed, {f}__gmed, {float(d)!r})"
        lo = f"({f}__q1 - ({f}__q3 - {f}__q1) * 1.5)"
        hi = f"({f}__q3 + ({f}__q3 - {f}__q1) * 1.5)"
        e = f"greatest(least({v}, {hi}), {lo})"
        parts[f] = f"CASE WHEN coalesce(p.sector = 'Banking', FALSE) THEN {v} ELSE {e} END" if f in BANK_LEVERAGE else e
    chosen = ", ".join(f"{parts[c]} AS {c}" if c in parts else f"p.{c}" for c in cols)
    return f"""{out} AS (SELECT {chosen} FROM {src} p LEFT JOIN {fitted}_gf_smed m ON p.sector = m.sector
  CROSS JOIN {fitted}_gf_gm CROSS JOIN {fitted}_q)"""


# ---------------------------------------------------------------- features
def sector_stats_sql(src: str, out: str) -> str:
    aggs = []
    for f in SECTOR_DEPENDENT:
        aggs += [f"coalesce(avg({f}), 0.0) AS {f}__mean", f"coalesce(stddev_samp({f}), 0.0) AS {f}__std"]
    for f in DYNAMIC_MEDIAN:
        aggs += [f"quantile_cont({f}, 0.5) AS {f}__med_raw", f"count({f}) AS {f}__n"]
    med = [f"CASE WHEN {f}__n >= {fv.MIN_SAMPLES_FOR_DYNAMIC_MEDIAN} THEN {f}__med_raw ELSE "
           f"{ref_median_sql('sector', f, fv.SECTOR_MEDIANS_REFERENCE, fv.REFERENCE_DEFAULT_SECTOR)} END AS {f}__median"
           for f in DYNAMIC_MEDIAN]
    keep = [c for f in SECTOR_DEPENDENT for c in (f"{f}__mean", f"{f}__std")]
    return f"""{out}_raw AS (SELECT sector, {", ".join(aggs)} FROM {src} WHERE sector IS NOT NULL GROUP BY sector),
{out} AS (SELECT sector, {", ".join(keep)}, {", ".join(med)} FROM {out}_raw)"""


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, FALSE) AS DOUBLE)"


def score_sql() -> list[str]:
    comps = [f"1.2 * {clip('wcta', -1.0, 1.0)}", f"1.4 * {clip('reta', -1.0, 1.0)}",
             f"3.3 * {clip('ebit_margin', -1.0, 1.0)}", f"0.6 * {clip('market_to_book', 0.0, 20.0)}",
             f"1.0 * {clip('asset_turnover', 0.0, 10.0)}"]
    z = "(" + " + ".join(f"coalesce({c}, 0.0)" for c in comps) + ")"
    cov = f"(ebit_margin / {clip('debt_to_assets', 0.01, 0.99)})"
    fs = [f"{clip('roa', -0.3, 0.3)} / 0.3", f"{clip('reta', -0.5, 0.5)} / 0.5",
          f"{clip('ebit_margin', -0.5, 0.5)} / 0.5", clip("(current_ratio - 1) / 2", -1.0, 1.0),
          f"{clip('0.5 - debt_to_assets', -0.5, 0.5)} / 0.5"]
    fsi = clip("(" + " + ".join(fs) + ") / 5.0", -1.0, 1.0)
    dsm = clip("0.75 - debt_to_assets", -0.5, 0.75)
    ig = f"(({clip(z, 0.0, 6.0)} / 6 + ({fsi} + 1) / 2 + {clip(dsm, 0.0, 0.75)} / 0.75) / 3.0)"
    hg = [_flag("debt_to_assets < 0.25"), _flag("roa > 0.08 AND roe > 0.15"), _flag(f"{cov} > 0.3"),
          _flag("debt_to_equity < 0.5"), _flag("net_debt_to_ebitda < 1.5")]
    hgs = "(" + " + ".join(hg) + ")"
    names = ["altman_wcta", "altman_reta", "altman_ebit", "altman_mb", "altman_turnover"]
    out = [f"{c} AS {n}" for c, n in zip(comps, names)]
    out += [
        f"{z} AS altman_z", f"{cov} AS coverage_proxy", "roa * revenue_growth_yoy AS quality_growth",
        f"{clip('1 - debt_to_assets', 0.0, 1.0)} AS equity_ratio", f"{fsi} AS financial_strength_index",
        f"{dsm} AS debt_safety_margin", f"{ig} AS investment_grade_score",
        f"{_flag('roa > 0')} AS signal_profitable", f"{_flag('revenue_growth_yoy > 0')} AS signal_growth_pos",
        f"{_flag('revenue_growth_yoy > 0.15')} AS signal_high_growth",
        f"{_flag('debt_to_assets < 0.5')} AS signal_low_debt", f"{_flag('debt_to_assets > 0.75')} AS signal_high_debt",
        f"{_flag('current_ratio > 1.5')} AS signal_good_liquidity", f"{_flag('roe > 0.15')} AS signal_high_roe",
        f"{hg[0]} AS signal_very_low_debt", f"{_flag('debt_to_assets < 0.35')} AS signal_conservative_debt",
        f"{hg[1]} AS signal_strong_profitability",
        f"{_flag('roa > 0.12 AND roe > 0.20')} AS signal_elite_profitability",
        f"{hg[2]} AS signal_strong_coverage", f"{_flag(f'{cov} > 0.5')} AS signal_excellent_coverage",
        f"{clip(cov, 0.0, 10.0)} AS coverage_ratio", f"{hg[3]} AS signal_low_leverage",
        f"{_flag('debt_to_equity < 0.2')} AS signal_very_low_leverage", f"{hg[4]} AS signal_low_net_debt",
        f"{_flag('net_debt_to_ebitda < 0')} AS signal_net_cash", f"{hgs} AS high_grade_score",
        f"{hgs} / 5.0 AS high_grade_score_norm", f"{_flag('current_ratio > 2.5')} AS signal_excellent_liquidity",
        f"{_flag('reta > 0.3')} AS signal_high_reta", f"{_flag('reta > 0.5')} AS signal_elite_reta",
        f"{_flag(f'{z} > 3.0')} AS signal_altman_safe",
        f"{_flag(f'{z} >= 1.8 AND {z} <= 3.0')} AS signal_altman_grey",
        f"{_flag(f'{z} < 1.8')} AS signal_altman_distress",
    ]
    return out


def engineer_sql(src: str, out: str, cols: list[str], sectors: list[str]) -> str:
    """N14 fit_transform on ``src``; ``sectors`` = the fitted dummy vocabulary."""
    bagg = []
    for f in SECTOR_DEPENDENT:
        bagg += [f"avg({f}) AS {f}__bmean", f"stddev_samp({f}) AS {f}__bstd"]
    bagg += [f"quantile_cont({f}, 0.5) AS {f}__bmed" for f in SECTOR_RATIO]
    parts = []
    for f in SECTOR_DEPENDENT:
        m = f"CASE WHEN st.sector IS NOT NULL THEN {f}__mean ELSE {f}__bmean END"
        s = f"CASE WHEN st.sector IS NOT NULL THEN {f}__std ELSE {f}__bstd END"
        s = f"CASE WHEN ({s}) = 0 THEN 1e-8 ELSE ({s}) END"
        zz = f"CASE WHEN x.sector IS NOT NULL THEN (x.{f} - ({m})) / ({s}) END"
        parts.append(f"{clip(f'coalesce({zz}, 0.0)', -4.0, 4.0)} AS {f}_sector_z")
    for f in SECTOR_RATIO:
        dyn = f"{f}__median" if f in DYNAMIC_MEDIAN else "CAST(NULL AS DOUBLE)"
        ref = ref_median_sql("x.sector", f, fv.SECTOR_MEDIANS_REFERENCE, None)
        med = f"coalesce(nullif({dyn}, 0.0), nullif({ref}, 0.0), {f}__bmed)"
        r = f"CASE WHEN x.sector IS NOT NULL AND {med} IS NOT NULL AND abs({med}) > 1e-9 THEN x.{f} / {med} ELSE 1.0 END"
        parts.append(f"coalesce({clip(r, 0.0, 10.0)}, 1.0) AS {f}_sector_ratio")
    for s in sectors:
        parts.append(f"CASE WHEN x.sector = {q(s)} THEN 1.0 ELSE 0.0 END AS sector_{s}")
    for f in INTERACTIONS:
        for s in sectors:
            parts.append(f"x.{f} * CASE WHEN x.sector = {q(s)} THEN 1.0 ELSE 0.0 END AS {f}_x_{s}")
    base = ", ".join(f"x.{c}" for c in cols)
    return f"""{sector_stats_sql(src, out + '_fit')},
{out}_batch AS (SELECT {", ".join(bagg)} FROM {src}),
{out}_j AS (
  SELECT {base}, {", ".join(parts)}
  FROM {src} x LEFT JOIN {out}_fit st ON x.sector = st.sector CROSS JOIN {out}_batch
),
{out} AS (SELECT *, {", ".join(score_sql())} FROM {out}_j)"""
