"""Registered queries: firm-level inputs, cleaning, merging and feature
engineering (A*, C1-C3, I1, I3, I4, W4, W5, X4, X6, X7, X15, U1, U2, N*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.functions import scalars as sc
from ratingspark.operators import clean as cl
from ratingspark.operators import features as fe
from ratingspark.operators import merge as mg
from ratingspark.operators.fundamentals import materialize
from ratingspark.plans import sql_model as sm
from ratingspark.plans.registry import register
from ratingspark.plans.sql_bindings import q
from ratingspark.plans.sql_firms import FEATURES, current_sql, firm_ctes, fold_sql, ordinal_sql
from ratingspark.sources import bindings as b
from ratingspark.sources import firms as fr

META = sm.META
TRAIN_COLS = META + ["copy_no"] + FEATURES + [f"{f}_ref_ratio" for f in sm.MERGE_RATIO]
# fitted dummy vocabulary of the binding (the five canonical sectors it maps to)
SECTORS = sorted({s for _, s in b.SEGMENT_SECTOR} | {b.SEGMENT_SECTOR_DEFAULT})


def rd(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}"


def rsel(cols: list[str], doubles: set[str], ints: set[str] = frozenset()) -> str:
    out = []
    for c in cols:
        if c in doubles:
            out.append(rd(c))
        elif c in ints:
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def W(*ctes: str) -> str:
    return "WITH " + firm_ctes(*ctes)


# ---------------------------------------------------------------- pipeline pieces (Spark)
# Stage boundaries: each fitted statistic re-reads its input, so the inputs of
# the statistics (feature rows, merged set, cleaned set) are checkpointed to
# the shared checkpoint folder once and every later aggregate starts there.
def feats(spark, sf):
    return materialize(fr.feature_rows(spark, sf))


def train_test(spark, sf):
    train, pred = mg.merge(feats(spark, sf))
    return materialize(train), pred


def current_feats(spark, sf):
    """Feature rows of which some firms are unrated: their newest grade is too old."""
    return materialize(fr.current_rows(spark, sf, feats(spark, sf)), "current")


def current_train_test(spark, sf):
    train, pred = mg.merge(current_feats(spark, sf))
    return materialize(train), materialize(pred, "predict")


def cleaned(spark, sf):
    train, _ = train_test(spark, sf)
    return materialize(cl.clean(train, tiebreak="copy_no"))


def engineered(spark, sf):
    return fe.engineer(cleaned(spark, sf))


MERGE = sm.merge_sql().strip()
CURRENT = current_sql(fr.RATING_MAX_AGE).strip()
MERGE_NOW = CURRENT + ",\n" + sm.merge_sql("feats_now").strip()
CLEAN = sm.clean_sql("train_merged", "train_clean", TRAIN_COLS)
ENG = sm.engineer_sql("train_clean", "train_eng", TRAIN_COLS, SECTORS)
DBL = set(FEATURES) | {f"{f}_ref_ratio" for f in sm.MERGE_RATIO}


# ---------------------------------------------------------------- A1, X6, X7, X15, C1
@register("a1_latest_rating", sql=W() + """
SELECT ticker, CAST(event_id AS BIGINT) AS event_id, CAST(rated_on AS VARCHAR) AS rated_on, agency,
       raw_rating, credit_rating FROM latest_rating""")
def a1_latest_rating(spark, sf):
    r = fr.latest_rating(spark, sf)
    return r.select("ticker", "event_id", F.col("rated_on").cast("string").alias("rated_on"), "agency",
                    "raw_rating", "credit_rating")


@register("x6_x7_x15_grade_fold", sql=W() + f"""
SELECT raw_rating, folded, folded_keep, CAST({ordinal_sql('folded')} AS BIGINT) AS ordinal,
  CASE {" ".join(f"WHEN folded IN ({', '.join(q(g) for g in gs)}) THEN {q(band)}" for gs, band in fv.RISK_BANDS)}
       ELSE {q(fv.RISK_BAND_DEFAULT)} END AS risk_band,
  CAST(count(*) AS BIGINT) AS n_events
FROM (SELECT raw_rating, {fold_sql('raw_rating')} AS folded,
             CASE WHEN raw_rating IS NULL THEN NULL ELSE coalesce({fold_sql('trim(raw_rating)')}, trim(raw_rating)) END
               AS folded_keep
      FROM rating_event) t
GROUP BY raw_rating, folded, folded_keep""")
def x6_x7_x15_grade_fold(spark, sf):
    """Grade fold (drop / keep unmapped), ordinal (unknown 99) and risk band
    for every rating event, counted per raw grade."""
    ev = b.rating_event(spark, sf)
    g = ev.select("raw_rating", sc.fold_grade(F.col("raw_rating"), "drop").alias("folded"),
                  sc.fold_grade(F.col("raw_rating"), "keep").alias("folded_keep"))
    g = g.groupBy("raw_rating", "folded", "folded_keep").agg(F.count("*").alias("n_events"))
    return g.select("raw_rating", "folded", "folded_keep", sc.grade_ordinal(F.col("folded")).alias("ordinal"),
                    sc.risk_band(F.col("folded")).alias("risk_band"), "n_events")


@register("c1_c2_valid_grade_events", sql=W() + f"""
SELECT CAST(event_id AS BIGINT) AS event_id, ticker, {fold_sql('raw_rating')} AS grade FROM rating_event
WHERE {fold_sql('raw_rating')} IN ({", ".join(q(g) for g in fv.RATING_SCALE)})""")
def c1_c2_valid_grade_events(spark, sf):
    ev = b.rating_event(spark, sf).select("event_id", "ticker", sc.fold_grade(F.col("raw_rating")).alias("grade"))
    return ev.filter(F.col("grade").isNotNull()).filter(sc.valid_grade(F.col("grade")))


# ---------------------------------------------------------------- firm features
@register("firm_feature_rows", sql=W() + f"SELECT {rsel(META + FEATURES, set(FEATURES))} FROM feats")
def firm_feature_rows(spark, sf):
    """Canonical feature row per firm with its latest folded grade."""
    return feats(spark, sf)


# ---------------------------------------------------------------- A5-A10, A12
@register("a5_a6_sector_stats", sql=W(sm.sector_stats_sql("feats", "sstats")) + "\nSELECT " + rsel(
    ["sector"] + [c for f in sm.SECTOR_DEPENDENT for c in (f"{f}__mean", f"{f}__std")]
    + [f"{f}__median" for f in sm.DYNAMIC_MEDIAN],
    {c for f in sm.SECTOR_DEPENDENT for c in (f"{f}__mean", f"{f}__std")} | {f"{f}__median" for f in sm.DYNAMIC_MEDIAN})
    + " FROM sstats")
def a5_a6_sector_stats(spark, sf):
    return cl.sector_stats(feats(spark, sf))


@register("a7_a8_quartiles_median", sql=W() + "\nSELECT " + ", ".join(
    f"round(quantile_cont({f}, 0.25), 6) + 0.0 AS {f}__q1, round(quantile_cont({f}, 0.75), 6) + 0.0 AS {f}__q3, "
    f"round(quantile_cont({f}, 0.5), 6) + 0.0 AS {f}__gmed" for f in FEATURES) + " FROM feats")
def a7_a8_quartiles_median(spark, sf):
    f = feats(spark, sf)
    return cl.global_quartiles(f).crossJoin(cl.global_medians(f)).select(
        *[c for x in FEATURES for c in (f"{x}__q1", f"{x}__q3", f"{x}__gmed")])


@register("a9_value_counts", sql=W() + """
SELECT 'sector' AS dimension, sector AS value, CAST(count(*) AS BIGINT) AS n FROM feats GROUP BY sector
UNION ALL SELECT 'credit_rating', credit_rating, count(*) FROM feats GROUP BY credit_rating
UNION ALL SELECT 'data_source', data_source, count(*) FROM feats GROUP BY data_source""")
def a9_value_counts(spark, sf):
    f = feats(spark, sf)
    parts = [f.groupBy(F.col(d).alias("value")).count().select(F.lit(d).alias("dimension"), "value",
                                                                F.col("count").alias("n"))
             for d in ("sector", "credit_rating", "data_source")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _null_profile_sql() -> str:
    parts = []
    for c in META + FEATURES:
        pct = f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 1)"
        parts.append(f"SELECT {q(c)} AS column_name, {pct} + 0.0 AS null_pct, CASE WHEN {pct} < 30 THEN 'ok' "
                     f"WHEN {pct} < 60 THEN 'warn' ELSE 'bad' END AS tier FROM feats")
    return W() + "\n" + "\nUNION ALL ".join(parts)


@register("a10_null_profile", sql=_null_profile_sql())
def a10_null_profile(spark, sf):
    """Null percentage per column (rounded to 1 decimal) and its tier, one
    aggregate pass, then ``stack`` to long form."""
    f = feats(spark, sf)
    cols = META + FEATURES
    wide = f.agg(*[F.round(F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)) * 100, 1).alias(c) for c in cols])
    stack = "stack({}, {}) AS (column_name, null_pct)".format(
        len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    long = wide.selectExpr(stack)
    p = F.col("null_pct")
    return long.select("column_name", p.alias("null_pct"),
                       F.when(p < 30, "ok").when(p < 60, "warn").otherwise("bad").alias("tier"))


_BOUNDS = {fv.FEATURE_NAMES[k]: v for k, v in fv.FOREIGN_CLIP_BOUNDS.items() if k in fv.FEATURE_NAMES}


@register("a12_clip_counts", sql=W() + "\nSELECT " + ", ".join(
    f"CAST(count(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 END) AS BIGINT) AS {c}" for c, (lo, hi) in _BOUNDS.items())
    + " FROM feats")
def a12_clip_counts(spark, sf):
    return cl.clip_counts(feats(spark, sf), _BOUNDS)


@register("x3_winsorize", sql=W() + "\nSELECT ticker, " + ", ".join(
    f"round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {hi}), {lo}) END, 6) + 0.0 AS {c}"
    for c, (lo, hi) in _BOUNDS.items()) + " FROM feats")
def x3_winsorize(spark, sf):
    f = feats(spark, sf)
    return f.select("ticker", *[sc.winsorize(F.col(c), lo, hi).alias(c) for c, (lo, hi) in _BOUNDS.items()])


# ---------------------------------------------------------------- W5 / I3, X4, I1
FEAT_COLS = META + FEATURES


@register("w5_group_fill", sql=W(sm.group_fill_sql("feats", "gfill", FEAT_COLS)) +
          f"\nSELECT {rsel(FEAT_COLS, set(FEATURES))} FROM gfill")
def w5_group_fill(spark, sf):
    return cl.group_fill(feats(spark, sf))


@register("x4_iqr_clip", sql=W(sm.iqr_clip_sql("feats", "iqr", FEAT_COLS)) +
          f"\nSELECT {rsel(FEAT_COLS, set(FEATURES))} FROM iqr")
def x4_iqr_clip(spark, sf):
    return cl.iqr_clip(feats(spark, sf))


@register("i1_impute_reference", sql=W(sm.impute_ref_sql("feats", "imp", META)) +
          f"\nSELECT {rsel(FEAT_COLS, set(FEATURES))} FROM imp")
def i1_impute_reference(spark, sf):
    return cl.impute_reference(feats(spark, sf))


@register("n1_reference_ratio", sql=W(sm.ref_ratio_sql("feats", "rr", FEAT_COLS)) + "\nSELECT " + rsel(
    ["ticker"] + [f"{f}_ref_ratio" for f in sm.MERGE_RATIO], {f"{f}_ref_ratio" for f in sm.MERGE_RATIO}) + " FROM rr")
def n1_reference_ratio(spark, sf):
    return fe.reference_ratio(feats(spark, sf)).select("ticker", *[f"{f}_ref_ratio" for f in sm.MERGE_RATIO])


# ---------------------------------------------------------------- C3, W4, U1/U2
@register("c3_split_rated", sql=W(MERGE_NOW) + """
SELECT ticker, 'rated' AS split FROM rated_local UNION ALL SELECT ticker, 'unrated' FROM unrated_local""")
def c3_split_rated(spark, sf):
    local = current_feats(spark, sf).filter(F.col("data_source") == "vietnam")
    rated, unrated = mg.split_local(local)
    return rated.select("ticker", F.lit("rated").alias("split")).unionByName(
        unrated.select("ticker", F.lit("unrated").alias("split")))


@register("w4_upweight", sql=W(MERGE) + """
SELECT ticker, CAST(count(*) AS BIGINT) AS copies FROM upweighted GROUP BY ticker""")
def w4_upweight(spark, sf):
    local = feats(spark, sf).filter(F.col("data_source") == "vietnam")
    rated, _ = mg.split_local(local)
    return mg.upweight(rated).groupBy("ticker").agg(F.count("*").alias("copies"))


@register("u2_merge_train", sql=W(MERGE) + f"\nSELECT {rsel(TRAIN_COLS, DBL, {'copy_no'})} FROM train_merged")
def u2_merge_train(spark, sf):
    train, _ = train_test(spark, sf)
    return train.select(*TRAIN_COLS)


@register("u2_merge_predict", sql=W(MERGE_NOW) + f"\nSELECT {rsel(TRAIN_COLS[:5] + TRAIN_COLS[6:], DBL)} FROM predict_merged")
def u2_merge_predict(spark, sf):
    """The local firms without a recent grade: the scoring half of the merge."""
    _, pred = current_train_test(spark, sf)
    return pred.select(*[c for c in TRAIN_COLS if c != "copy_no"])


_GRADED = f"(SELECT *, {fold_sql('raw_rating')} AS credit_rating FROM rating_event)"


@register("asof_yearly_rating", sql=W() + f"""
SELECT ticker, CAST(period AS BIGINT) AS period, CAST(event_id AS VARCHAR) AS event_id,
       CAST(rated_on AS VARCHAR) AS rated_on, credit_rating
FROM (SELECT f.ticker, y.period, e.event_id, CAST(e.rated_on AS DATE) AS rated_on, e.credit_rating, row_number() OVER (
        PARTITION BY f.ticker, y.period ORDER BY e.rated_on DESC NULLS LAST, e.event_id DESC) AS rn
      FROM firm_year y JOIN firm f ON f.firm_id = y.firm_id
      LEFT JOIN {_GRADED} e ON e.ticker = f.ticker
        AND date_diff('day', CAST(e.rated_on AS DATE), make_date(y.period, 6, 30)) BETWEEN 0 AND {fr.RATING_MAX_AGE}) t
WHERE rn = 1""")
def asof_yearly_rating(spark, sf):
    """As-of join: the observation that rated each firm in the middle of each
    of its years, at most a year old."""
    found = fr.yearly_ratings(spark, sf)
    return found.withColumns({c: F.col(c).cast("string") for c in ("event_id", "rated_on")})


@register("q11_scoring_rows", sql=W(MERGE_NOW, CLEAN, sm.fitted_clean_sql(
        "train_clean", "predict_merged", "score_rows", [c for c in TRAIN_COLS if c != "copy_no"])) +
          f"\nSELECT {rsel([c for c in TRAIN_COLS if c != 'copy_no'], DBL)} FROM score_rows")
def q11_scoring_rows(spark, sf):
    """The scoring set as the classifier gets it: the unrated firms, cleaned
    with the statistics of the training rows alone."""
    train, pred = current_train_test(spark, sf)
    model, _ = cl.fitted_clean(train, tiebreak="copy_no")
    return model.transform(pred).select(*[c for c in TRAIN_COLS if c != "copy_no"])


# ---------------------------------------------------------------- A2, I4
@register("a2_dedup_source_priority", sql=W(MERGE, sm.dedup_sql("train_merged", "dd")) +
          f"\nSELECT {rsel(TRAIN_COLS, DBL, {'copy_no'})} FROM dd")
def a2_dedup_source_priority(spark, sf):
    train, _ = train_test(spark, sf)
    return cl.dedup_source_priority(train, tiebreak="copy_no").select(*TRAIN_COLS)


@register("i4_fitted_clean", sql=W(MERGE, CLEAN, sm.fitted_clean_sql("train_clean", "feats", "clean_all", META + FEATURES)) +
          f"\nSELECT {rsel(META + FEATURES, set(FEATURES))} FROM clean_all")
def i4_fitted_clean(spark, sf):
    """Every firm's feature row cleaned with statistics fitted on the training
    rows, as the scoring path does."""
    train, _ = train_test(spark, sf)
    model, _ = cl.fitted_clean(train, tiebreak="copy_no")
    return model.transform(feats(spark, sf).select(*META, *FEATURES))


@register("i4_clean", sql=W(MERGE, CLEAN) + f"\nSELECT {rsel(TRAIN_COLS, DBL, {'copy_no'})} FROM train_clean")
def i4_clean(spark, sf):
    return cleaned(spark, sf).select(*TRAIN_COLS)


# ---------------------------------------------------------------- N2-N14
SCORE_COLS = [c.split(" AS ")[-1] for c in sm.score_sql()]
Z_COLS = [f"{f}_sector_z" for f in sm.SECTOR_DEPENDENT]
R_COLS = [f"{f}_sector_ratio" for f in sm.SECTOR_RATIO]
D_COLS = [f"sector_{s}" for s in SECTORS]
I_COLS = [f"{f}_x_{s}" for f in sm.INTERACTIONS for s in SECTORS]
ENG_COLS = TRAIN_COLS + Z_COLS + R_COLS + D_COLS + I_COLS + SCORE_COLS
ENG_DBL = DBL | set(Z_COLS + R_COLS + D_COLS + I_COLS + SCORE_COLS)


def _eng_query(name: str, cols: list[str], doc: str):
    def fn(spark, sf):
        return engineered(spark, sf).select(*cols)
    fn.__name__ = name
    fn.__doc__ = doc
    register(name, sql=W(MERGE, CLEAN, ENG) + f"\nSELECT {rsel(cols, ENG_DBL, {'copy_no'})} FROM train_eng")(fn)


_eng_query("n14_feature_engineering", ENG_COLS, "Full engineered training table (fit and transform on it).")
_eng_query("n2_sector_zscore", ["ticker"] + Z_COLS, "Sector z-scores of the sector-dependent features.")
_eng_query("n3_sector_median_ratio", ["ticker"] + R_COLS, "Ratios to the dynamic / reference / batch median.")
_eng_query("n4_n5_dummies_interactions", ["ticker"] + D_COLS + I_COLS, "Sector one-hot and interactions.")
_eng_query("n6_n9_altman_strength", ["ticker"] + SCORE_COLS[:12], "Altman parts, Z, FSI, IG score.")
_eng_query("n10_n13_signals", ["ticker"] + SCORE_COLS[12:], "Signal flags and high-grade score.")


FLAG_SQL = ", ".join([
    "sector", "CAST(count(*) AS BIGINT) AS n_firms",
    "round(avg(investment_grade_score), 6) + 0.0 AS avg_investment_grade_score",
    "round(avg(altman_z), 6) + 0.0 AS avg_altman_z",
    "round(avg(roa_sector_ratio), 6) + 0.0 AS avg_roa_sector_ratio",
    "round(sum(signal_profitable), 6) + 0.0 AS n_profitable",
    "round(avg(high_grade_score), 6) + 0.0 AS avg_high_grade_score",
])


@register("n_sector_investment_grade", sql=W(MERGE, CLEAN, ENG) + f"\nSELECT {FLAG_SQL} FROM train_eng GROUP BY sector")
def n_sector_investment_grade(spark, sf):
    """Flagship: merged, cleaned, engineered training rows (newest year per
    firm) summarised per sector."""
    e = engineered(spark, sf)
    return e.groupBy("sector").agg(
        F.count("*").alias("n_firms"),
        F.avg("investment_grade_score").alias("avg_investment_grade_score"),
        F.avg("altman_z").alias("avg_altman_z"),
        F.avg("roa_sector_ratio").alias("avg_roa_sector_ratio"),
        F.sum("signal_profitable").alias("n_profitable"),
        F.avg("high_grade_score").alias("avg_high_grade_score"))


# ---------------------------------------------------------------- N15-N18
_DW = []
for _name, _mu in fv.LOCAL_MARKET_PROFILE.items():
    _f = fv.FEATURE_NAMES[_name]
    _DW.append(f"power((coalesce({_f}, {_mu!r}) - {_mu!r}) / {fv.LOCAL_MARKET_STD[_name]!r}, 2)")
_DIST = f"sqrt(({' + '.join(_DW)}) / {len(_DW)})"
_DWEIGHT = (f"CASE WHEN coalesce(data_source, '') <> 'vietnam' THEN {fv.DOMAIN_BASE_WEIGHT!r} + "
            f"{fv.DOMAIN_MAX_WEIGHT - fv.DOMAIN_BASE_WEIGHT!r} * exp(-{_DIST}) ELSE 1.0 END")


@register("n15_n16_sample_weights", sql=W(MERGE, CLEAN) + f"""
SELECT ticker, round({_DWEIGHT}, 6) + 0.0 AS domain_weight,
       round(CASE WHEN data_source = 'vietnam' THEN {fv.LOCAL_SAMPLE_WEIGHT!r} ELSE 1.0 END * {_DWEIGHT}, 6) + 0.0
         AS sample_weight
FROM train_clean""")
def n15_n16_sample_weights(spark, sf):
    c = cleaned(spark, sf)
    dw = fe.domain_weight(c)
    return c.select("ticker", dw.alias("domain_weight"), (fe.source_weight() * dw).alias("sample_weight"))


@register("n17_class_weights", sql=W(MERGE, CLEAN) + """
SELECT credit_rating AS label, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) + 0.0
       AS class_weight, CAST(count(*) AS BIGINT) AS n
FROM train_clean GROUP BY credit_rating""")
def n17_class_weights(spark, sf):
    c = cleaned(spark, sf).withColumnRenamed("credit_rating", "label")
    w = fe.class_weights(c, "label")
    return w.groupBy("label").agg(F.first("class_weight").alias("class_weight"), F.count("*").alias("n"))


@register("n18_standard_scale", sql=W(MERGE, CLEAN) + "\nSELECT ticker, " + ", ".join(
    f"round((coalesce({f}, 0.0) - avg(coalesce({f}, 0.0)) OVER ()) / CASE WHEN stddev_pop(coalesce({f}, 0.0)) OVER () = 0 "
    f"THEN 1.0 ELSE stddev_pop(coalesce({f}, 0.0)) OVER () END, 4) + 0.0 AS {f}" for f in FEATURES) + " FROM train_clean")
def n18_standard_scale(spark, sf):
    s = fe.standard_scale(cleaned(spark, sf), FEATURES)
    # 4 decimals: population std is summed in different orders by the engines
    return s.select("ticker", *[F.round(F.col(f), 4).alias(f) for f in FEATURES])
