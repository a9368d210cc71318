"""Cleaning: source-priority dedup (A2), sector statistics (A5-A8), group fill
(W5 / I3), IQR clip (X4) and the composed clean step (I4).

Quantiles are exact and distributed (``quantiles``). Each statistic reads its
input again, so the composed step writes its stages: the deduplicated rows and
the group-filled rows. Statistic tables are one row per sector, joined without
a hint, or a single row, broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.operators.quantiles import wide_quantiles
from ratingspark.session import materialize

FEATURES = list(fv.FEATURE_NAMES.values())
_DISPLAY = {v: k for k, v in fv.FEATURE_NAMES.items()}
SECTOR_DEPENDENT = [fv.FEATURE_NAMES[n] for n in fv.SECTOR_DEPENDENT]
DYNAMIC_MEDIAN = [fv.FEATURE_NAMES[n] for n in fv.DYNAMIC_MEDIAN_FEATURES]
BANK_LEVERAGE = [fv.FEATURE_NAMES[n] for n in fv.BANKING_LEVERAGE]
# all_features order of the original config: universal then sector-dependent
ALL_FEATURES = [fv.FEATURE_NAMES[n] for n in fv.UNIVERSAL_FEATURES + fv.SECTOR_DEPENDENT]


def reference_median(sector: Column, feat: str, default_sector: str | None = fv.REFERENCE_DEFAULT_SECTOR,
                     table: dict | None = None) -> Column:
    """Reference median of ``feat`` for a sector; sectors not in the table use
    ``default_sector`` (None -> null)."""
    table = table or fv.SECTOR_MEDIANS_REFERENCE
    name = _DISPLAY[feat]
    out = None
    for s, vals in table.items():
        if name in vals:
            cond = sector == F.lit(s)
            out = F.when(cond, F.lit(float(vals[name]))) if out is None else out.when(cond, F.lit(float(vals[name])))
    dflt = table.get(default_sector, {}).get(name) if default_sector else None
    dv = F.lit(None).cast("double") if dflt is None else F.lit(float(dflt))
    if out is None:
        return dv
    # a null sector is "not in the table"
    return out.otherwise(dv)


# ---------------------------------------------------------------- A2
def dedup_source_priority(df: DataFrame, key: str = "ticker", tiebreak: str | None = None,
                          preferred: str = "vietnam") -> DataFrame:
    """Keep one row per key, preferring ``data_source == preferred``; further
    ties by ``tiebreak`` ascending (the original keeps first-in-file)."""
    pri = F.when(F.col("data_source") == preferred, 0).otherwise(1)
    order = F.struct(pri.alias("p"), *([F.col(tiebreak).alias("t")] if tiebreak else []))
    # a struct minimum combines map-side: a hot key is one row per task before the shuffle
    best = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("row"))
    return best.select("row.*")


# ---------------------------------------------------------------- A5 / A6
def sector_stats(df: DataFrame) -> DataFrame:
    """Fitted per-sector statistics (null sectors excluded): A5 mean / sample
    std of the sector-dependent features (null -> 0) and A6 dynamic medians
    (median when >= 5 non-null values, else the reference median of the sector,
    Manufacturing for unknown sectors)."""
    aggs = []
    for f in SECTOR_DEPENDENT:
        aggs += [F.coalesce(F.avg(f), F.lit(0.0)).alias(f"{f}__mean"),
                 F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}__std")]
    st = df.filter(F.col("sector").isNotNull()).groupBy("sector").agg(*aggs)
    raw = wide_quantiles(df, {f"{f}__med_raw": (f, 0.5) for f in DYNAMIC_MEDIAN}, "sector",
                         {f"{f}__n": f for f in DYNAMIC_MEDIAN})
    med = [F.when(F.col(f"{f}__n") >= fv.MIN_SAMPLES_FOR_DYNAMIC_MEDIAN, F.col(f"{f}__med_raw"))
           .otherwise(reference_median(F.col("sector"), f)).alias(f"{f}__median") for f in DYNAMIC_MEDIAN]
    keep = [c for f in SECTOR_DEPENDENT for c in (f"{f}__mean", f"{f}__std")]
    return st.join(raw, "sector", "left").select("sector", *keep, *med)


# ---------------------------------------------------------------- A7 / A8
def global_quartiles(df: DataFrame, feats: list[str] = FEATURES) -> DataFrame:
    """One row: ``<f>__q1``, ``<f>__q3`` for every feature (nulls skipped)."""
    return wide_quantiles(df, {f"{f}__q{k}": (f, p) for f in feats for k, p in ((1, 0.25), (3, 0.75))})


def global_medians(df: DataFrame, feats: list[str] = FEATURES) -> DataFrame:
    return wide_quantiles(df, {f"{f}__gmed": (f, 0.5) for f in feats})


def _default(f: str) -> Column:
    return F.lit(float(fv.SECTOR_MEDIANS_REFERENCE[fv.REFERENCE_DEFAULT_SECTOR].get(_DISPLAY[f], 0.0)))


def _clipped(f: str, v: Column) -> Column:
    """X4 of one value, with the quartiles beside it in the row."""
    q1, q3 = F.col(f"{f}__q1"), F.col(f"{f}__q3")
    lo, hi = q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
    clipped = F.when(v.isNotNull() & lo.isNotNull(), F.greatest(F.least(v, hi), lo)).otherwise(v)
    if f in BANK_LEVERAGE:
        clipped = F.when(F.coalesce(F.col("sector") == "Banking", F.lit(False)), v).otherwise(clipped)
    return clipped


# ---------------------------------------------------------------- W5 / I3
def group_fill(df: DataFrame, feats: list[str] = ALL_FEATURES) -> DataFrame:
    """Null -> median of its sector; still null -> global median of the
    filled column; still null (column wholly null) -> Manufacturing reference
    median or 0. Rows with a null sector keep their own values (the original
    drops them in ``groupby.transform``; we do not)."""
    med = wide_quantiles(df, {f"{f}__smed": (f, 0.5) for f in feats}, "sector")
    filled = materialize(df.join(med, "sector", "left").select(
        *[c for c in df.columns if c not in feats],
        *[F.coalesce(F.col(f), F.col(f"{f}__smed")).alias(f) for f in feats]), "filled")
    gm = global_medians(filled, feats)
    out = filled.crossJoin(F.broadcast(gm))  # one-row table
    fills = [F.coalesce(F.col(f), F.col(f"{f}__gmed"), _default(f)).alias(f) for f in feats]
    return out.select(*[c for c in df.columns if c not in feats], *fills).select(*df.columns)


# ---------------------------------------------------------------- I1
def impute_reference(df: DataFrame, feats: list[str] = FEATURES) -> DataFrame:
    """Merge-time imputation: null -> the sector's reference median (fixed
    table) -> global median of the column -> Manufacturing reference median
    (or 0)."""
    table = fv.SECTOR_MEDIANS_IMPUTE
    step1 = df.select(*[c for c in df.columns if c not in feats],
                      *[F.coalesce(F.col(f), reference_median(F.col("sector"), f, None, table)).alias(f)
                        for f in feats])
    out = step1.crossJoin(F.broadcast(global_medians(step1, feats)))  # one-row table
    fills = []
    for f in feats:
        dflt = table[fv.IMPUTE_DEFAULT_SECTOR].get(_DISPLAY[f], 0.0)
        fills.append(F.coalesce(F.col(f), F.col(f"{f}__gmed"), F.lit(float(dflt))).alias(f))
    return out.select(*[c for c in df.columns if c not in feats], *fills).select(*df.columns)


# ---------------------------------------------------------------- X4
def iqr_clip(df: DataFrame, feats: list[str] = ALL_FEATURES) -> DataFrame:
    """Clip each feature to [Q1 - 1.5 IQR, Q3 + 1.5 IQR] with quartiles over
    all rows; the bank leverage columns are left alone on Banking rows."""
    qs = global_quartiles(df, feats)
    out = df.crossJoin(F.broadcast(qs))  # one-row table
    cols = [_clipped(f, F.col(f)).alias(f) for f in feats]
    return out.select(*[c for c in df.columns if c not in feats], *cols).select(*df.columns)


def clip_counts(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Number of values outside fixed bounds, per column (one pass)."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (F.col(c) < lo)
        if hi is not None:
            cond = cond | (F.col(c) > hi)
        aggs.append(F.count(F.when(cond, 1)).alias(c))
    return df.agg(*aggs)


# ---------------------------------------------------------------- I4
class CleanModel:
    """Fitted state of the clean step: per-sector medians, and one row of
    global medians and quartiles, all of the rows it was fitted on. A row's
    result depends on nothing else, so it is the same in a batch of any size."""

    def __init__(self, medians: DataFrame, overall: DataFrame):
        self.medians, self.overall = medians, overall

    @staticmethod
    def fit(df: DataFrame) -> "CleanModel":
        """``df`` has one row per key and is read several times: pass a
        written table."""
        medians = materialize(wide_quantiles(df, {f"{f}__smed": (f, 0.5) for f in ALL_FEATURES}, "sector"), "medians")
        half = materialize(df.join(medians, "sector", "left").select(
            *[F.coalesce(F.col(f), F.col(f"{f}__smed")).alias(f) for f in ALL_FEATURES]), "half-filled")
        middle = materialize(global_medians(half, ALL_FEATURES), "global-medians")
        full = materialize(half.crossJoin(F.broadcast(middle)).select(  # one-row table
            *[F.coalesce(F.col(f), F.col(f"{f}__gmed"), _default(f)).alias(f) for f in ALL_FEATURES]), "filled")
        return CleanModel(medians, materialize(middle.crossJoin(global_quartiles(full, ALL_FEATURES)), "overall"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Group fill (I3) and IQR clip (X4) with the fitted statistics."""
        x = df.join(self.medians, "sector", "left").crossJoin(F.broadcast(self.overall))  # one-row table
        value = {f: F.coalesce(F.col(f), F.col(f"{f}__smed"), F.col(f"{f}__gmed"), _default(f)) for f in ALL_FEATURES}
        return x.select(*[_clipped(c, value[c]).alias(c) if c in value else F.col(c) for c in df.columns])


def clean(df: DataFrame, key: str = "ticker", tiebreak: str | None = None) -> DataFrame:
    """Dedup (A2), then fill and clip with statistics of the same rows."""
    return fitted_clean(df, key, tiebreak)[1]


def fitted_clean(df: DataFrame, key: str = "ticker", tiebreak: str | None = None) -> tuple[CleanModel, DataFrame]:
    rows = materialize(dedup_source_priority(df, key, tiebreak), "dedup") if key in df.columns else df
    model = CleanModel.fit(rows)
    return model, model.transform(rows)
