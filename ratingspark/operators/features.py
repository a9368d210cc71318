"""Sector-relative features, distress scores and signals (N1-N13), the
fit/transform pair over them (N14), domain and class weights (N15-N17) and
standard scaling (N18).

``fit`` writes the per-sector statistics once
(``ratingspark.operators.clean.sector_stats``); ``transform`` joins
that table (one row per normalised sector) onto the rows and emits every engineered column in ONE projection, so the plan stays a
single codegen stage however many columns are produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.operators.clean import DYNAMIC_MEDIAN, SECTOR_DEPENDENT, reference_median, sector_stats
from ratingspark.operators.quantiles import wide_quantiles
from ratingspark.session import materialize

F_ = fv.FEATURE_NAMES
SECTOR_RATIO = [F_[n] for n in fv.SECTOR_RATIO_FEATURES]
INTERACTIONS = [F_[n] for n in fv.INTERACTION_FEATURES]
MERGE_RATIO = [F_[n] for n in fv.MERGE_RATIO_FEATURES]


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """pandas ``clip``: null stays null."""
    x = c
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    return F.when(c.isNotNull(), x)


def flag(cond: Column) -> Column:
    """pandas ``(cond).astype(float)``: a comparison with null is False."""
    return F.coalesce(cond, F.lit(False)).cast("double")


class SectorFeatureModel:
    """Fitted state of N14: the per-sector statistics, one row of overall ones
    for sectors not among them, and the sector vocabulary of the dummies (the
    normalised sectors, at most 16 names). A row's features depend on nothing
    else, so they are the same in a batch of any size."""

    def __init__(self, stats: DataFrame, overall: DataFrame, sectors: list[str]):
        self.stats, self.overall, self.sectors = stats, overall, sectors

    @staticmethod
    def fit(df: DataFrame) -> "SectorFeatureModel":
        stats = materialize(sector_stats(df), "sector-stats")
        aggs = [a for f in SECTOR_DEPENDENT for a in (F.avg(f).alias(f"{f}__bmean"), F.stddev_samp(f).alias(f"{f}__bstd"))]
        medians = wide_quantiles(df, {f"{f}__bmed": (f, 0.5) for f in SECTOR_RATIO})
        overall = materialize(df.agg(*aggs).crossJoin(medians), "overall")  # two one-row tables
        # the statistics have one row per sector
        return SectorFeatureModel(stats, overall, sorted(r["sector"] for r in stats.select("sector").collect()))

    def transform(self, df: DataFrame) -> DataFrame:
        st = self.stats.withColumn("_seen", F.lit(True))
        x = df.join(st, "sector", "left").crossJoin(F.broadcast(self.overall))  # one-row table
        sector = F.col("sector")
        seen = F.coalesce(F.col("_seen"), F.lit(False))
        out = [F.col(c) for c in df.columns]

        # N2 sector z-score
        for f in SECTOR_DEPENDENT:
            m = F.when(seen, F.col(f"{f}__mean")).otherwise(F.col(f"{f}__bmean"))
            s = F.when(seen, F.col(f"{f}__std")).otherwise(F.col(f"{f}__bstd"))
            s = F.when(s == 0, F.lit(1e-8)).otherwise(s)
            z = F.when(sector.isNotNull(), (F.col(f) - m) / s)
            out.append(clip(F.coalesce(z, F.lit(0.0)), -4, 4).alias(f"{f}_sector_z"))

        # N3 ratio to sector median: fitted -> reference -> batch (zero skipped)
        for f in SECTOR_RATIO:
            dyn = F.col(f"{f}__median") if f in DYNAMIC_MEDIAN else F.lit(None).cast("double")
            ref = reference_median(sector, f, default_sector=None)
            med = F.coalesce(F.nullif(dyn, F.lit(0.0)), F.nullif(ref, F.lit(0.0)), F.col(f"{f}__bmed"))
            ok = sector.isNotNull() & med.isNotNull() & (F.abs(med) > 1e-9)
            r = F.when(ok, F.col(f) / med).otherwise(F.lit(1.0))
            out.append(F.coalesce(clip(r, 0, 10), F.lit(1.0)).alias(f"{f}_sector_ratio"))

        # N4 dummies, N5 interactions
        dummies = {s: F.when(sector == s, F.lit(1.0)).otherwise(F.lit(0.0)) for s in self.sectors}
        for s, d in dummies.items():
            out.append(d.alias(f"sector_{s}"))
        for f in INTERACTIONS:
            for s, d in dummies.items():
                out.append((F.col(f) * d).alias(f"{f}_x_{s}"))

        out += score_columns()
        return x.select(*out)


def score_columns() -> list[Column]:
    """N6-N13 as column expressions over the canonical features."""
    roa, roe, da, de = F.col("roa"), F.col("roe"), F.col("debt_to_assets"), F.col("debt_to_equity")
    em, cr, g, nd = F.col("ebit_margin"), F.col("current_ratio"), F.col("revenue_growth_yoy"), F.col("net_debt_to_ebitda")
    wcta, reta, mb, at = F.col("wcta"), F.col("reta"), F.col("market_to_book"), F.col("asset_turnover")
    # N6
    comps = [1.2 * clip(wcta, -1, 1), 1.4 * clip(reta, -1, 1), 3.3 * clip(em, -1, 1),
             0.6 * clip(mb, 0, 20), 1.0 * clip(at, 0, 10)]
    z = sum((F.coalesce(c, F.lit(0.0)) for c in comps[1:]), F.coalesce(comps[0], F.lit(0.0)))
    # N7
    dcl = clip(da, 0.01, 0.99)
    coverage = em / dcl
    # N8
    fs = [clip(roa, -0.3, 0.3) / 0.3, clip(reta, -0.5, 0.5) / 0.5, clip(em, -0.5, 0.5) / 0.5,
          clip((cr - 1) / 2, -1, 1), clip(0.5 - da, -0.5, 0.5) / 0.5]
    fsi = clip((fs[0] + fs[1] + fs[2] + fs[3] + fs[4]) / 5.0, -1, 1)
    # N9
    dsm = clip(0.75 - da, -0.5, 0.75)
    ig = (clip(z, 0, 6) / 6 + (fsi + 1) / 2 + clip(dsm, 0, 0.75) / 0.75) / 3.0
    # N10-N13
    hg = [flag(da < 0.25), flag((roa > 0.08) & (roe > 0.15)), flag(coverage > 0.3), flag(de < 0.5), flag(nd < 1.5)]
    hgs = hg[0] + hg[1] + hg[2] + hg[3] + hg[4]
    names = ["altman_wcta", "altman_reta", "altman_ebit", "altman_mb", "altman_turnover"]
    cols = [c.alias(n) for c, n in zip(comps, names)]
    cols += [
        z.alias("altman_z"),
        coverage.alias("coverage_proxy"),
        (roa * g).alias("quality_growth"),
        clip(1 - da, 0, 1).alias("equity_ratio"),
        fsi.alias("financial_strength_index"),
        dsm.alias("debt_safety_margin"),
        ig.alias("investment_grade_score"),
        flag(roa > 0).alias("signal_profitable"),
        flag(g > 0).alias("signal_growth_pos"),
        flag(g > 0.15).alias("signal_high_growth"),
        flag(da < 0.5).alias("signal_low_debt"),
        flag(da > 0.75).alias("signal_high_debt"),
        flag(cr > 1.5).alias("signal_good_liquidity"),
        flag(roe > 0.15).alias("signal_high_roe"),
        hg[0].alias("signal_very_low_debt"),
        flag(da < 0.35).alias("signal_conservative_debt"),
        hg[1].alias("signal_strong_profitability"),
        flag((roa > 0.12) & (roe > 0.20)).alias("signal_elite_profitability"),
        hg[2].alias("signal_strong_coverage"),
        flag(coverage > 0.5).alias("signal_excellent_coverage"),
        clip(coverage, 0, 10).alias("coverage_ratio"),
        hg[3].alias("signal_low_leverage"),
        flag(de < 0.2).alias("signal_very_low_leverage"),
        hg[4].alias("signal_low_net_debt"),
        flag(nd < 0).alias("signal_net_cash"),
        hgs.alias("high_grade_score"),
        (hgs / 5.0).alias("high_grade_score_norm"),
        flag(cr > 2.5).alias("signal_excellent_liquidity"),
        flag(reta > 0.3).alias("signal_high_reta"),
        flag(reta > 0.5).alias("signal_elite_reta"),
        flag(z > 3.0).alias("signal_altman_safe"),
        flag((z >= 1.8) & (z <= 3.0)).alias("signal_altman_grey"),
        flag(z < 1.8).alias("signal_altman_distress"),
    ]
    return cols


def engineer(df: DataFrame) -> DataFrame:
    """N14 fit_transform on one batch."""
    return SectorFeatureModel.fit(df).transform(df)


# ---------------------------------------------------------------- W6
def batch_sector_z(df: DataFrame, feats: list[str]) -> DataFrame:
    """Adds ``<f>_batch_z``, the distance from the batch's sector mean in its
    sample deviations: an aggregate that combines map-side and a join, so a
    sector with most of the rows is not gathered."""
    stats = df.where("sector is not null").groupBy("sector").agg(*[a for f in feats for a in (
        F.avg(f).alias(f"{f}__m"), F.stddev_samp(f).alias(f"{f}__s"))])
    z = [((F.col(f) - F.col(f"{f}__m")) / (F.col(f"{f}__s") + 1e-8)).alias(f"{f}_batch_z") for f in feats]
    return df.join(stats, "sector", "left").select(*[F.col(c) for c in df.columns], *z)


# ---------------------------------------------------------------- N1
def reference_ratio(df: DataFrame) -> DataFrame:
    """Merge-time ratio to the imputation reference median, clip [0, 10];
    sector not in the table -> 1.0 (7 features)."""
    out = [F.col(c) for c in df.columns]
    for f in MERGE_RATIO:
        med = reference_median(F.col("sector"), f, default_sector=None, table=fv.SECTOR_MEDIANS_IMPUTE)
        r = F.when(med.isNotNull() & (F.abs(med) >= 1e-9), clip(F.col(f) / med, 0, 10))
        out.append(F.coalesce(r, F.lit(1.0)).alias(f"{f}_ref_ratio"))
    return df.select(*out)


# ---------------------------------------------------------------- N15-N17
def domain_weight(df: DataFrame) -> Column:
    """0.5 + 1.5 * exp(-sqrt(mean z^2)) for non-local rows, else 1; a
    null feature counts as distance 0."""
    terms = []
    for name, mu in fv.LOCAL_MARKET_PROFILE.items():
        f = F_[name]
        if f not in df.columns:
            continue
        sd = fv.LOCAL_MARKET_STD.get(name, 1.0)
        terms.append(F.pow((F.coalesce(F.col(f), F.lit(mu)) - F.lit(mu)) / F.lit(sd), 2))
    if not terms:
        return F.lit(1.0)
    dist = F.sqrt(sum(terms[1:], terms[0]) / len(terms))
    w = fv.DOMAIN_BASE_WEIGHT + (fv.DOMAIN_MAX_WEIGHT - fv.DOMAIN_BASE_WEIGHT) * F.exp(-dist)
    return F.when(F.coalesce(F.col("data_source"), F.lit("")) != "vietnam", w).otherwise(F.lit(1.0))


def source_weight(local_weight: float = fv.LOCAL_SAMPLE_WEIGHT) -> Column:
    """Local rows weigh ``local_weight``, others 1."""
    return F.when(F.col("data_source") == "vietnam", F.lit(float(local_weight))).otherwise(F.lit(1.0))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """N17 balanced weight n / (k * count) per class; joined back as a column."""
    counts = df.groupBy(label).count()
    tot = counts.agg(F.sum("count").alias("_n"), F.count("*").alias("_k"))
    cw = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("count"))).alias("class_weight"))
    return df.join(F.broadcast(cw), label, "left")  # one row per class


# ---------------------------------------------------------------- N18
def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null -> 0 then (x - mean) / population std (std 0 -> 1), one
    aggregate row broadcast back."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    st = df.agg(*[a for c in cols for a in (F.avg(filled[c]).alias(f"{c}__mu"),
                                            F.stddev_pop(filled[c]).alias(f"{c}__sd"))])
    x = df.crossJoin(F.broadcast(st))
    out = [F.col(c) for c in df.columns if c not in cols]
    for c in cols:
        sd = F.col(f"{c}__sd")
        sd = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        out.append(((filled[c] - F.col(f"{c}__mu")) / sd).alias(c))
    return x.select(*out)

