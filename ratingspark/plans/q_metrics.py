"""Registered queries: metrics (Q1-Q8, Q10) on model-free (truth, pred) grade
pairs — latest grade as truth, the grade before it as prediction — and the
label operators (M1-M4), joins (J1, J3, J7) and sector normaliser (X9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.functions.scalars import normalize_sector
from ratingspark.operators import comparison as cmp
from ratingspark.operators import labels as lb
from ratingspark.operators import metrics as mt
from ratingspark.operators.fundamentals import materialize
from ratingspark.plans import q_model as qm
from ratingspark.plans.registry import register
from ratingspark.plans.sql_bindings import normalize_sector_sql, q
from ratingspark.plans.sql_firms import ordinal_sql
from ratingspark.sources import bindings as b
from ratingspark.sources import firms as fr

W = qm.W


def pairs(spark, sf):
    p = fr.rating_pairs(spark, sf)
    f = b.firm(spark, sf).select("ticker", "sector", "data_source")
    return materialize(p.join(f, "ticker"))


X = f"""x AS (
  SELECT p.*, f.sector, f.data_source, {ordinal_sql('p.truth')} AS t, {ordinal_sql('p.pred')} AS p
  FROM rating_pair p JOIN firm f ON f.ticker = p.ticker
)"""


def _metrics_sql(src: str, out: str) -> str:
    return f"""{out}_pos AS (
  SELECT ord, dense_rank() OVER (ORDER BY ord) - 1 AS pos FROM (SELECT t AS ord FROM {src} UNION SELECT p FROM {src}) u
),
{out}_cells AS (
  SELECT ti.pos AS i, pj.pos AS j, count(*) AS c
  FROM {src} JOIN {out}_pos ti ON {src}.t = ti.ord JOIN {out}_pos pj ON {src}.p = pj.ord GROUP BY 1, 2
),
{out}_k AS (SELECT count(*) AS K FROM {out}_pos),
{out}_wo AS (SELECT sum(CASE WHEN K > 1 THEN power(i - j, 2) / power(K - 1, 2) END * c) AS wo FROM {out}_cells, {out}_k),
{out}_we AS (
  SELECT sum(CASE WHEN K > 1 THEN power(r.i - cc.j, 2) / power(K - 1, 2) END * r.r * cc.c / n.n) AS we
  FROM (SELECT i, sum(c) AS r FROM {out}_cells GROUP BY i) r,
       (SELECT j, sum(c) AS c FROM {out}_cells GROUP BY j) cc,
       (SELECT sum(c) AS n FROM {out}_cells) n, {out}_k
),
{out} AS (
  SELECT CAST(count(*) AS BIGINT) AS n,
         avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS accuracy,
         avg(CAST(abs(t - p) AS DOUBLE)) AS mae,
         avg(CASE WHEN abs(t - p) <= 1 THEN 1.0 ELSE 0.0 END) AS within_1,
         avg(CASE WHEN abs(t - p) <= 2 THEN 1.0 ELSE 0.0 END) AS within_2,
         (SELECT CASE WHEN K <= 1 THEN 0.0 ELSE 1 - wo / we END FROM {out}_k, {out}_wo, {out}_we) AS kappa
  FROM {src}
)"""


_R = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ["accuracy", "mae", "within_1", "within_2", "kappa"])


@register("q1_q2_ordinal_metrics", sql=W(X, _metrics_sql("x", "m")) + f"\nSELECT n, {_R} FROM m")
def q1_q2_ordinal_metrics(spark, sf):
    """Accuracy, MAE in notches, within-1/2 and quadratic-weighted kappa."""
    return mt.ordinal_metrics(pairs(spark, sf))


_REPORT = """rep AS (
  SELECT coalesce(t.grade, pr.grade) AS grade, coalesce(t.support, 0) AS support, coalesce(t.tp, 0) AS tp,
         coalesce(pr.predicted, 0) AS predicted
  FROM (SELECT truth AS grade, count(*) AS support, sum(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS tp
        FROM x GROUP BY truth) t
  FULL JOIN (SELECT pred AS grade, count(*) AS predicted FROM x GROUP BY pred) pr ON t.grade = pr.grade
),
rep2 AS (
  SELECT grade, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM rep
),
rep3 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM rep2
)"""


@register("q4_class_report", sql=W(X, _REPORT) + """
SELECT grade, CAST(support AS BIGINT) AS support, round(precision, 6) + 0.0 AS precision,
       round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1 FROM rep3""")
def q4_class_report(spark, sf):
    return mt.per_class_report(pairs(spark, sf))


@register("q3_f1_scores", sql=W(X, _REPORT) + """
SELECT round(avg(f1), 6) + 0.0 AS f1_macro, round(sum(f1 * support) / sum(support), 6) + 0.0 AS f1_weighted FROM rep3""")
def q3_f1_scores(spark, sf):
    return mt.f1_summary(pairs(spark, sf))


@register("q5_confusion_matrix", sql=W(X) + "\nSELECT truth, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE pred = {q(g)}) AS BIGINT) AS \"{g}\"" for g in fv.RATING_SCALE)
    + " FROM x GROUP BY truth")
def q5_confusion_matrix(spark, sf):
    return mt.confusion(pairs(spark, sf))


@register("q6_sector_accuracy", sql=W(X) + """
SELECT sector, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy
FROM x GROUP BY sector HAVING count(*) >= 2""")
def q6_sector_accuracy(spark, sf):
    return mt.per_group_accuracy(pairs(spark, sf), "sector")


@register("q7_class_accuracy", sql=W(X) + """
SELECT truth, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy
FROM x GROUP BY truth""")
def q7_class_accuracy(spark, sf):
    return mt.per_group_accuracy(pairs(spark, sf), "truth", min_n=1)


@register("q8_score_histogram", sql=W(qm.MERGE, qm.CLEAN, qm.ENG) + """,
st AS (SELECT count(investment_grade_score) AS n_, min(investment_grade_score) AS lo, max(investment_grade_score) AS hi,
              avg(investment_grade_score) AS mean FROM train_eng),
hx AS (SELECT investment_grade_score AS v, greatest(5, least(25, n_)) AS bins, lo, hi, mean
       FROM train_eng, st WHERE investment_grade_score IS NOT NULL)
SELECT CAST(least(CASE WHEN hi = lo THEN 0 ELSE CAST(floor((v - lo) / ((hi - lo) / bins)) AS INTEGER) END, bins - 1) AS BIGINT)
         AS bin, CAST(bins AS BIGINT) AS bins, round(mean, 6) + 0.0 AS mean, CAST(count(*) AS BIGINT) AS n
FROM hx GROUP BY 1, 2, 3""")
def q8_score_histogram(spark, sf):
    """Equal-width histogram (clamp(n, 5, 25) bins) and mean of the
    investment-grade score of the engineered training rows."""
    return mt.histogram(qm.engineered(spark, sf), "investment_grade_score")


@register("q10_domain_gap", sql=W(
    X, "xa AS (SELECT * FROM x WHERE data_source = 'kaggle')", "xb AS (SELECT * FROM x WHERE data_source = 'vietnam')",
    _metrics_sql("xa", "ma"), _metrics_sql("xb", "mb")) + """,
g AS (
  SELECT 'accuracy' AS metric, ma.accuracy AS foreign_, mb.accuracy AS local_ FROM ma, mb
  UNION ALL SELECT 'kappa', ma.kappa, mb.kappa FROM ma, mb
  UNION ALL SELECT 'within_1', ma.within_1, mb.within_1 FROM ma, mb
)
SELECT metric, round(foreign_, 6) + 0.0 AS "foreign", round(local_, 6) + 0.0 AS local,
       round(abs(local_ - foreign_), 6) + 0.0 AS gap,
       CASE WHEN abs(local_ - foreign_) < 0.05 THEN 'small' WHEN abs(local_ - foreign_) < 0.15 THEN 'medium'
            ELSE 'large' END AS status
FROM g""")
def q10_domain_gap(spark, sf):
    p = pairs(spark, sf)
    return mt.domain_gap(p.filter(F.col("data_source") == "kaggle"), p.filter(F.col("data_source") == "vietnam"))


# ---------------------------------------------------------------- M1-M4
LBL = f"""lbl AS (
  SELECT ticker, credit_rating, {ordinal_sql('credit_rating')} AS rating_ordinal FROM train_clean
)"""


def labelled(spark, sf):
    return lb.encode(qm.cleaned(spark, sf).select("ticker", "credit_rating"))


@register("m1_label_encoding", sql=W(qm.MERGE, qm.CLEAN, LBL) +
          "\nSELECT ticker, credit_rating, CAST(rating_ordinal AS BIGINT) AS rating_ordinal FROM lbl")
def m1_label_encoding(spark, sf):
    return labelled(spark, sf)


def _m2_sql() -> str:
    """The merge as a recursive query over one row: the counts of the grades
    and the grade that each has gone to."""
    k, least = len(fv.RATING_SCALE), fv.MIN_CLASS_SIZE
    grades = ", ".join(q(g) for g in fv.RATING_SCALE)
    return W(qm.MERGE, qm.CLEAN, LBL).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
sizes AS (SELECT rating_ordinal AS o, count(*) AS n FROM lbl GROUP BY rating_ordinal),
merging AS (
  SELECT 0 AS step, list(coalesce(n, 0) ORDER BY g) AS n, list(g ORDER BY g) AS goes
  FROM range({k}) r(g) LEFT JOIN sizes ON o = g
  UNION ALL
  SELECT step + 1, list_transform(range({k}), lambda i: CASE WHEN i = small THEN 0
      WHEN i = target THEN n[i + 1] + n[small + 1] ELSE n[i + 1] END),
    list_transform(goes, lambda g: CASE WHEN g = small THEN target ELSE g END)
  FROM (SELECT *, coalesce(list_min(list_filter(range({k}), lambda i: n[i + 1] >= {least} AND i > small)),
                           list_max(list_filter(range({k}), lambda i: n[i + 1] >= {least} AND i < small))) AS target
        FROM (SELECT *, list_min(list_filter(range({k}), lambda i: n[i + 1] > 0 AND n[i + 1] < {least})) AS small
              FROM merging) a) b
  WHERE small IS NOT NULL AND target IS NOT NULL),
merged AS (SELECT goes FROM merging ORDER BY step DESC LIMIT 1),
placed AS (SELECT o, n, goes[o + 1] AS g FROM sizes, merged)
SELECT CAST(o AS BIGINT) AS rating_ordinal, [{grades}][o + 1] AS credit_rating,
       CAST(dense_rank() OVER (ORDER BY g) - 1 AS BIGINT) AS label, [{grades}][g + 1] AS label_grade,
       CAST(n AS BIGINT) AS n FROM placed"""


@register("m2_rare_class_merge", sql=_m2_sql())
def m2_rare_class_merge(spark, sf):
    """Class counts before the merge and the merged class each goes to."""
    df, _ = lb.merge_rare_classes(labelled(spark, sf))
    return df.groupBy("rating_ordinal", "credit_rating", "label", "label_grade").agg(F.count("*").alias("n"))


_SPLIT = f"""cls AS (SELECT min(c) AS mn FROM (SELECT count(*) AS c FROM lbl GROUP BY rating_ordinal) t),
sp AS (
  SELECT ticker, rating_ordinal,
         row_number() OVER (PARTITION BY rating_ordinal ORDER BY md5(ticker || '#{fv.SEED}'), ticker) AS rn_s,
         count(*) OVER (PARTITION BY rating_ordinal) AS n_s,
         row_number() OVER (ORDER BY md5(ticker || '#{fv.SEED}'), ticker) AS rn_g,
         count(*) OVER () AS n_g
  FROM lbl
)"""


@register("m3_stratified_split", sql=W(qm.MERGE, qm.CLEAN, LBL, _SPLIT) + f"""
SELECT ticker, CAST(rating_ordinal AS BIGINT) AS rating_ordinal,
       CASE WHEN mn >= 2 THEN rn_s <= round(n_s * {fv.TEST_SIZE}) ELSE rn_g <= round(n_g * {fv.TEST_SIZE}) END AS is_test
FROM sp, cls""")
def m3_stratified_split(spark, sf):
    return lb.stratified_split(labelled(spark, sf), label="rating_ordinal").select("ticker", "rating_ordinal", "is_test")


def _folds_sql() -> str:
    k15 = fv.CV_FOLDS * fv.CV_REPEATS
    parts = []
    for r in range(fv.CV_REPEATS):
        parts.append(f"""SELECT ticker, rating_ordinal, {r} AS repeat_,
  CASE WHEN mn >= {fv.CV_FOLDS} THEN (row_number() OVER (PARTITION BY rating_ordinal ORDER BY md5(ticker || '#{fv.SEED + r}'), ticker) - 1) % {fv.CV_FOLDS}
       ELSE (row_number() OVER (ORDER BY md5(ticker || '#{fv.SEED + r}'), ticker) - 1) % greatest(2, mn) END AS fold,
  CASE WHEN mn >= {fv.CV_FOLDS} THEN {fv.CV_FOLDS} ELSE greatest(2, mn) END AS k
FROM lbl, cls WHERE {r} = 0 OR mn >= {k15}""")
    return "\nUNION ALL ".join(parts)


@register("m4_cv_folds", sql=W(qm.MERGE, qm.CLEAN, LBL, _SPLIT) + f"""
SELECT ticker, CAST(rating_ordinal AS BIGINT) AS rating_ordinal, CAST(repeat_ AS BIGINT) AS "repeat",
       CAST(fold AS BIGINT) AS fold, CAST(k AS BIGINT) AS k FROM ({_folds_sql()}) f""")
def m4_cv_folds(spark, sf):
    return lb.assign_folds(labelled(spark, sf), label="rating_ordinal")


# ---------------------------------------------------------------- Q9 of rules that need no fit
RULES = {"Majority": [], "SectorMajority": ["sector"], "SourceMajority": ["data_source", "sector"]}


def _rules_sql() -> str:
    """The rules' predictions and their metrics, from the definition: every fold's
    winners are counted over the rows of the other folds."""
    def winners(cols):
        group = "".join(f", x.{c}" for c in cols)
        named = "".join(f", {c}" for c in cols)
        return f"""SELECT repeat_, fold{named}, arg_max(truth, n * 100 - o) AS won FROM (
  SELECT p.repeat_, p.fold{group}, x.truth, x.o, count(*) AS n
  FROM places p JOIN x ON x.repeat_ = p.repeat_ AND x.fold <> p.fold GROUP BY ALL) c GROUP BY repeat_, fold{named}"""
    preds = []
    for name, cols in RULES.items():
        on = " AND ".join(f"w.{c} IS NOT DISTINCT FROM x.{c}" for c in ["repeat_", "fold", *cols])
        preds.append(f"""SELECT {q(name)} AS model, x.repeat_, x.fold, x.truth, coalesce(w.won, a.won) AS pred
  FROM x LEFT JOIN ({winners([])}) a ON a.repeat_ = x.repeat_ AND a.fold = x.fold LEFT JOIN ({winners(cols)}) w ON {on}""")
    place = "model, repeat_, fold"
    return f"""folds AS ({_folds_sql()}),
places AS (SELECT DISTINCT repeat_, fold FROM folds),
x AS (SELECT c.ticker, c.credit_rating AS truth, {ordinal_sql('c.credit_rating')} AS o, c.sector, c.data_source,
             f.repeat_, f.fold FROM train_clean c JOIN folds f ON f.ticker = c.ticker),
preds AS ({" UNION ALL ".join(preds)}),
cells AS (SELECT {place}, {ordinal_sql('truth')} AS t, {ordinal_sql('pred')} AS p, count(*) AS c FROM preds GROUP BY ALL),
present AS (SELECT {place}, o, row_number() OVER (PARTITION BY {place} ORDER BY o) AS pos
            FROM (SELECT {place}, t AS o FROM cells UNION SELECT {place}, p FROM cells) u),
placed AS (SELECT {place}, i.pos AS i, j.pos AS j, c, t, p FROM cells JOIN present i USING ({place})
           JOIN present j USING ({place}) WHERE i.o = t AND j.o = p),
rows_ AS (SELECT {place}, i, sum(c) AS r FROM placed GROUP BY ALL),
cols_ AS (SELECT {place}, j, sum(c) AS s FROM placed GROUP BY ALL),
sums AS (SELECT {place}, sum(c) AS n, sum(CASE WHEN t = p THEN c ELSE 0 END) AS hits, sum(c * power(i - j, 2)) AS seen
         FROM placed GROUP BY ALL),
chance AS (SELECT {place}, sum(power(i - j, 2) * r * s) AS e FROM rows_ JOIN cols_ USING ({place}) GROUP BY ALL),
k AS (SELECT {place}, max(pos) AS k FROM present GROUP BY ALL),
per_fold AS (SELECT model, hits / n AS accuracy, CASE WHEN k <= 1 THEN 0.0 ELSE 1 - seen / (e / n) END AS kappa
             FROM sums JOIN chance USING ({place}) JOIN k USING ({place}))"""


@register("q9_majority_comparison", sql=W(qm.MERGE, qm.CLEAN, LBL, _SPLIT, _rules_sql()) + """
SELECT model, CAST(count(*) AS BIGINT) AS n_folds, round(avg(accuracy), 6) + 0.0 AS mean_accuracy,
       round(stddev_samp(accuracy), 6) + 0.0 AS std_accuracy, round(avg(kappa), 6) + 0.0 AS mean_kappa,
       round(stddev_samp(kappa), 6) + 0.0 AS std_kappa FROM per_fold GROUP BY model""")
def q9_majority_comparison(spark, sf):
    """Cross-validated accuracy and kappa of majority rules, the baselines that a
    fitted model has to beat."""
    rows = materialize(lb.encode(qm.cleaned(spark, sf).select("ticker", "credit_rating", "sector", "data_source")), "rows")
    folds = materialize(lb.assign_folds(rows.select("ticker", "rating_ordinal"), label="rating_ordinal"), "folds")
    return cmp.cv_table(cmp.majority_predictions(RULES, rows, folds, truth="credit_rating"))


# ---------------------------------------------------------------- J1, J3, J7, X9
@register("j1_ratings_join_features", sql=W() + f"""
SELECT e.ticker, CAST(e.event_id AS BIGINT) AS event_id, e.raw_rating, {qm.rd('f.roa')}, {qm.rd('f.debt_to_assets')}
FROM rating_event e JOIN feats f ON f.ticker = e.ticker""".replace("AS f.roa", "AS roa").replace(
    "AS f.debt_to_assets", "AS debt_to_assets"))
def j1_ratings_join_features(spark, sf):
    """Inner equi-join of every rating event with its firm's feature row —
    a shuffle join on ticker (both sides grow with the data)."""
    ev = b.rating_event(spark, sf).select("ticker", "event_id", "raw_rating")
    return ev.join(qm.feats(spark, sf).select("ticker", "roa", "debt_to_assets"), "ticker")


@register("x9_j3_sector_lookup", sql=W() + f"""
SELECT ticker, sector_raw, {normalize_sector_sql('sector_raw')} AS sector_normalized FROM firm""")
def x9_j3_sector_lookup(spark, sf):
    """Sector text normalised once per DISTINCT text (small), then joined back
    to every firm; null / blank -> ``Other``. The text is free, so the join's side
    is left to be chosen by its measured size."""
    f = b.firm(spark, sf).select("ticker", "sector_raw")
    key = F.coalesce(F.col("sector_raw"), F.lit(""))
    d = f.select(key.alias("_k")).distinct().select("_k", normalize_sector(F.col("_k")).alias("sector_normalized"))
    out = f.withColumn("_k", key).join(d, "_k", "left")
    return out.select("ticker", "sector_raw", F.coalesce("sector_normalized", F.lit(fv.SECTOR_OTHER)).alias(
        "sector_normalized"))


@register("j7_s5_pending_ingest", sql=W() + """
SELECT f.ticker, CAST(m.period AS BIGINT) AS period FROM firm f CROSS JOIN (SELECT max(period) AS period FROM firm_year) m
WHERE NOT EXISTS (SELECT 1 FROM firm_year y WHERE y.firm_id = f.firm_id AND y.period = m.period)""")
def j7_s5_pending_ingest(spark, sf):
    """Listed firms whose statements of the newest year have not landed yet: the
    work list of the per-key cached ingest (anti-join against what is stored)."""
    landed = materialize(b.firm_year(spark, sf).select("firm_id", "period"), "landed")
    newest = F.broadcast(landed.agg(F.max("period").alias("period")))  # one-row table
    wanted = b.firm(spark, sf).select("firm_id", "ticker").crossJoin(newest)
    return wanted.join(landed, ["firm_id", "period"], "left_anti").select("ticker", "period")
