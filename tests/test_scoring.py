import pytest
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.operators import clean as cl
from ratingspark.operators import features as fe
from ratingspark.operators import models as md
from ratingspark.operators import two_stage as pl
from ratingspark.plans import q_model as qm
from ratingspark.session import materialize, scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return materialize(qm.feats(spark, SF).select("ticker", "sector", *qm.FEATURES))


@pytest.fixture(scope="module")
def scorer(spark, rows):
    clean_model, cleaned = cl.fitted_clean(rows.withColumn("data_source", F.lit("kaggle")))
    features = fe.SectorFeatureModel.fit(materialize(cleaned))
    eng = features.transform(cleaned).withColumn("label", F.pmod(F.xxhash64("ticker"), F.lit(3)).cast("int"))
    cols = md.feature_columns(eng)
    forest = md.forest(weight=None).setNumTrees(10).setMaxDepth(4)
    return pl.Scorer(clean_model, features, forest.fit(md.assemble(eng, cols)), cols, ["AA", "BBB", "B"])


def test_one_row_scores_as_in_a_larger_batch(rows, scorer):
    odd = rows.limit(6).withColumn("sector", F.when(F.rand(1) < 2, F.lit("Unheard")).otherwise(F.col("sector")))
    batch = rows.unionByName(odd.withColumn("ticker", F.concat(F.lit("odd"), "ticker")))
    batch = materialize(batch.withColumn("roa", F.when(F.pmod(F.xxhash64("ticker"), F.lit(4)) == 0, None).otherwise(F.col("roa"))))
    together = {r.ticker: r for r in scorer.score(batch).collect()}
    for ticker in ("F1", "F2", "F3", "oddF1"):
        if ticker in together:
            alone = scorer.score(batch.where(F.col("ticker") == ticker)).collect()
            assert len(alone) == 1 and alone[0].asDict() == together[ticker].asDict()


def test_saved_scorer_scores_alike(spark, rows, scorer):
    path = scratch_path(spark, "test-bundle")
    scorer.save(path)
    again = {r.ticker: (r.predicted_rating, r.confidence) for r in pl.Scorer.load(spark, path).score(rows).collect()}
    assert again == {r.ticker: (r.predicted_rating, r.confidence) for r in scorer.score(rows).collect()}


def test_manual_rows(spark, scorer):
    rows = spark.createDataFrame([("X", "RealEstate", 0.05, None, 1.5), (None, None, None, None, None)],
                                 "ticker string, sector string, roa double, roe double, current_ratio double")
    got = {r.ticker: r for r in pl.score_manual(rows, scorer).collect()}
    assert got["X"].roa == 0.05 and got["X"].roe is None and got["X"].current_ratio == 1.5
    # a sparse row is filled with medians, not refused
    assert got["Unknown"].predicted_rating in scorer.active and got["Unknown"].sector == fv.SECTOR_OTHER
    assert {"roa", "roe", "debt_to_assets", "current_ratio", "ebit_margin"} <= set(got["X"].asDict())
    assert pl.score_manual(rows.where("false"), scorer).count() == 0


def test_fitted_clean_uses_training_statistics_only(rows, scorer):
    one = rows.where("ticker = 'F1'").withColumn("roa", F.lit(1e9))
    top = scorer.clean.transform(one).first().roa
    q = scorer.clean.overall.first()
    assert top == pytest.approx(q["roa__q3"] + 1.5 * (q["roa__q3"] - q["roa__q1"]))


def test_boosted_fine_tune_refits_the_union(spark, scorer, rows):
    eng = scorer.features.transform(scorer.clean.transform(rows)).withColumn(
        "label", F.pmod(F.xxhash64("ticker"), F.lit(2)).cast("int"))
    data = materialize(md.assemble(eng.select("ticker", "label", "roa", "roe"), ["roa", "roe"]))
    first, rest = data.where("ticker < 'F2'"), data.where("ticker >= 'F2'")
    small = {"n_rounds": 1, "max_depth": 2, "learning_rate": 0.1}
    for estimator in (md.OneVsRestBoosted(weight=None, params=small), md.OrdinalClassifier(weight=None, params=small)):
        model = pl.fine_tune_boosted(estimator, first, rest, extra_rounds=1)
        assert model.classes == [0, 1] and all(m.getNumTrees == 2 for m in model.models)
        assert model.transform(rest).select(F.sum(F.aggregate("probability_array", F.lit(0.0), lambda a, x: a + x)) /
                                            F.count("*")).first()[0] == pytest.approx(1.0)
